"""Functions of texts hold few texts at once in Python, and work out equal ones once."""

import pyarrow as pa

from bidstream.functions import text as tx

CALLS: list = []


def _told(v):
    CALLS.append(v)
    return "none" if v is None else v.upper()


def test_equal_texts_are_worked_out_once_and_few_are_held():
    CALLS.clear()
    out = list(tx._vectorised(_told).func(iter([pa.array(["a", None, "b"] * 1000), pa.array([], pa.string())])))
    assert [v for a in out for v in a.to_pylist()] == ["A", "none", "B"] * 1000
    assert max(len(a) for a in out) <= 256 and len(CALLS) == 3 * len(out)


def test_nulls_and_empty_tables(spark):
    rows = spark.createDataFrame([(i, [None, "", " a <b>x</b> ", "\x1c\x85 y"][i % 4]) for i in range(1000)], "i int, t string")
    got = rows.select("i", tx.clean("t").alias("c"), tx.normal_text("t").alias("n")).collect()
    assert {(r["i"] % 4, r["c"], r["n"]) for r in got} == {(0, "", ""), (1, "", ""), (2, "a x", "a x"), (3, "y", "y")} and len(got) == 1000
    assert rows.where("false").select(tx.clean("t")).collect() == []
