"""Literals of translations: nulls, mailboxes, and words of any length."""

import duckdb

from bidstream.functions import translation as tr
from bidstream.plans import cases


def test_long_words_are_not_searched_for_mailboxes_and_nulls_stay(spark):
    texts = [None, "", "a@b.org 12", "http://x.y/1 and 7,5", "x" * 300_000]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    masked, literals = tr.masked(rows["t"])
    got = rows.select(masked.alias("m"), literals.alias("l"), tr.faults(rows["t"], rows["t"]).alias("f")).collect()
    assert [r["l"] for r in got] == [None, [], ["a@b.org", "12"], ["http://x.y/1", "7,5"], []] and got[0]["m"] is None and got[2]["m"] == "⟦⟧ ⟦⟧"
    assert all(r["f"] == [] for r in got)


def test_cases_stay(spark):
    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{data}/orders.parquet'")
    assert sorted(map(tuple, cases.QUERIES["literals_checked"](spark, data).collect())) == sorted(con.execute(cases.SQL["literals_checked"]).fetchall())
