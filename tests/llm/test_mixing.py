from collections import defaultdict

import pytest

from bidstream.llm import mixing
from tests.llm.conftest import SCHEMA, collected


def targets(sizes, share=1.5, weights=(5, 2, 1), cap=2.0):
    """Shares by weight; what is above a limit goes to the others until nothing is."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, full = share * sum(sizes.values()), set()
    while True:
        rest = [s for s in names if s not in full]
        level = left / sum(weight[s] for s in rest) if rest else 0
        over = [s for s in rest if weight[s] * level > cap * sizes[s] + 1e-9]
        if not over:
            return {s: cap * sizes[s] if s in full else weight[s] * level for s in names}
        full |= set(over)
        left -= sum(cap * sizes[s] for s in over)


@pytest.mark.parametrize("fan_in", [2, 5, 128])
def test_mix_meets_its_targets(docs, rows, fan_in):
    out = mixing.mix(docs, fan_in=fan_in).collect()
    import re
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(((r["doc_id"], r["source"], r["size"]) for r in out), key=repr) == sorted(((r[0], r[3], size(r[1])) for r in rows), key=repr)
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in out:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        assert r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
    want = targets(sizes)
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6


def test_reruns_agree_whatever_the_partitions(docs):
    names = ("doc_id", "key", "source", "copies")
    assert collected(mixing.mix(docs), *names) == collected(mixing.mix(docs.repartition(7)), *names)


def test_rounding_is_fair(spark):
    """Over many equal documents, the share that gets the extra copy is the fraction; order has no say in it."""
    rows = [(i, "a b c d", "en", "x" if i % 2 else "y", 7, None, None, None) for i in range(4000)]
    out = mixing.mix(spark.createDataFrame(rows, SCHEMA), fan_in=16).collect()
    low = [r["copies"] for r in out if r["source"] == "y"]
    want = next(r["target"] for r in out if r["source"] == "y") / 8000
    assert abs(sum(low) / len(low) - want) < 1e-3
    halves = [sum(r["copies"] for r in out if r["source"] == "y" and (r["doc_id"] < 2000) == h) / 1000 for h in (True, False)]
    assert abs(halves[0] - halves[1]) < 0.15


def test_mixed_documents_repeat_rows(docs):
    taken = sum(r["copies"] for r in mixing.mix(docs).collect())
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and out.count() == taken
    assert {(r["size"], r["nth"], r["key"]) for r in out.collect()} <= {("s", "b", "k"), (None, None, None)}


def test_empty_table_and_texts(spark, no_docs):
    assert mixing.mix(no_docs).count() == 0
    rows = [(1, None, None, None, 0, None, None, None), (2, "", None, "a", 0, None, None, None)]
    assert {r["taken"] for r in mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()} == {0}
