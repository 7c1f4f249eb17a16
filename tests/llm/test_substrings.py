import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from bidstream.llm import substrings
from tests.llm.conftest import SCHEMA, prose


def by_force(rows, length=substrings.LENGTH):
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    count = Counter(t[i:i + length] for _, t in texts for i in range(len(t) - length + 1))
    out = []
    for doc_id, t in texts:
        gone = np.zeros(len(t) + 1, dtype=int)
        for i in range(len(t) - length + 1):
            if count[t[i:i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        mask = np.cumsum(gone)[:-1] > 0
        kept = bytes(np.frombuffer(t, dtype=np.uint8)[~mask])
        runs = int((np.diff(np.concatenate(([0], mask.astype(int)))) == 1).sum())
        edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(int), [0])))).reshape(-1, 2)
        spans = ",".join(f"{a}:{b}" for a, b in edges)
        out.append((doc_id, len(t), int(mask.sum()), runs, hashlib.sha256(kept).hexdigest(), spans, len(kept)))
    return sorted(out, key=repr)


def planted():
    rng = random.Random(7)
    base = prose(rng, 900)
    passage = prose(rng, 150)
    texts = [base, base[:1500] + prose(rng, 60) + base[1500:], base[700:2500], base[300:710], base[300:690], prose(rng, 400) + base[-399:], prose(rng, 100) + base[-400:]]
    texts += [prose(rng, rng.randint(1, 90)) + passage[rng.randint(0, 60):] + prose(rng, rng.randint(1, 90)) for _ in range(30)]
    texts += ["ab" * 1000, "a" * 399, "a" * 400, "a" * 401, "a" * 1200, "é" * 600, None, "", "x", base]
    texts += [prose(rng, 150) + passage[:380] + prose(rng, 20) for _ in range(4)]
    return [(i, t, "en", "a", 0, "s", "b", "k") for i, t in enumerate(texts)] + [(None, base[:800], "en", "a", 0, None, None, None), (3, base[100:900], "en", "a", 0, None, None, None)]


@pytest.mark.parametrize("most_contexts", [substrings.MOST_CONTEXTS, 1])
def test_against_all_strings(spark, tmp_path, monkeypatch, most_contexts):
    monkeypatch.setattr(substrings, "MOST_CONTEXTS", most_contexts)
    rows = planted()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    out = substrings.op4_substrings(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "n_kept"]
    assert sorted(map(tuple, out.collect()), key=repr) == by_force(rows)


def test_without_broadcast_and_repeated_rows(spark, docs, rows):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    out = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest(), r["spans"], len(r["kept"])) for r in substrings.remove_repeats(docs, batches=3).collect()]
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(out, key=repr) == by_force(rows)


def test_segments_do_not_show(monkeypatch):
    """Runs of one text cut in segments hold the same strings, each with the same anchor."""
    import pyarrow as pa

    rng = random.Random(1)
    text = prose(rng, 3000).encode()

    def strings():
        batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([5], pa.int64()), "th": pa.array([6], pa.int64()), "text": pa.array([text], pa.binary())})
        rows = [r for b in substrings._entries(iter([batch])) for r in b.to_pylist()]
        bits = substrings.PLACE_BITS
        places = [(r["key"], r["place"] >> 2 * bits, r["place"] >> bits & (1 << bits) - 1, r["place"] & (1 << bits) - 1) for r in rows]
        return {p: (key, at) for key, at, back, more in places for p in range(at - back, at - back + more + 1)}

    whole = strings()
    assert sorted(whole) == list(range(len(text) - substrings.LENGTH + 1))
    monkeypatch.setattr(substrings, "SEGMENT", 1000)
    assert strings() == whole


def test_levels_merge_like_a_counter(spark, docs):
    entries = substrings.stored(substrings.suffix_entries(docs, 8), "test-entries", "batch")
    levels, sizes = [], []
    for b in range(8):
        levels, _ = substrings.add_batch(levels, entries.where(f"batch = {b}"))
        sizes.append([n for n, _ in levels])
    assert sizes == [[1], [2], [2, 1], [4], [4, 1], [4, 2], [4, 2, 1], [8]]


def test_empty_table(no_docs):
    assert substrings.remove_repeats(no_docs).count() == 0


def test_many_rows_of_one_id(spark):
    """Rows of one id and text take no longer than rows with ids of their own."""
    import time

    text = prose(random.Random(11), 1200)
    seconds = []
    for own in (True, False):
        rows = [(i if own else 5, text, "en", "a", 0, "s", "b", "k") for i in range(2000)]
        df = spark.createDataFrame(rows, SCHEMA).repartition(8)
        began = time.perf_counter()
        out = substrings.remove_repeats(df, digest=True).groupBy("n_bytes", "n_removed", "n_spans").count().collect()
        seconds.append(time.perf_counter() - began)
        assert [tuple(r) for r in out] == [(len(text.encode()), len(text.encode()), 1, 2000)]
    assert seconds[1] < 2 * seconds[0] + 5


def test_a_key_stays_whole_beside_one_of_many_contexts(spark, tmp_path, monkeypatch):
    """With a key of many contexts there, those of few are still compared whole, however Spark joins and deals out."""
    monkeypatch.setattr(substrings, "MOST_CONTEXTS", 10)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rng = random.Random(3)
    rows = planted()
    passages = [prose(rng, 110) for _ in range(40)]
    rows += [(100 + i, prose(rng, 60) + passages[i % 40] + prose(rng, 60), "en", "a", 0, "s", "b", "k") for i in range(120)]
    try:
        spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
        out = substrings.op4_substrings(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(map(tuple, out), key=repr) == by_force(rows)


def test_many_contexts_give_few_rows_each(spark, monkeypatch):
    """A context of a key of many gives rows where what it shares begins and ends, not one for each of its strings."""
    monkeypatch.setattr(substrings, "MOST_CONTEXTS", 10)
    rng = random.Random(5)
    passage = prose(rng, 110)
    rows = [(i, prose(rng, 60) + passage + prose(rng, 60), "en", "a", 0, "s", "b", "k") for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    made, plain = spark.sparkContext.accumulator(0), type(df).mapInArrow

    def counted(self, func, *args, **more):
        def each(batches):
            for b in func(batches):
                made.add(b.num_rows)
                yield b

        return plain(self, each, *args, **more)

    monkeypatch.setattr(type(df), "mapInArrow", counted)
    out = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest(), r["spans"], len(r["kept"])) for r in substrings.remove_repeats(df).collect()]
    assert sorted(out, key=repr) == by_force(rows)
    assert made.value < 200 * 80
