import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bidstream.llm import passages
from tests.llm.conftest import SCHEMA, prose

LAST = 1 << 63


def by_force(rows, width):
    """(id, words, removed, kept, spans) of rows (doc_id, text ..); a null id comes last."""
    split = [(LAST if i is None else i, (t or "").encode().split()) for i, t, *_ in rows]
    first = {}
    for i, w in split:
        for a in range(len(w) - width + 1):
            key = tuple(w[a : a + width])
            first[key] = min(i, first.get(key, i))
    out = []
    for (i, w), row in zip(split, rows, strict=True):
        gone = np.zeros(len(w), dtype=bool)
        for a in range(len(w) - width + 1):
            if first[tuple(w[a : a + width])] < i:
                gone[a : a + width] = True
        edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(int), [0])))).reshape(-1, 2).tolist()
        out.append((row[0], len(w), int(gone.sum()), b" ".join(x for x, g in zip(w, gone) if not g), edges))
    return sorted(out, key=repr)


def result(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], bytes(r["kept"]), [[s["start"], s["stop"]] for s in r["spans"]]) for r in df.collect()), key=repr)


def planted(width=50):
    rng = random.Random(5)
    base, passage = prose(rng, 700), prose(rng, 2 * width).split()
    w = base.split()
    texts = [base, base, " ".join(w[:200]) + " " + prose(rng, 30) + "\n" + " ".join(w[200:]), " ".join(w[100:400]), " ".join(w[: width]), " ".join(w[: width - 1])]
    texts += [prose(rng, rng.randint(1, 90)) + " " + " ".join(passage[rng.randint(0, 20):]) + "  \t" + prose(rng, rng.randint(1, 90)) for _ in range(30)]
    texts += ["a " * n for n in (width - 1, width, width + 1, 4 * width)] + ["x " + "a " * 60 + "y", "a b " * 80, "b a " * 80, "a b c " * 70, "a\x1cb " * 90, "a\xa0b " * 70, None, "", " \n", "x"]
    texts += [base.upper(), prose(rng, 60) * 4]
    return [(i, t, "en", "a", 0, "s", "b", "k") for i, t in enumerate(texts)] + [
        (None, base, "en", "a", 0, None, None, None), (None, prose(rng, 20) + " " + base, "en", "a", 0, None, None, None), (3, base, "en", "a", 0, None, None, None), (3, base, "en", "a", 0, None, None, None)]


@pytest.mark.parametrize("width, rounds", [(50, passages.ROUNDS), (50, 0), (7, 2), (50, 9), (1, 1)])
def test_against_all_windows(spark, docs, rows, width, rounds):
    every = planted() + rows
    df = spark.createDataFrame(every, SCHEMA).repartition(3)
    assert result(passages.dedup_passages(df, words=width, rounds=rounds)) == by_force(every, width)


def test_without_broadcast_in_small_segments(spark, monkeypatch, docs, rows):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    out = result(passages.dedup_passages(docs))
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert out == by_force(rows, 50)


def test_digest(spark, tmp_path):
    rows = planted()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    out = passages.op13_passages(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(((i, n, r, hashlib.sha256(k).hexdigest()) for i, n, r, k, _ in by_force(rows, 50)), key=repr)


def test_empty_table(no_docs):
    assert passages.dedup_passages(no_docs).count() == 0


def keys_of(text, width, rounds):
    """The key, and how far in the window its name begins, of each window."""
    h1, h2, begins = passages.batch_hashes([text])
    starts = np.arange(len(h1) - width + 1)
    key, _, first, back, more = passages.contexts(h1, h2, starts, width, rounds)
    return [(int(k), int(b - j)) for k, b, m in zip(key, back, more) for j in range(m + 1)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abc"), min_size=12, max_size=40), st.lists(st.sampled_from("abc"), max_size=20), st.lists(st.sampled_from("abc"), max_size=20), st.integers(0, 6))
def test_a_window_has_its_key_wherever_it_stands(words, before, after, rounds):
    width = 12
    alone = keys_of(" ".join(words).encode(), width, rounds)
    inside = keys_of(" ".join(before + words + after).encode(), width, rounds)
    assert inside[len(before) : len(before) + len(alone)] == alone


def test_segments_and_pieces_do_not_show(monkeypatch):
    import pyarrow as pa

    rng = random.Random(2)
    texts = [prose(rng, n).encode() for n in (3000, 10, 49, 50, 51, 700)] + [b"", b"word" * 700, prose(rng, 400).encode()]

    def windows():
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array([1] * len(texts), pa.int64()), pa.array(texts, pa.binary())], names=["ord", "th", "text"])
        out, bits = {}, passages.PLACE_BITS
        for b in passages._entries(iter([batch]), 50, passages.ROUNDS):
            for r in b.to_pylist():
                at, back, more = r["place"] >> 2 * bits, r["place"] >> bits & (1 << bits) - 1, r["place"] & (1 << bits) - 1
                out |= {(r["ord"], at - back + j): (r["key"], at) for j in range(more + 1)}
        return out

    whole = windows()
    assert len(whole) == sum(max(0, len(t.split()) - 49) for t in texts)
    monkeypatch.setattr(passages, "SEGMENT", 100)
    monkeypatch.setattr(passages, "PIECE", 300)
    assert windows() == whole
