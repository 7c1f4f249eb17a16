import random
import re

import numpy as np

from bidstream.llm import neardup
from tests.llm.conftest import SCHEMA, prose


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def by_force(rows):
    """{(doc_id, n_shingles, component_id)} by comparing all pairs."""
    sets = [(r[0], shingles(r[1])) for r in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (i, x) in enumerate(sets):
        for j, y in sets[:k]:
            if i is not None and j is not None and x and y and 100 * len(x & y) >= 75 * len(x | y):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return sorted(((i, len(x), None if i is None else root(i)) for i, x in sets), key=repr)


def compare(df, rows):
    out = neardup.near_duplicates(df).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out), key=repr) == by_force(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)


def test_against_all_pairs(docs, rows):
    # id 2 has two texts and is one node, which the oracle reaches by its id as well
    compare(docs, rows)


def test_chains_and_borderline_pairs(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CHUNK", 4)
    rng, rows = random.Random(4), []
    for g in range(12):
        words = [f"w{g}x{i}" for i in range(120)]
        for _ in range(10):  # a walk: neighbours are near, ends are not
            rows.append(words)
            words = list(words)
            for _ in range(rng.choice([1, 2, 3, 4])):
                words[rng.randrange(len(words))] = f"n{rng.random()}"
    rows = [(i, " ".join(w), "en", "a", 0, None, None, None) for i, w in enumerate(rows)]
    rng.shuffle(rows)
    compare(spark.createDataFrame(rows, SCHEMA), rows)


def test_a_large_group_of_copies(spark):
    rng = random.Random(5)
    base = prose(rng, 150).split()
    rows = []
    for i in range(300):
        words = list(base)
        words[rng.randrange(len(words))] = f"x{i}"
        rows.append((i, " ".join(words), "en", "a", 0, None, None, None))
    rows += [(400 + i, rows[0][1], "en", "a", 0, None, None, None) for i in range(100)]
    compare(spark.createDataFrame(rows, SCHEMA), rows)


def test_hashes_tell_words_apart():
    texts = ["A b\tC", "a B c", "ab c", "a bc", "", " \n", "é É"]
    sets = [neardup.shingle_set(t.encode()).tolist() for t in texts]
    assert sets[0] == sets[1] and sets[0] != sets[2] != sets[3] and sets[4] == sets[5] == [] and len(sets[6]) == 1
    rng = random.Random(0)
    long = prose(rng, 3000)
    assert len(neardup.shingle_set(long.encode())) == len(shingles(long))


def test_posterior_bounds():
    least = neardup.fewest_matches(1e-6)
    assert least[0] == 0 and list(least) == sorted(least)
    rng = np.random.default_rng(0)
    agree = rng.random((20000, neardup.HASHES)) < 0.75
    lost = np.zeros(20000, dtype=bool)
    for n in range(neardup.STEP, neardup.HASHES + 1, neardup.STEP):
        lost |= agree[:, :n].sum(axis=1) < least[n]
    assert lost.mean() < 1e-3


def test_deduplicated_and_empty(docs, no_docs):
    out = neardup.deduplicated_rows(docs)
    assert out.columns == docs.columns
    kept = {r["doc_id"] for r in neardup.near_duplicates(docs).where("kept").select("doc_id").collect()}
    assert {r["doc_id"] for r in out.collect()} == kept
    assert {(r["size"], r["nth"], r["key"]) for r in out.collect()} <= {("s", "b", "k"), (None, None, None)}
    assert neardup.near_duplicates(no_docs).count() == 0 and neardup.deduplicated_rows(no_docs).count() == 0


def test_a_bucket_with_a_large_component_and_a_rest(spark, monkeypatch):
    """Rows of the largest component are compared with the rest in blocks, not with one another."""
    monkeypatch.setattr(neardup, "CHUNK", 8)
    rng = random.Random(6)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(90):
        words = list(base)
        for _ in range(rng.choice([1, 2, 5, 6, 7, 8])):
            words[rng.randrange(len(words))] = f"x{rng.random()}"
        rows.append((i, " ".join(words), "en", "a", 0, None, None, None))
    compare(spark.createDataFrame(rows, SCHEMA), rows)
