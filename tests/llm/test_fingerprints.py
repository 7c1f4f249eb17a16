import hashlib

import xxhash
from pyspark.sql import functions as F

from bidstream.llm import fingerprints as fp
from tests.llm.conftest import SCHEMA, collected


def edited_texts(rows):
    """(doc_id, chars, digest of the edited text) for each row, by the definition."""
    signed = lambda t: (xxhash.xxh64(t, seed=42).intdigest() + (1 << 63)) % (1 << 64)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), signed((r[1] or "").encode()) if r[0] is None else 0, (r[1] or "").encode()))
    out = []
    for i, r in enumerate(order):
        text, after = r[1] or "", order[(i + 1) % len(order)][1] or ""
        third = len(text) // 3
        new = text[: len(text) - third] + after[:third]
        out.append((r[0], len(text), hashlib.sha256(new.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_edited_texts(docs, rows):
    assert collected(fp.fingerprints(docs), "doc_id", "n_chars", "edited_sha256") == edited_texts(rows)


def test_blocks_do_not_show(spark, rows, monkeypatch):
    # outlying and clustered ids, and many rows of none
    few = rows + [(i, f"text {i} of more words\n{i}", *rows[0][2:]) for i in (-(1 << 63), (1 << 63) - 1, 1 << 60)] + [(None, f"none {i}", *rows[0][2:]) for i in range(40)]
    df = spark.createDataFrame(few, SCHEMA)
    one = collected(fp.fingerprints(df), "doc_id", "edited_sha256", "fingerprint", "near_next")
    whole = fp.with_neighbours
    monkeypatch.setattr(fp, "with_neighbours", lambda d: whole(d, rows_a_block=3))
    assert collected(fp.fingerprints(df), "doc_id", "edited_sha256", "fingerprint", "near_next") == one
    assert collected(fp.fingerprints(df), "doc_id", "n_chars", "edited_sha256") == edited_texts(few)


def test_sums_do_not_depend_on_order_and_can_be_updated(spark):
    a, b, c = "one two three four", "five six seven", "eight nine ten eleven"
    df = spark.createDataFrame([(i, t, None, None, 0, None, None, None) for i, t in enumerate([f"{a}\n{b}", f"{b}\n{a}", f"{a}\n{b}\n{c}", c, f"{a}\n{b}"])], SCHEMA)
    prints = {r["doc_id"]: r["fingerprint"] for r in fp.fingerprints(df).collect()}
    assert prints[0] == prints[1] == prints[4] != prints[2]

    def lanes(x):
        head, rest = fp.EQUAL_LANES * fp.EQUAL_BITS // 4, fp.LIKE_BITS // 4
        return [(int(x[i:i + 8], 16), 1 << 32) for i in range(0, head, 8)] + [(int(x[i:i + rest], 16), 1 << fp.LIKE_BITS) for i in range(head, len(x), rest)]

    v = {r["doc_id"]: r["v"] for r in fp.text_vectors(df.select("doc_id", F.col("text").alias("t")), ["doc_id"]).collect()}
    pair = spark.createDataFrame([(v[0], v[2], v[3])], "a struct<equal: array<bigint>, like: array<bigint>>, b struct<equal: array<bigint>, like: array<bigint>>, c struct<equal: array<bigint>, like: array<bigint>>")
    got = pair.select(fp.added(F.col("a"), F.col("c")).alias("more"), fp.removed(F.col("b"), F.col("c")).alias("less")).first()
    assert got["more"] == v[2] and got["less"] == v[0] == v[1]
    assert [(p + q) % m for (p, m), (q, _) in zip(lanes(prints[0]), lanes(prints[3]))] == [v for v, _ in lanes(prints[2])]


def test_likeness(spark, docs):
    text = " ".join(f"w{i}" for i in range(900))
    other = " ".join(f"v{i}" for i in range(900))
    df = spark.createDataFrame([(3, text, None, None, 0, None, None, None), (2, other, None, None, 0, None, None, None), (1, other, None, None, 0, None, None, None)], SCHEMA)
    out = {r["doc_id"]: r for r in fp.fingerprints(df).collect()}
    assert abs(out[3]["near_edited"] - 2 / 3) < 0.2 and out[3]["near_next"] < 0.3
    assert out[2]["near_next"] == 1.0 and out[2]["fingerprint"] == out[1]["fingerprint"]
    assert fp.fingerprints(docs).where("near_edited < 0 or near_edited > 1 or near_next < 0 or near_next > 1 or near_edited is null").count() == 0


def test_empty_single_and_null_ids(spark, no_docs):
    assert fp.fingerprints(no_docs).count() == 0
    alone = fp.fingerprints(spark.createDataFrame([(None, "abcdef", None, None, 0, None, None, None)], SCHEMA)).collect()
    assert [(r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_next"]) for r in alone] == [(None, 6, hashlib.sha256(b"abcdab").hexdigest(), 1.0)]
    gap = spark.createDataFrame([(i * 10**15, f"text {i}", None, None, 0, None, None, None) for i in (0, 1, 9000)], SCHEMA)
    assert fp.fingerprints(gap).agg(F.count("edited_sha256")).first()[0] == 3
