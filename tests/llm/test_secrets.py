import hashlib
import re

from pyspark.sql import functions as F

from bidstream.llm import secrets
from tests.llm.conftest import SCHEMA

KINDS = (
    ("assign", re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
)


def base_spans(text):
    found = [(m.start(), k, m.end(), kind) for k, (kind, pattern, ok) in enumerate(KINDS) for m in pattern.finditer(text or "") if ok(m)]
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found))


def test_base_spans_are_those_of_the_patterns(docs, rows):
    found = secrets.find_secrets(docs).select("doc_id", secrets._listed("base").alias("base")).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(((r[0], base_spans(r[1])) for r in rows), key=repr)


def test_the_models_add_spans_and_leave_words_alone(docs, rows):
    found = {r["doc_id"]: r for r in secrets.find_secrets(docs).collect()}
    text = {r[0]: r[1] for r in rows}
    marked = [(i, text[i][s["start"]:s["end"]]) for i, r in found.items() for s in r["spans"] if s["kind"] == "markov"]
    assert [t for _, t in marked] == ["kX9vQ2mZ7pL4tR8wB3nY6"]
    assert all(set(map(tuple, r["base"])) <= set(map(tuple, r["spans"])) for r in found.values())


def test_query_columns_and_empty_table(spark, docs, no_docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = secrets.op1_secrets(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    none = out.where("spans = ''").agg(F.collect_set("base_sha256")).first()[0]
    assert none == [hashlib.sha256(b"").hexdigest()]
    assert secrets.find_secrets(no_docs).count() == 0


def test_long_text_and_repeats(spark):
    long = ("word " * 30000 + "AKIA" + "Z" * 16 + " ") * 3
    rows = [(1, long, "en", "a", 1, None, None, None)] * 2
    found = secrets.find_secrets(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [[s["start"] for s in r["base"]] for r in found] == [[150000, 300021, 450042]] * 2


def test_added_spans_on_held_out_strings(spark, docs):
    """Random strings and names that the models were not trained on: most of the former are found, few of the latter."""
    import random
    import string

    rng = random.Random(11)
    secret = ["".join(rng.choice(string.ascii_letters + string.digits) for _ in range(rng.randint(20, 40))) for _ in range(300)]
    words = "billing shipment vendor tender bridge harbour schedule employee department tracking warehouse rental catalogue weather forecast station".split()
    plain = [f"{a}{b.title()}{c.title()}" if i % 2 else f"{a}_{b}_{c}_{rng.randrange(100)}" for i in range(300) for a, b, c in [rng.sample(words, 3)]]
    rows = [(i, f"use {t} here", "en", "a", 0, None, None, None) for i, t in enumerate(secret + plain)]
    more = docs.unionByName(spark.createDataFrame([(10_000 + r[0], *r[1:]) for r in rows], SCHEMA))
    found = {r["doc_id"] for r in secrets.find_secrets(more).collect() if any(s["kind"] == "markov" for s in r["spans"])}
    hits, wrong = sum(10_000 + i in found for i in range(300)), sum(10_300 + i in found for i in range(300))
    assert hits / 300 > 0.9 and wrong / 300 < 0.02, (hits, wrong)


def test_words_after_the_two_hundredth_train_too(spark):
    """The sample takes whole texts."""
    text = " ".join(["aaa"] * 400 + ["zebra", "quagga"])
    docs = spark.createDataFrame([(1, text, "en", "a", 0, None, None, None)], SCHEMA)
    assert {r["token"] for r in secrets.labelled_samples(docs, 10).where("secret = 0 and token like '%quagga%'").collect()}
