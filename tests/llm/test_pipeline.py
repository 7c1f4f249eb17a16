from collections import Counter

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from bidstream.llm import mixing, quality  # noqa: E402
from tests.llm import test_lines, test_neardup, test_packing  # noqa: E402
from tests.llm.conftest import SCHEMA  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, rows, tmp_path_factory):
    """The rows that go into each stage, and what comes out of the last."""
    top = str(tmp_path_factory.mktemp("pipeline"))
    marks = [(r[0], int(r[0] % 7 > 0)) for r in rows if r[0] is not None]
    spark.createDataFrame([r for r in rows if r[0] != 2], SCHEMA).select(*COLUMNS).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int").write.parquet(f"{top}/labels.parquet")
    docs, out = spark.read.parquet(f"{top}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out.append(docs.collect())
        stage(spark, docs, top).write.parquet(f"{top}/{i}")
        docs = spark.read.parquet(f"{top}/{i}")
    return top, out, docs.collect()


def test_columns(stages):
    assert all(list(r.asDict()) == COLUMNS for rows in stages[1] for r in rows)


def test_quality_keeps_what_it_predicts(spark, stages):
    top, (docs, kept, *_), _ = stages
    source = spark.read.parquet(f"{top}/documents.parquet")
    want = quality.classify(source, spark.read.parquet(f"{top}/labels.parquet")).where("quality_score >= 0.3").select(*COLUMNS).collect()
    assert Counter(map(repr, kept)) == Counter(map(repr, want)) and 0 < len(kept) <= len(docs)


def test_lines_against_brute_force(stages):
    _, (_, docs, rest, *_), _ = stages
    import hashlib
    want = Counter((r[0], r[-1]) for r in test_lines.by_force([tuple(r) for r in docs]))
    assert Counter((r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in rest) == want
    assert all(r["n_chars"] == len(r["text"]) for r in rest if r["text"] is not None)


def test_one_of_each_group_stays(stages):
    _, (_, _, docs, kept, *_), _ = stages
    component = {i: c for i, _, c in test_neardup.by_force([tuple(r) for r in docs])}
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == sorted({c for c in component.values() if c is not None})
    assert sum(r["doc_id"] is None for r in kept) == sum(r["doc_id"] is None for r in docs)


def test_the_mix_takes_effect(spark, stages):
    top, (_, _, _, docs, mixed), _ = stages
    want = mixing.mix(spark.read.parquet(f"{top}/2")).collect()
    taken = Counter()
    for r in want:
        taken[r["doc_id"]] += r["copies"]
    assert Counter(r["doc_id"] for r in mixed) == +taken and {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in docs}


def test_packing_takes_all(stages):
    _, (*_, docs), pieces = stages
    texts = {r["doc_id"]: r["text"] for r in docs}
    once = Counter(r["doc_id"] for r in docs)
    from tokenizers import Tokenizer
    import public_tokenizers
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    n = {i: len(t.encode(x or "", add_special_tokens=False).ids) + 1 for i, x in texts.items()}
    got = Counter()
    for p in pieces:
        got[p["doc_id"]] += p["length"]
        assert p["doc_tokens"] == n[p["doc_id"]]
    assert got == Counter({i: n[i] * k for i, k in once.items()})
    assert test_packing.padded(2048) == 0


def test_run_gives_the_same_rows(spark, stages):
    top, _, pieces = stages
    run = corpus_pipeline.run(spark, top).collect()
    assert sum(r["length"] for r in run) == sum(r["length"] for r in pieces)


def test_all_stages_of_an_empty_table(spark, no_docs, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, no_docs, str(tmp_path))
        assert out.count() == 0, name
        assert name == corpus_pipeline.STAGES[-1][0] or out.columns == no_docs.columns
