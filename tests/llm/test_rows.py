"""Rows of one id: repeated, emptied by line dedup, or with texts that have nothing in common."""

from collections import Counter

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from bidstream.llm import neardup  # noqa: E402
from tests.llm.test_neardup import by_force, shingles  # noqa: E402


def test_texts_of_one_id(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    near = c.replace("c59", "other")
    rows = [(1, a), (1, ""), (2, b), (2, c), (2, c), (3, near), (3, ""), (4, ""), (4, " "), (5, a), (None, a), (None, a)]
    want = Counter({(1, a): 1, (2, b): 1, (2, c): 1, (4, ""): 1, (None, a): 2})
    for parts in (1, 3):
        got = neardup.deduplicated_rows(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()
        assert Counter((r["doc_id"], r["text"].strip()) for r in got) == want


def test_the_longer_of_two_texts_of_an_id_stays(spark):
    rows = [(i, t) for i in range(20) for t in ("", f"some words of {i} that nothing else has {i}{i}")]
    assert all(r["text"] for r in neardup.deduplicated_rows(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_kept_texts_with_repeated_rows_and_ids(spark, docs, rows):
    """The line and near stages over all rows: of each group of texts one stays, that of the least id."""
    lines = corpus_pipeline.line_stage(spark, docs, "").cache()
    texts = sorted({(r["doc_id"], r["text"] or "") for r in lines.collect() if r["doc_id"] is not None and shingles(r["text"])})
    group = {i: c for i, _, c in by_force([(i, t) for i, (_, t) in enumerate(texts)])}
    out = corpus_pipeline.near_stage(spark, lines, "")
    kept = [(r["doc_id"], r["text"]) for r in out.collect()]
    got = Counter(group[texts.index(x)] for x in kept if x in texts)
    assert got == Counter(set(group.values())) and all(i == texts[group[texts.index((i, t))]][0] for i, t in kept if (i, t) in texts)
    assert {"another text of id two", rows_text(rows, 2)} <= {t for i, t in kept if i == 2}
    assert Counter(i for i, _ in kept)[3] == 1 and out.columns == docs.columns


def rows_text(rows, i):
    return next(r[1] for r in rows if r[0] == i and r[1] != "another text of id two")
