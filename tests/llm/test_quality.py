import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from bidstream.llm import quality
from tests.llm.conftest import SCHEMA, prose


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    m = quality.fit([], np.array([]), width=4, gate=3)
    sizes, y = np.array([1, 3, 2]), np.array([1.0, 0.0, 1.0])
    x = rng.normal(size=(6, quality.FEATURES))

    def loss(model):
        p = quality.forward(model, x, sizes)["p"]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    g = quality.gradients(m, x, sizes, y, decay=0)
    for k in m:
        at = tuple(0 for _ in np.shape(m[k]))
        step = np.zeros(np.shape(m[k]))
        step[at] = 1e-6
        assert abs((loss(m | {k: m[k] + step}) - loss(m | {k: m[k] - step})) / 2e-6 - np.asarray(g[k])[at]) < 1e-6


def test_passages_cover_the_whole_text():
    assert quality.passages(None).shape == quality.passages(" \n").shape == (1, quality.FEATURES)
    assert len(quality.passages("a " * 6401)) == 101
    x = quality.passages("Aa 1. é\n" + "b " * 70)
    assert x.shape[0] == 2 and np.isfinite(x).all() and np.allclose(x[:, : quality.CLASSES].sum(axis=1), 1)


def labelled(spark, n=600):
    rng, rows, marks = random.Random(3), [], []
    for i in range(n):
        good = rng.random() < 0.8
        text = prose(rng, rng.choice([20, 100, 400]))
        text = text if good else rng.choice([text.upper() + "!!", " ".join(w + "###" for w in text.split()), (text.split(" ")[0] + " ") * 80])
        rows.append((i, text, "en", "a", len(text), None, None, None))
        marks.append((i, int(good)))
    rows += [(n, None, None, None, 0, None, None, None), (n + 1, "", None, None, 0, None, None, None), (None, "x", None, None, 0, None, None, None), rows[0]]
    marks += [(None, 1), (5, None), (10**9, 0)]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(marks, "doc_id long, quality int")


def test_held_out_accuracy(spark, tmp_path):
    docs, marks = labelled(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    marks.write.parquet(f"{tmp_path}/labels.parquet")
    out = quality.op6_quality(spark, str(tmp_path))
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and out.count() == docs.count()
    found = out.join(marks, "doc_id").where("held_out and quality is not null").collect()
    assert {r["held_out"] for r in found} == {True} and all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in found)
    assert np.mean([r["predicted"] == r["quality"] for r in found]) > 0.95
    assert out.where("score is null or score < 0 or score > 1 or predicted != int(score >= 0.3)").count() == 0


def test_labels_of_held_out_rows_play_no_part(spark):
    docs, marks = labelled(spark, 120)
    other = marks.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.train(docs, marks), quality.train(docs, other)
    assert all(np.array_equal(a[k], b[k]) for k in a)


def test_no_rows_and_no_labels(spark, no_docs):
    docs, marks = labelled(spark, 20)
    assert quality.classify(no_docs, marks).count() == 0
    out = quality.classify(docs, marks.limit(0)).agg(F.min("quality_score"), F.max("quality_score")).first()
    assert tuple(out) == (0.5, 0.5)
