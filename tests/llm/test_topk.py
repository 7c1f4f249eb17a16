import math

import numpy as np
import pytest
from pyspark.sql import types as T

from bidstream.llm import topk

SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("score", T.StringType()),
])


def by_force(rows, queries, k=5):
    whole = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v, _ in rows
             if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for q, x in {i: x for i, x in whole if i in queries}.items():
        scores = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in whole if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


def vectors(n=700, dims=8, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims)) * 2
    rows = [(i, (centres[i % 6] + rng.normal(size=dims) * 0.3).tolist(), "x") for i in range(n)]
    rows += [(n + i, rows[3][1], "x") for i in range(200)]  # one vector many times
    rows += [(5000, None, "x"), (5050, [1.0, None] + [0.0] * (dims - 2), "x"), (5100, [float("nan")] * dims, "x"), (5150, [float("inf")] + [0.0] * (dims - 1), None)]
    rows += [(5200, [0.0] * dims, "x"), (5250, [1.0, -1.0], "x"), (5300, [], "x"), (None, [1.0] * dims, "x"), (5350, [300.0] * dims, "x")]
    return rows


@pytest.mark.parametrize("block, queries", [(topk.BLOCK, topk.QUERIES), (16, 8)])
def test_against_all_pairs(spark, monkeypatch, block, queries):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "QUERIES", queries)
    rows = vectors()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = topk.top_k(df, df.where("vec_id % 50 = 0"), pivots=7)
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, out.collect())) == by_force(rows, {i for i, *_ in rows if i is not None and i % 50 == 0})


def test_few_rows(spark):
    rows = [(0, [1.0], "x"), (1, [2.0], "x"), (2, [2.0], "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, topk.top_k(df, df.where("vec_id = 0")).collect())) == [(0, 1, 1, 256 * 512), (0, 2, 2, 256 * 512)]
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0
    assert topk.top_k(df, df.limit(0)).count() == 0


def test_large_products_are_exact():
    a = np.array([[2**30, 3]]), np.array([[2**31, 5]])
    assert topk.products(*a).tolist() == [[2**61 + 15]]
