import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import types as T

from bidstream.llm import clusters

SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("cluster", T.StringType()),
])
NAMES = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]


def by_force(rows, k=16, rounds=3, dims=64):
    kept = [(i, [math.floor(64 * float(np.float32(c))) for c in v]) for i, v, _ in rows
            if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [x for _, x in first[:k]]

    def assigned():
        return [min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centroids)) for _, x in kept]

    for _ in range(rounds):
        near = [j for _, j in assigned()]
        for j in range(len(centroids)):
            own = [x for (_, x), n in zip(kept, near) if n == j]
            if own:
                centroids[j] = [sum(c) // len(own) for c in zip(*own)]
    final = assigned() if kept else []
    inertia = sum(d for d, _ in final)
    return sorted(((i, j, d, sum(e for e, n in final if n == j), inertia, centroids[j]) for (i, _), (d, j) in zip(kept, final)), key=repr)


def vectors(n=300, dims=64, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, dims)) * 2
    spread = np.linspace(0.1, 2, dims)
    rows = [(i, (centres[i % 9] + rng.normal(size=dims) * spread).tolist(), "x") for i in range(n)]
    rows += [(n + i, rows[5][1], "x") for i in range(60)] + [rows[7], rows[7], (7, rows[8][1], "x")]  # one vector many times, rows and ids that repeat
    rows += [(900 + i, [float(i % 2)] * dims, "x") for i in range(8)]  # ties
    rows += [(1000, None, "x"), (1001, [1.0, None] + [0.0] * (dims - 2), "x"), (1002, [float("nan")] * dims, "x"), (1003, [float("-inf")] + [0.0] * (dims - 1), None)]
    return rows + [(1004, [], "x"), (1005, [1.0] * (dims - 1), "x"), (1006, [1.0] * (dims + 1), "x"), (None, rows[9][1], "x"), (None, rows[10][1], "x")]


@pytest.mark.parametrize("seed", [3, 4])
def test_against_plain_rounds(spark, seed):
    rows = vectors(seed=seed)
    out = clusters.cluster(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert out.columns == NAMES
    got = sorted((tuple(r) for r in out.collect()), key=repr)
    assert got == by_force(rows)


def test_digest(spark, tmp_path):
    spark.createDataFrame(vectors(40), SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = clusters.op12_clusters(spark, str(tmp_path))
    assert out.columns == NAMES[:5] + ["centroid_sha256"]
    got = {(r["vec_id"], r["cluster"], r["centroid_sha256"]) for r in out.collect()}
    assert got == {(i, j, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, j, *_, c in by_force(vectors(40))}


def test_few_and_no_vectors(spark):
    rows = [(i, [i / 8] * 64, "x") for i in range(5)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted((tuple(r) for r in clusters.cluster(df).collect()), key=repr) == by_force(rows)
    assert clusters.cluster(df.limit(0)).count() == 0
    assert clusters.cluster(spark.createDataFrame([(1, None, "x")], SCHEMA)).columns == NAMES


@pytest.mark.parametrize("block", [1, 5, 8, 64])
def test_abandoning_changes_nothing(block):
    rng = np.random.default_rng(block)
    x, c = rng.integers(-3, 4, (500, 64)), rng.integers(-3, 4, (16, 64))
    c[9] = c[2]  # a tie wherever either is nearest
    far = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
    best, bound = clusters.nearest(x, c, rng.permutation(64), block)
    assert (best == far.argmin(axis=1)).all() and (bound == far.min(axis=1)).all() and 9 not in best


def test_huge_components_are_an_error(spark):
    df = spark.createDataFrame([(1, [1e30] * 64, "x")], SCHEMA)
    with pytest.raises(Exception, match="no long holds"):
        clusters.cluster(df).collect()
