"""Clusters around centroids of whole vectors, each vector's nearest found by partial-distance search.

Squared differences are added up over blocks of dimensions, those of the highest variance first. All centroids are
compared over the first block; the one that is nearest there is measured in full and gives a bound. Of the others a
centroid is abandoned for a vector as soon as its sum is strictly above the bound, and what survives all blocks, a tie
included, has its full distance. All sums are of whole numbers, so an abandoned centroid can be neither nearest nor tied.

A round is one scan: each task sums its own vectors by cluster, Spark adds up these sums, and the new centroids, of a
number and a size that are fixed, go out with the next scan's function.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidstream.llm.common import stored

SCALE, DIMS = 64, 64
#: Dimensions that are added up before centroids are abandoned again.
BLOCK = 8
#: Vectors that are compared at once, in a task.
ROWS = 4096
#: Components up to this have squared distances of 64 dimensions that fit in a long.
LARGEST = 1 << 27


def kept_vectors(vectors: DataFrame, dims: int = DIMS) -> DataFrame:
    """(vec_id, v) of vectors that have `dims` components, none of them null or not finite."""
    v = F.col("embedding")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.where(v.isNotNull() & (F.size(v) == dims)).where(~bad).select(F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<double>").alias("v"))


def whole(column: pa.Array, dims: int, scale: int) -> np.ndarray:
    """floor(scale * component) of a batch's vectors, a row for each."""
    x = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False)).reshape(-1, dims)
    if len(x) and np.abs(x).max() > LARGEST:
        raise ValueError(f"components above {LARGEST} after scaling have distances that no long holds")
    return x.astype(np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest centroid, ties to the smaller number, and the squared distance.

    order: the dimensions, in the order in which they are added up.
    """
    x, centroids = x[:, order], centroids[:, order]
    parts = [slice(i, i + block) for i in range(0, x.shape[1], block)]

    def far(rows: np.ndarray, c: int, part: slice) -> np.ndarray:
        d = x[rows, part] - centroids[c, part]
        return np.einsum("ij,ij->i", d, d)

    every = np.arange(len(x))
    partial = np.stack([far(every, c, parts[0]) for c in range(len(centroids))], axis=1)
    best = partial.argmin(axis=1)
    rest = x[:, block:] - centroids[best, block:]
    bound = partial[every, best] + np.einsum("ij,ij->i", rest, rest)
    guess = best.copy()
    for c in range(len(centroids)):
        alive = np.flatnonzero((guess != c) & (partial[:, c] <= bound))
        total = partial[alive, c]
        for part in parts[1:]:
            total = total + far(alive, c, part)
            still = total <= bound[alive]
            alive, total = alive[still], total[still]
        better = (total < bound[alive]) | (c < best[alive])  # a tie goes to the smaller number
        best[alive[better]], bound[alive[better]] = c, total[better]
    return best, bound


_SUMS_SQL = "cluster int, dim int, n long, total long, squares double"


def _sums(kept: DataFrame, dims: int, scale: int, centroids: np.ndarray | None, order: np.ndarray | None) -> DataFrame:
    """(cluster, dim, n, total, squares): sums of the components of each cluster; without centroids all is one cluster."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = 1 if centroids is None else len(centroids)
        n, total, squares = np.zeros(k, dtype=np.int64), np.zeros((k, dims), dtype=np.int64), np.zeros((k, dims))
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                x = whole(batch.column(1).slice(i, ROWS), dims, scale)
                c = np.zeros(len(x), dtype=np.int64) if centroids is None else nearest(x, centroids, order)[0]
                n += np.bincount(c, minlength=k)
                for j in np.unique(c):
                    total[j] += x[c == j].sum(axis=0)
                    if centroids is None:
                        squares[j] += (x[c == j].astype(float) ** 2).sum(axis=0)
        at = np.repeat(np.arange(k)[n > 0], dims)
        yield pa.RecordBatch.from_pydict({
            "cluster": pa.array(at, pa.int32()), "dim": pa.array(np.tile(np.arange(dims), (n > 0).sum()), pa.int32()), "n": pa.array(n[at], pa.int64()),
            "total": pa.array(total[n > 0].ravel(), pa.int64()), "squares": pa.array(squares[n > 0].ravel(), pa.float64()),
        })

    parts = kept.mapInArrow(summed, _SUMS_SQL)
    # a task may give its sums, as one row for each cluster and dimension; totals beyond a long are added up as decimals
    return parts.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("squares").alias("squares"))


def by_variance(kept: DataFrame, dims: int, scale: int) -> np.ndarray:
    """The dimensions by falling variance over all vectors; ties by number."""
    rows = _sums(kept, dims, scale, None, None).collect()  # one row for each dimension
    variance = np.zeros(dims)
    for r in rows:
        variance[r["dim"]] = r["squares"] / r["n"] - (float(r["total"]) / r["n"]) ** 2
    return np.argsort(-variance, kind="stable")


def first_centroids(kept: DataFrame, clusters: int, dims: int, scale: int, seed: int) -> np.ndarray:
    """The vectors whose ids hash lowest, in order of the hash; rows of one id by their components."""
    named = kept.withColumn("hash_", F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256))
    # ids are ranked without their vectors, which are fetched for the few that come first
    last = [r["hash_"] for r in named.select("hash_").distinct().orderBy("hash_").limit(clusters).collect()]
    if not last:
        return np.zeros((0, dims), dtype=np.int64)
    few = named.where(F.col("hash_").isin(last)).select("hash_", "v").orderBy("hash_", "v").limit(clusters).collect()
    return np.array([np.floor(scale * np.array(r["v"])).astype(np.int64) for r in few]).reshape(-1, dims)


def moved(kept: DataFrame, centroids: np.ndarray, order: np.ndarray, scale: int) -> np.ndarray:
    """Centroids after a round: floor(sum / count) of their vectors; a centroid without any stays."""
    out = centroids.copy()
    for r in _sums(kept, centroids.shape[1], scale, centroids, order).collect():  # a row for each centroid and dimension
        out[r["cluster"], r["dim"]] = int(r["total"]) // r["n"]
    return out


def cluster(vectors: DataFrame, clusters: int = 16, rounds: int = 3, dims: int = DIMS, scale: int = SCALE, seed: int = 1) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid): a row for each vector with `dims` components.

    Components x become floor(scale * x). Null vectors, those of another length or with null or non-finite components give no
    row. Centroids start as the vectors whose ids hash lowest, a null id as an empty one; fewer vectors than `clusters` give fewer.
    Rows that repeat, or share an id, are vectors of their own. Ties go to the smaller number. Other columns do no harm, and an empty table gives no
    rows. A component above 2 ** 27 after scaling is an error, for its distances would not fit in a long.
    """
    spark = vectors.sparkSession
    kept = kept_vectors(vectors, dims)
    centroids = first_centroids(kept, clusters, dims, scale, seed)
    schema = "vec_id long, cluster int, distance long"
    if not len(centroids):
        return spark.createDataFrame([], f"{schema}, cluster_inertia long, inertia long, centroid array<long>")
    order = by_variance(kept, dims, scale)
    for _ in range(rounds):
        centroids = moved(kept, centroids, order, scale)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                c, d = nearest(whole(part.column(1), dims, scale), centroids, order)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(c, pa.int32()), pa.array(d, pa.int64())], names=["vec_id", "cluster", "distance"])

    rows = stored(kept.mapInArrow(assigned, schema), "clusters")
    inertia = {r["cluster"]: r["s"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # a row for each cluster
    total = sum(inertia.values())
    facts = spark.createDataFrame(
        [(c, s, total, centroids[c].tolist()) for c, s in sorted(inertia.items())], "cluster int, cluster_inertia long, inertia long, centroid array<long>"
    )
    return rows.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    text = F.array_join(F.transform("centroid", lambda x: x.cast("string")), ",")
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(text.cast("binary"), 256).alias("centroid_sha256"))


def _sql(clusters: int = 16, rounds: int = 3) -> str:
    parts = [f"""
WITH v AS (
  SELECT row_number() OVER () AS i, vec_id, [floor({SCALE} * c::DOUBLE)::BIGINT FOR c IN embedding] AS x FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id::VARCHAR)) - 1 AS cluster, x AS c FROM v QUALIFY cluster < {clusters}
)"""]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS (
  SELECT i, vec_id, x, cluster, list_sum([(x[k] - c[k]) * (x[k] - c[k]) FOR k IN range(1, {DIMS + 1})])::BIGINT AS distance FROM v, c{r}
  QUALIFY row_number() OVER (PARTITION BY i ORDER BY distance, cluster) = 1
)""")
        if r < rounds:
            parts.append(f"""m{r} AS (
  SELECT cluster, list(floor_of ORDER BY k) AS m FROM (
    SELECT cluster, k, (total - ((total % n) + n) % n) // n AS floor_of FROM (SELECT cluster, k, sum(x[k])::BIGINT AS total, count(*) AS n FROM a{r}, range(1, {DIMS + 1}) AS t(k) GROUP BY ALL)
  ) GROUP BY cluster
), c{r + 1} AS (SELECT cluster, coalesce(m, c) AS c FROM c{r} LEFT JOIN m{r} USING (cluster))""")
    return ", ".join(parts) + f"""
SELECT vec_id, cluster::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (cluster)
"""


OP12_SQL = _sql()
