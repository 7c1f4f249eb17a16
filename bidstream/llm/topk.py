"""Exact top-k search by inner product over a pivot-distance index.

A vector x gets one more component, so that all have the length of the longest: then the largest inner product with a
query (whose further component is 0) is the least distance. Each vector is keyed by its nearest pivot and its distance
to that; a pivot's vectors fall into annuli of rising distance, and an annulus into blocks of bounded size. A query
starts in the block that holds it, whose best scores bound its k-th best from below, and then visits only annuli
that may hold a score as high: by the triangle inequality none of an
annulus's vectors is nearer to the query than the query's distance to the pivot lies outside the annulus. Scores are inner products of whole numbers, so they and their ties are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bidstream.llm.common import bounded_batches, lowest_hashes, stored

SCALE = 256
#: Vectors in a block, on average; queries that meet a block at once; pivots and annuli of a pivot, at most.
BLOCK, QUERIES, PIVOTS, ANNULI = 2048, 4096, 256, 64
#: Queries whose visits are listed at once.
LISTED = 64

_HITS = "query_id long, vec_id long, score long"


def whole_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, x): floor(scale * component), of vectors without null, NaN or infinite components."""
    bad = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    x = F.transform("embedding", lambda c: F.floor(scale * c.cast("double")))
    return vectors.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & ~bad).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def _matrix(column: pd.Series, dims: int) -> np.ndarray:
    """Rows of whole numbers; shorter vectors are filled up with zeros."""
    out = np.zeros((len(column), dims), dtype=np.int64)
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole vectors, by floating point where that is exact."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64) if top < 2**53 else a @ b.T


def choose_pivots(vectors: DataFrame, n: int, count: int, most: int, dims: int, longest: float, seed: int = 7) -> np.ndarray:
    """Means of `count` clusters of at most `most` of the `n` vectors, those that hash lowest, with the further component."""
    rows = lowest_hashes(vectors, F.xxhash64("vec_id", "x"), most, n).orderBy("vec_id", "x").toPandas()
    x = _lengthened(_matrix(rows["x"], dims), longest)
    rng = np.random.default_rng(seed)
    pivots = x[rng.choice(len(x), min(count, len(x)), replace=False)]
    for _ in range(5):
        near = _distances(x, pivots).argmin(axis=1)
        sums, n = np.zeros_like(pivots), np.bincount(near, minlength=len(pivots))
        np.add.at(sums, near, x)
        pivots = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], pivots)
    return pivots


def _lengthened(x: np.ndarray, longest: float) -> np.ndarray:
    x = x.astype(np.float64)
    return np.column_stack([x, np.sqrt(np.maximum(longest - (x * x).sum(axis=1), 0))])


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def _best(ids: np.ndarray, q_ids: np.ndarray, scores: np.ndarray, k: int) -> pd.DataFrame:
    """Each query's k best of a block, without itself, ties to the smaller id."""
    out = []
    for i, q in enumerate(q_ids):
        s = scores[i]
        pick = np.flatnonzero(ids != q)
        if len(pick) > k:  # all that are as good as the k-th
            pick = pick[s[pick] >= np.partition(s[pick], len(pick) - k)[len(pick) - k]]
        pick = pick[np.lexsort((ids[pick], -s[pick]))][:k]
        out.append((np.full(len(pick), q), ids[pick], s[pick]))
    a, b, c = (np.concatenate(x) if out else np.array([], dtype=np.int64) for x in zip(*out, strict=True)) if out else ([], [], [])
    return pd.DataFrame({"query_id": a, "vec_id": b, "score": c}, dtype="int64")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, pivots: int | None = None, sample: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): for each of `queries` the k best other rows of `vectors`, or all if fewer.

    Both have vec_id and embedding; queries are among the vectors. Vectors that are null, or have a null, NaN or
    infinite component, and those with a null id take no part; of rows with one id each is a candidate, and none is one
    of its own id's. Equal scores go to the smaller vec_id. Vectors of fewer components count as filled up with zeros. Products are exact up to 2 ** 63.
    An empty table gives no rows. pivots and sample: clusters (by default as many as give annuli of about half
    a block), and the vectors that they are fitted on; neither changes the result.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    x = stored(whole_vectors(vectors), "topk-vectors")
    square = F.aggregate("x", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    n, dims, longest = x.agg(F.count("*"), F.max(F.size("x")), F.max(square)).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    size = max(1, 2 * n // BLOCK)
    pivots = pivots or min(PIVOTS, max(1, round(2 * size**0.5)))
    annuli = min(ANNULI, -(-size // pivots))
    centres = choose_pivots(x, n, pivots, sample, dims, longest)

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            d = _distances(_lengthened(_matrix(b["x"], dims), longest), centres)
            near = d.argmin(axis=1)
            yield b.assign(pivot=near.astype(np.int32), distance=d[np.arange(len(b)), near])

    keys = stored(x.mapInPandas(keyed, "vec_id long, x array<bigint>, pivot int, distance double"), "topk-keys")
    edges = F.percentile_approx("distance", [i / annuli for i in range(1, annuli)] or [1.0], 1000)
    # one row for each pivot
    rings = {r["pivot"]: r["edges"] for r in keys.groupBy("pivot").agg(edges.alias("edges")).collect()}
    ring_rows = spark.createDataFrame([(p, [float(e) for e in edges]) for p, edges in sorted(rings.items())], "pivot int, edges array<double>")
    ringed = keys.join(F.broadcast(ring_rows), "pivot").withColumn("ring", F.size(F.filter("edges", lambda e: e < F.col("distance")))).drop("edges")
    # at most `annuli` rows for each pivot, and one more at its very edge
    cells = ringed.groupBy("pivot", "ring").agg(F.count("*").alias("n"), F.min("distance").alias("low"), F.max("distance").alias("high")).toPandas()
    cells = cells.sort_values(["pivot", "ring"], ignore_index=True)
    cells["blocks"] = -(-cells["n"] // BLOCK)
    cell_rows = spark.createDataFrame([(int(r.pivot * (annuli + 1) + r.ring), int(r.blocks)) for r in cells.itertuples()], "cell int, blocks int")
    placed = (
        ringed.withColumn("cell", F.col("pivot") * (annuli + 1) + F.col("ring")).join(F.broadcast(cell_rows), "cell")
        .withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int"))
    )
    placed = stored(placed.select("vec_id", "x", "cell", "block"), "topk-index")
    asked = placed.join(queries.select(F.col("vec_id").cast("long").alias("vec_id")).distinct(), "vec_id", "left_semi").dropDuplicates(["vec_id"])
    asked = stored(asked.select(F.col("vec_id").alias("query_id"), F.col("x").alias("q"), "cell", "block"), "topk-queries")
    groups = -(-asked.count() // QUERIES)
    asked = asked.withColumn("group", F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(max(1, groups))).cast("int"))

    def search(key, q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(v):
            return _best(np.array([]), np.array([]), np.zeros((0, 0)), k)
        return _best(v["vec_id"].to_numpy(), q["query_id"].to_numpy(), products(_matrix(q["q"], dims), _matrix(v["x"], dims)), k)

    place = ["cell", "block", "group"]

    def met(asking: DataFrame) -> DataFrame:
        """Hits of queries in the blocks that they ask for; a block is copied for those groups only that ask for it."""
        places = asking.select(F.col("cell").alias("cell_"), F.col("block").alias("block_"), F.col("group").alias("group_")).distinct()
        spread = placed.join(places, (F.col("cell") == F.col("cell_")) & (F.col("block") == F.col("block_")))
        spread = spread.select("vec_id", "x", "cell", "block", F.col("group_").alias("group"))
        return asking.groupBy(*place).cogroup(spread.groupBy(*place)).applyInPandas(search, _HITS)

    home = stored(met(asked), "topk-home")
    floor = home.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The blocks that may hold a score of at least the floor, but for the one that was searched."""
        cell, low, high, count = (cells["pivot"] * (annuli + 1) + cells["ring"]).to_numpy(), cells["low"].to_numpy(), cells["high"].to_numpy(), cells["blocks"].to_numpy()
        for b in (batch[i : i + LISTED] for batch in batches for i in range(0, len(batch), LISTED)):
            q = _matrix(b["q"], dims).astype(np.float64)
            d = _distances(np.column_stack([q, np.zeros(len(q))]), centres)[:, cells["pivot"]]
            gap = np.maximum(0, np.maximum(d - high, low - d))
            most = ((q * q).sum(axis=1)[:, None] + longest - gap * gap) / 2
            slack = 1 + 1e-9 * ((q * q).sum(axis=1)[:, None] + longest)
            i, j = np.nonzero(~(most + slack < b["floor"].to_numpy(dtype=np.float64, na_value=np.nan)[:, None]))
            at = np.repeat(np.arange(len(i)), count[j])
            block = np.arange(len(at)) - np.repeat(np.cumsum(count[j]) - count[j], count[j])
            out = pd.DataFrame({
                "query_id": b["query_id"].to_numpy()[i[at]], "cell": cell[j[at]].astype(np.int32), "block": block.astype(np.int32),
                "group": b["group"].to_numpy()[i[at]],
            })
            yield out[(out["cell"] != b["cell"].to_numpy()[i[at]]) | (out["block"] != b["block"].to_numpy()[i[at]])]

    wanted = asked.join(floor, "query_id", "left").mapInPandas(visits, "query_id long, cell int, block int, group int")
    away = met(stored(wanted, "topk-visits").join(asked.select("query_id", "q"), "query_id"))
    ranked = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return home.union(away).withColumn("rank", ranked).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))


OP7_SQL = """
WITH x AS (
  SELECT vec_id, [floor(256 * c::DOUBLE)::BIGINT FOR c IN embedding] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), scores AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_sum([q.x[i] * v.x[i] FOR i IN range(1, len(q.x) + 1)])::BIGINT AS score
  FROM x q JOIN x v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scores QUALIFY rank <= 5
"""
