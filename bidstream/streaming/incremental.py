"""Incremental runs: micro-batches merged into a table of records, with a watermark that moves last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidstream.operators.identity import merged_revisions
from bidstream.sources.shared import stored


def merge_batch(state: DataFrame | None, batch: DataFrame, key: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """State after a batch, in the shared folder."""
    return stored(merged_state(state, batch, key, order, columns), "state")


def merged_state(state: DataFrame | None, batch: DataFrame, key: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """State after a batch. State holds for each column its last fact and when that was, so batches may come late,
    twice or in any order, and the result is that of all rows at once."""
    at = F.struct(*order)
    facts = [F.max(F.when(_fact(c), F.struct(at.alias("at"), F.col(c).cast("string").alias("value")))).alias(f"{c}_fact") for c in columns]
    new = batch.groupBy(*key).agg(*facts)
    if state is None:
        return new
    return state.unionByName(new).groupBy(*key).agg(*[F.max(f"{c}_fact").alias(f"{c}_fact") for c in columns])


def _fact(column: str):
    return F.col(column).isNotNull() & ~F.col(column).cast("string").isin("", "unknown")


def facts(state: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    return state.select(*key, *[F.col(f"{c}_fact.value").alias(c) for c in columns])


def replayed(df: DataFrame, batch_of, batches: int, key: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The records after batches that come one by one; `batch_of` says which a row is in."""
    state = None
    for b in range(batches):
        state = merge_batch(state, df.where(batch_of == b), key, order, columns)
    return facts(state, key, columns)


def _current(spark: SparkSession, table: str, before: int) -> dict[int, int]:
    """Each bucket's newest version of a batch before `before`; at most one entry for each bucket."""
    try:
        found = spark.read.parquet(table).where(F.col("version") < before).groupBy("bucket").agg(F.max("version").alias("version"))
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return {}
        raise
    return {r["bucket"]: r["version"] for r in found.collect()}


def current_state(spark: SparkSession, table: str, before: int = 1 << 62) -> DataFrame | None:
    """The newest rows of all buckets of a table that stream_into() writes, or None if there are none."""
    versions = _current(spark, table, before)
    return _read(spark, table, versions) if versions else None


def _read(spark: SparkSession, table: str, versions: dict[int, int]) -> DataFrame:
    """Rows of these buckets' versions; the predicate is on partition columns, so other files are not opened."""
    wanted = F.lit(False)
    for version in sorted(set(versions.values())):
        wanted = wanted | ((F.col("version") == version) & F.col("bucket").isin([b for b, v in versions.items() if v == version]))
    return spark.read.parquet(table).where(wanted).drop("version", "bucket")


def stream_into(
    spark: SparkSession, source: DataFrame, table: str, checkpoint: str, key: list[str], order: list[str], columns: list[str], buckets: int = 64,
):
    """A streaming query that merges each micro-batch into `table`, by buckets of the key's hash.

    A batch reads and writes only the buckets that it has rows of; each is written whole as the batch's version, before the checkpoint
    moves on. A batch that runs again starts from the versions before it, and writes its own again. Older versions may be
    removed by whoever knows that no reader is left.
    """

    def each(batch: DataFrame, number: int) -> None:
        held = stored(batch.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")), "micro-batch")
        touched = [r[0] for r in held.select("bucket").distinct().collect()]  # at most `buckets`
        known = {b: v for b, v in _current(spark, table, number).items() if b in touched}
        new = merged_state(_read(spark, table, known) if known else None, held, key, order, columns)
        new = new.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
        new.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{table}/version={number}")

    return source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def once(df: DataFrame, key: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """What replayed() has to give, from all rows at once."""
    return merged_revisions(df, key, order, columns).select(*key, *[F.col(c).cast("string").alias(c) for c in columns])
