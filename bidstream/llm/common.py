"""What the corpus operators share: reading, cutting lineage, Arrow batches."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bidstream.sources.shared import shared_dir

#: Words of the contracts that split on ASCII white space.
NOT_SPACE = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def text_of(name: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(name), F.lit(""))


def stored(df: DataFrame, name: str, *by: str) -> DataFrame:
    """`df` written to the shared folder and read again, so that nothing before it is ever run a second time."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, however long their texts; the same for all operators, as the session reads it when a plan runs."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def lowest_hashes(df: DataFrame, h: Column, rows: int, n: int) -> DataFrame:
    """Of `df`, which has `n` rows, one row of each of the `rows` lowest hashes `h`: a bounded sample, alike on every run.

    The cut is found among hashes alone, and of these only among those that are low enough to be expected twice over;
    so neither whole rows nor a hash of each row go to one task, and the sample stays where its rows are.
    """
    low = df.select(h.alias("h"))
    if n > 2 * rows:
        low = low.where(F.col("h") < int(-(2**63) + 2**64 * (2 * rows / n)))
    cut = low.distinct().orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    return df.withColumn("hash_", h).where(F.lit(False) if cut is None else F.col("hash_") <= cut).dropDuplicates(["hash_"]).drop("hash_")


def fits(df: DataFrame, rows: int) -> bool:
    """Whether `df` has at most `rows` rows, counted no further than that."""
    return df.limit(rows + 1).count() <= rows
