"""Cursors of feeds, kept in a table: they move after a whole window only, and failed windows wait for their next try.

State has a row for each feed or window: feed, cursor, attempts, failed_at, retry_at. Times are timestamps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STATE = "feed string, cursor timestamp, attempts long, failed_at timestamp, retry_at timestamp"


def due(state: DataFrame, now: Column) -> DataFrame:
    """Feeds that may run: never failed, or their wait is over; those that waited longest first."""
    return state.where(F.col("retry_at").isNull() | (F.col("retry_at") <= now)).orderBy(F.col("failed_at").asc_nulls_first(), "feed")


def moved(state: DataFrame, outcomes: DataFrame, now: Column, wait_minutes: int = 15, most_minutes: int = 1440) -> DataFrame:
    """State after a run; outcomes: (feed, through, complete), a row for each window that was read, new feeds too.

    A feed's cursor moves to the end of its last window if all its windows were read whole, and never back. Otherwise it stays,
    and the feed waits: `wait_minutes`, twice as long after each further failure, `most_minutes` at most.
    """
    ran = outcomes.groupBy("feed").agg(F.max("through").alias("through"), F.bool_and(F.coalesce("complete", F.lit(False))).alias("ok"))
    both = state.join(ran, "feed", "full")
    attempts = F.coalesce("attempts", F.lit(0))
    wait = F.least(F.lit(most_minutes), (wait_minutes * F.pow(F.lit(2), F.least(attempts, F.lit(20)))).cast("int"))
    good, bad = F.coalesce("ok", F.lit(False)), F.coalesce(~F.col("ok"), F.lit(False))
    return both.select(
        "feed", F.when(good, F.greatest("cursor", "through")).otherwise(F.col("cursor")).alias("cursor"),
        F.when(good, F.lit(0)).when(bad, attempts + 1).otherwise(attempts).cast("long").alias("attempts"),
        F.when(good, F.lit(None)).when(bad, now).otherwise(F.col("failed_at")).cast("timestamp").alias("failed_at"),
        F.when(good, F.lit(None)).when(bad, F.timestamp_add("MINUTE", wait, now)).otherwise(F.col("retry_at")).cast("timestamp").alias("retry_at"),
    )


def saved(state: DataFrame, path: str, run: int) -> None:
    """Writes the state as the run's version. A version is whole or not there, so a run that fails leaves the one before."""
    state.write.mode("overwrite").parquet(f"{path}/run={run}")


def loaded(spark: SparkSession, path: str, run: int) -> DataFrame:
    """The state that the run before `run` left; empty before the first."""
    if run == 0:
        return spark.createDataFrame([], STATE)
    return spark.read.schema(STATE).parquet(f"{path}/run={run - 1}")


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of JSON lines, gzipped or not; only a line feed ends one, as texts may hold other separators of lines."""
    return spark.read.schema(schema).option("lineSep", "\n").json(path)
