"""Measures of labelled decisions, and deterministic samples and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bidstream.functions.text import wilson


def confusion(df: DataFrame, stratum: str, truth: Column, said: Column) -> DataFrame:
    """Counts, precision and recall with Wilson bounds, for each stratum and over all (a null stratum)."""
    counts = df.groupingSets([[stratum], []], stratum).agg(
        F.count_if(truth & said).alias("tp"), F.count_if(~truth & said).alias("fp"), F.count_if(truth & ~said).alias("fn"), F.count_if(~truth & ~said).alias("tn")
    )
    out = counts
    for name, other in (("precision", "fp"), ("recall", "fn")):
        n = F.col("tp") + F.col(other)
        some = F.when(n > 0, n)
        low, high = wilson(F.col("tp"), some)
        out = out.withColumns({name: F.round(F.col("tp") / some, 6), f"{name}_low": F.round(low, 6), f"{name}_high": F.round(high, 6)})
    return out


def transitions(before: DataFrame, after: DataFrame, key: str, state: str) -> DataFrame:
    """How many keys went from which state to which; a key that one side lacks is absent there."""
    a, b = before.select(key, F.col(state).alias("was")), after.select(key, F.col(state).alias("is"))
    return a.join(b, key, "full").na.fill("absent", ["was", "is"]).groupBy("was", "is").agg(F.count("*").alias("n"))


def stable_sample(df: DataFrame, key: str, stratum: str, n: int, seed: str) -> DataFrame:
    """`n` rows of each stratum in an order of hashes, the same in each run."""
    order = F.sha2(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")), 256)
    turn = F.row_number().over(W.partitionBy(stratum).orderBy(order)).cast("long")
    return df.withColumn("turn", turn).where(F.col("turn") <= n)


def split(df: DataFrame, group: str, contaminated: Column, seed: str, test_share: int = 20) -> DataFrame:
    """part: train or test by the group's hash; a group with a contaminated row is train as a whole."""
    bucket = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(seed), F.col(group).cast("string")), 256), 1, 8), 16, 10).cast("long") % 100
    tainted = df.where(contaminated).select(F.col(group).alias("tainted_")).distinct()
    rows = df.join(tainted, F.col(group).eqNullSafe(F.col("tainted_")), "left")
    part = F.when(F.col("tainted_").isNotNull() | (bucket >= test_share), "train").otherwise("test")
    return rows.withColumn("part", part).drop("tainted_")


def storage_health(df: DataFrame, part: str, size: Column, warn: int, stop: int) -> DataFrame:
    total = df.groupBy(part).agg(F.count("*").alias("files"), F.sum(size).alias("bytes"), F.max(size).alias("largest"))
    return total.withColumn("state", F.when(F.col("bytes") >= stop, "stop").when(F.col("bytes") >= warn, "warn").otherwise("ok"))
