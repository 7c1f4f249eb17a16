"""Snapshots of a source: what changed, what is gone, what may be closed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def differences(before: DataFrame, after: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, change): new, changed or gone; rows that stayed the same give none."""
    a, b = before.select(F.col(key), F.col(digest).alias("was_")), after.select(F.col(key), F.col(digest).alias("is_"))
    change = F.when(F.col("was_").isNull(), "new").when(F.col("is_").isNull(), "gone").when(F.col("was_") != F.col("is_"), "changed")
    return a.join(b, key, "full").withColumn("change", change).where("change is not null").select(key, "change")


def changed_rows(state: DataFrame, snapshot: DataFrame, key: str, digest: str, most: int, order: list) -> tuple[DataFrame, DataFrame]:
    """Rows that are not in the state as they are: the first `most` in an order, and the backlog."""
    fresh = snapshot.join(state.select(key, digest), [key, digest], "left_anti")
    emitted = fresh.orderBy(*order).limit(most)
    return emitted, fresh.join(emitted.select(key), key, "left_anti")


def absent_twice(listed: DataFrame, key: str, revision: str) -> DataFrame:
    """Keys that neither of the two last revisions lists, with the last revision that did.

    listed: one row for each key and revision that listed it. The source is taken to be complete at each revision.
    """
    # two rows at most
    last_two = listed.select(revision).distinct().orderBy(F.desc(revision)).limit(2)
    last_two = last_two.agg(F.min(revision).alias("previous_"), F.count("*").alias("n_"))
    seen = listed.groupBy(key).agg(F.max(revision).alias("last_listed"))
    return seen.join(F.broadcast(last_two), (F.col("n_") == 2) & (F.col("last_listed") < F.col("previous_"))).select(key, "last_listed")


def tombstones(absent: DataFrame, notices: DataFrame, key: str, policy: dict[str, str]) -> DataFrame:
    """Absent notices with the status that their source's policy gives: not_listed where absence closes, else re_read."""
    # one entry for each configured source
    closes = F.create_map(*[F.lit(x) for pair in policy.items() for x in pair])
    action = F.coalesce(F.element_at(closes, F.col("source")), F.lit("re_read"))
    return notices.join(absent, key).withColumn("status", F.when(action == "close", "not_listed").otherwise("re_read"))


def merged_three_ways(base: DataFrame, local: DataFrame, remote: DataFrame, key: str) -> DataFrame:
    """Each column: the side that changed it; where both did, and not alike, the local value, and the column in conflicts."""
    columns = [c for c in base.columns if c != key]
    side = lambda df, s: df.select(key, *[F.col(c).alias(f"{c}_{s}") for c in columns])
    joined = side(base, "b").join(side(local, "l"), key, "full").join(side(remote, "r"), key, "full")
    value, conflict = [], []
    for c in columns:
        b, left, r = F.col(f"{c}_b"), F.col(f"{c}_l"), F.col(f"{c}_r")
        value.append(F.when(left.eqNullSafe(b), r).otherwise(left).alias(c))
        conflict.append(F.when(~left.eqNullSafe(b) & ~r.eqNullSafe(b) & ~left.eqNullSafe(r), F.lit(c)))
    return joined.select(key, *value, F.array_compact(F.array(*conflict)).alias("conflicts"))
