"""Operators over rows in an order per key: latest versions, fill-forward, rotation, sliding rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bidstream.sources.shared import stored


def latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row of each key, the last by `order`. Aggregated before the shuffle, so a key with many versions is no burden."""
    rest = [c for c in df.columns if c not in key]
    picked = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row"))
    return picked.select(*key, "row.*").select(*df.columns)


def filled_forward(df: DataFrame, key: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Nulls take the last value before them in their key's order."""
    before = W.partitionBy(*key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(before) for c in columns})


def last_n(df: DataFrame, key: list[str], item: list[str], n: int, into: str) -> DataFrame:
    """For each key its last `n` items, in order of their fields.

    The items of a key are ranked before they are gathered, so an array never holds more than `n`.
    """
    newest = F.row_number().over(W.partitionBy(*key).orderBy(*[F.col(c).desc() for c in item]))
    kept = df.select(*key, *item).withColumn("rank_", newest).where(F.col("rank_") <= n)
    return kept.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(*item))).alias(into))


def round_robin(df: DataFrame, stratum: str, order: list[str], most: int | None = None) -> DataFrame:
    """The turn of each row when strata take turns, in order; with `most`, only the first turns.

    Rows are sorted by ranges and numbered in each; a range's turns go on from where the stratum's earlier ranges ended. So a
    stratum with most of the rows is no single task's work. Only a count for each range and stratum is looked at as a whole.
    """
    at = F.monotonically_increasing_id()
    rows = stored(df.orderBy(stratum, *order).withColumn("at_", at), "turns").withColumn("range_", F.shiftright("at_", 33))
    parts = rows.groupBy(stratum, "range_").agg(F.count("*").alias("n_"), F.min("at_").alias("first_"))
    earlier = W.partitionBy(stratum).orderBy("range_").rowsBetween(W.unboundedPreceding, -1)
    starts = parts.withColumn("start_", F.coalesce(F.sum("n_").over(earlier), F.lit(0))).select(F.col(stratum).alias("of_"), F.col("range_").alias("in_"), "first_", "start_")
    on = F.col(stratum).eqNullSafe(F.col("of_")) & (F.col("range_") == F.col("in_"))
    out = rows.join(starts, on).withColumn("turn", F.col("start_") + F.col("at_") - F.col("first_") + 1).select(*df.columns, "turn")
    return out if most is None else out.where(F.col("turn") <= most)


def running_sums(df: DataFrame, stratum: str, order: list[str], amount: str) -> DataFrame:
    """Rows with running_, the sum of `amount` over a stratum's rows up to them, in order.

    As in round_robin, ranges of sorted rows are summed apart and go on from where the stratum's earlier ranges ended.
    """
    at = F.monotonically_increasing_id()
    rows = stored(df.orderBy(stratum, *order).withColumn("at_", at), "running").withColumn("range_", F.shiftright("at_", 33))
    parts = rows.groupBy(stratum, "range_").agg(F.sum(amount).alias("sum_"))
    earlier = W.partitionBy(stratum).orderBy("range_").rowsBetween(W.unboundedPreceding, -1)
    starts = parts.withColumn("start_", F.coalesce(F.sum("sum_").over(earlier), F.lit(0))).select(F.col(stratum).alias("of_"), F.col("range_").alias("in_"), "start_")
    here = F.sum(amount).over(W.partitionBy(stratum, "range_").orderBy("at_").rowsBetween(W.unboundedPreceding, 0))
    on = F.col(stratum).eqNullSafe(F.col("of_")) & (F.col("range_") == F.col("in_"))
    return rows.withColumn("here_", here).join(starts, on).withColumn("running_", F.col("start_") + F.col("here_")).select(*df.columns, "running_")


def running_total(df: DataFrame, order: list[Column], amount: Column, into: str = "total") -> DataFrame:
    """Rows with the sum of `amount` over all rows up to them, in order; the order has to be total.

    Rows are sorted by ranges and summed in each; a range goes on from the sum of those before it. Only one sum for each range
    is looked at as a whole.
    """
    at = F.monotonically_increasing_id()
    rows = stored(df.withColumn("amount_", amount).orderBy(*order).withColumn("at_", at), "running").withColumn("range_", F.shiftright("at_", 33))
    earlier = W.partitionBy(F.lit(0)).orderBy("range_").rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    starts = rows.groupBy("range_").agg(F.sum("amount_").alias("sum_")).withColumn("start_", F.coalesce(F.sum("sum_").over(earlier), F.lit(0))).select("range_", "start_")
    here = F.sum("amount_").over(W.partitionBy("range_").orderBy("at_").rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("here_", here).join(F.broadcast(starts), "range_").withColumn(into, F.col("start_") + F.col("here_")).select(*df.columns, into)


def rotation(df: DataFrame, kind: str, at: str, tie: str, now: Column) -> DataFrame:
    """Backups to keep: the last of each kind and day within 7 days, and of each kind and ISO week within 28."""
    age = F.timestamp_diff("SECOND", F.col(at), now)
    last = lambda *by: F.row_number().over(W.partitionBy(kind, *by).orderBy(F.col(at).desc(), F.col(tie).desc())) == 1
    marked = df.where(age >= 0).withColumn("day_", F.to_date(at)).withColumn("week_", F.to_date(F.date_trunc("week", F.col(at))))
    kept = (last("day_") & (age <= 7 * 86400)), (last("week_") & (age <= 28 * 86400))
    return marked.withColumns({"daily": kept[0], "weekly": kept[1]}).where("daily or weekly").drop("day_", "week_")


def sliding(df: DataFrame, key: list[str], seconds: Column, width: int, amount: str, span: int = 64) -> DataFrame:
    """Count and sum of each key's rows in the last `width` seconds, the row itself among them.

    Rows are added up by second first. A key's seconds are cut into stretches of `span` widths, and each stretch has the seconds
    before it that its rows look back on, so a key with most of the rows is spread over its time.
    """
    rows = df.withColumn("second_", seconds)
    by_second = rows.groupBy(*key, "second_").agg(F.count("*").alias("n_"), F.sum(amount).alias("s_"))
    own, also = F.floor(F.col("second_") / (width * span)), F.floor((F.col("second_") + width) / (width * span))
    spread = by_second.withColumn("stretch_", F.explode(F.array_distinct(F.array(own, also)))).withColumn("own_", own)
    frame = W.partitionBy(*key, "stretch_").orderBy("second_").rangeBetween(-width, 0)
    sums = spread.withColumns({"in_window": F.sum("n_").over(frame), "sum_window": F.sum("s_").over(frame)}).where("stretch_ = own_")
    sums = sums.select(*[F.col(c).alias(f"{c}_k") for c in key], F.col("second_").alias("second_k"), "in_window", "sum_window")
    same = F.col("second_") == F.col("second_k")
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_k"))
    return rows.join(sums, same).select(*df.columns, "in_window", "sum_window")


def once_a_day(df: DataFrame, key: list[str], at: str, order: list[str]) -> DataFrame:
    """Of equal observations on one UTC day, the last."""
    return latest(df.withColumn("day_", F.to_date(at)), [*key, "day_"], order).drop("day_")


def by_precedence(frames: list[DataFrame], key: list[str]) -> DataFrame:
    """Union in which a later frame's row replaces an earlier frame's row of the same key."""
    ranked = [f.withColumn("rank_", F.lit(i)) for i, f in enumerate(frames)]
    out = ranked[0]
    for f in ranked[1:]:
        out = out.unionByName(f)
    return latest(out, key, ["rank_"]).drop("rank_")
