"""Work that is left for the next run: pages to hydrate, windows to read, budgets, completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def to_hydrate(listing: DataFrame, cache: DataFrame, key: str, signature: str, now: Column, hours: int = 24) -> DataFrame:
    """Listed rows whose detail page is not in the cache, is of another signature, or is older than so many hours."""
    known = cache.where(F.timestamp_diff("HOUR", F.col("fetched_at"), now) < hours).select(key, signature)
    return listing.join(known, [key, signature], "left_anti")


def hydrated(listing: DataFrame, details: DataFrame, key: str) -> DataFrame:
    """Listed rows with their details where these are known: a detail's field counts over the listing's."""
    shared = [c for c in details.columns if c in listing.columns and c != key]
    extra = [c for c in details.columns if c not in listing.columns]
    d = details.select(F.col(key), *[F.col(c).alias(f"{c}_d") for c in shared], *extra)
    merged = [F.coalesce(f"{c}_d", c).alias(c) if c in shared else F.col(c) for c in listing.columns]
    return listing.join(d, key, "left").select(*merged, *extra)


def windows(spark: SparkSession, first: str, last: str, days: int = 1) -> DataFrame:
    """(after, through): windows of so many days that cover first to last, each to be read whole before the next."""
    start = F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr(f"INTERVAL {days} DAY")))
    rows = spark.range(1).select(start.alias("after"))
    return rows.select("after", F.least(F.date_add("after", days - 1), F.lit(last).cast("date")).alias("through"))


def lanes(queue: DataFrame, lane: str, order: list[str], budget: int, reserved: dict[str, int]) -> DataFrame:
    """The next `budget` rows, lanes taking turns; lanes with a reserve have so many turns before the others share the rest."""
    from bidstream.operators.ordered import round_robin

    # one entry for each configured lane
    pairs = [F.lit(x) for pair in reserved.items() for x in pair]
    held = F.coalesce(F.element_at(F.create_map(*pairs), F.col(lane)), F.lit(0)) if pairs else F.lit(0)
    turned = round_robin(queue, lane, order)
    return turned.orderBy((F.col("turn") > held).cast("int"), "turn", lane).limit(budget)


def left_active(before: DataFrame, active: DataFrame, reread: DataFrame, key: str) -> DataFrame:
    """Keys that have left the active set and were not read once more yet."""
    return before.select(key).join(active.select(key), key, "left_anti").join(reread.select(key), key, "left_anti")


def completeness(pages: DataFrame, key: str, advertised: int, revision: str) -> DataFrame:
    """One row (rows, keys, revisions, complete): whether a paged snapshot is whole, of one revision, without repeats."""
    out = pages.agg(F.count("*").alias("rows"), F.count_distinct(key).alias("keys"), F.count_distinct(revision).alias("revisions"))
    return out.withColumn("complete", (F.col("keys") == advertised) & (F.col("rows") == F.col("keys")) & (F.col("revisions") == 1))


def same_twice(first: DataFrame, second: DataFrame, page: str, digest: Column) -> DataFrame:
    """Pages whose content was not the same in two passes, or that one pass lacks."""
    a, b = first.select(page, digest.alias("a_")), second.select(page, digest.alias("b_"))
    return a.join(b, page, "full").where(~F.col("a_").eqNullSafe(F.col("b_"))).select(page)
