"""Relations in tiers, and joins by overlapping or padded keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Rows that a task of a join takes, about; a larger table has more tasks.
TASK_ROWS = 200_000


def tiered(queries: DataFrame, rows: DataFrame, key: str, tiers: list[list[str]]) -> DataFrame:
    """(query, key, tier): rows that share all columns of a tier with a query row; of several tiers the first.

    One equi join for each tier, which leaves out pairs of an earlier one where they arise, so no pairs are gathered to be told from their repeats.
    Columns that are null relate nothing; queries has the rows' columns. Keys that have several rows come to the same, by way of all their pairs.
    """
    columns = sorted({c for tier in tiers for c in tier})
    counts = [df.groupBy(key).count().agg(F.max("count"), F.sum("count")).first() for df in (queries, rows)]
    several = any((most or 0) > 1 for most, _ in counts)
    parts = (counts[1][1] or 0) // TASK_ROWS
    # a task's rows stay as many when the table grows; small tables are dealt as the session has it
    spread = (lambda df, by: df.repartition(parts, *by)) if parts > int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")) else lambda df, by: df
    theirs = rows.select(key, *[F.col(c).alias(f"{c}_") for c in columns])
    found = []
    for i, tier in enumerate(tiers):
        same = lambda t: reduce(lambda a, b: a & b, [F.col(c) == F.col(f"{c}_") for c in t])
        asking, asked = spread(queries.select(F.col(key).alias("query"), *columns), tier), spread(theirs, [f"{c}_" for c in tier])
        pairs = asking.join(asked, same(tier)).where(F.col("query") != F.col(key))
        for earlier in tiers[:i]:
            pairs = pairs.where(~F.coalesce(same(earlier), F.lit(False)))
        found.append(pairs.select("query", key, F.lit(i).alias("tier")))
    union = reduce(DataFrame.union, found)
    return union.groupBy("query", key).agg(F.min("tier").alias("tier")) if several else union


def overlapping(left: DataFrame, right: DataFrame, ids: str, key: str, fallback: list[str] = ()) -> DataFrame:
    """(left key, right key) of rows with an identifier in common; rows without any, on either side, by equal fallback columns."""
    side = lambda df, n: df.select(F.col(key).alias(n), F.explode(F.array_distinct(ids)).alias("id_"))
    found = side(left, "a").join(side(right, "b"), "id_").select("a", "b").distinct()
    if not fallback:
        return found
    none = lambda df: df.where(F.coalesce(F.size(ids), F.lit(0)) < 1)
    names = lambda df, n: df.select(F.col(key).alias(n), *fallback)
    by_name = names(none(left), "a").join(names(right, "b"), fallback).union(names(left, "a").join(names(none(right), "b"), fallback)).select("a", "b")
    return found.union(by_name).distinct()


def overlap_classes(queries: DataFrame, rows: DataFrame, ids: str, key: str) -> DataFrame:
    """(id_, key, asked, asking, members): for each identifier that a query row has, the rows that have it.

    asked: the row is a query; asking and members count the class's queries and rows. A query overlaps all rows of its
    classes, which stand here once each and not once for each query.
    """
    side = lambda df: df.select(F.col(key), F.explode(F.array_distinct(ids)).alias("id_")).distinct()
    rows = side(rows).join(side(queries).withColumn("asked", F.lit(True)), [key, "id_"], "left").withColumn("asked", F.coalesce("asked", F.lit(False)))
    sizes = rows.groupBy("id_").agg(F.count_if("asked").alias("asking"), F.count("*").alias("members")).where("asking > 0")
    return rows.join(sizes, "id_").select("id_", key, "asked", "asking", "members")


def overlap_links(queries: DataFrame, rows: DataFrame, ids: str, key: str) -> DataFrame:
    """(key, links): for each query how many other rows have an identifier in common with it, each counted once; 0 for none.

    All pairs are formed by an equi join and counted where they arise: a pair counts at its least common identifier, so it is neither
    shuffled nor kept to be told from its repeats.
    """
    def side(df: DataFrame) -> DataFrame:
        held = df.select(key, F.array_sort(F.array_distinct(F.filter(ids, lambda x: x.isNotNull()))).alias("ids_"))
        return held.select(key, F.posexplode("ids_").alias("nth_", "id_"), "ids_").select(key, "id_", F.slice("ids_", F.lit(1), F.col("nth_")).alias("before_"))

    theirs = side(rows).select(F.col(key).alias("other_"), "id_", F.col("before_").alias("earlier_"))
    pairs = side(queries).join(theirs, "id_").where((F.col(key) != F.col("other_")) & ~F.arrays_overlap("before_", "earlier_"))
    return queries.select(key).join(pairs.groupBy(key).agg(F.count("*").alias("links")), key, "left").select(key, F.coalesce("links", F.lit(0)).alias("links"))


def control_numbers(text: Column, pattern: str = r"(?<!\d)(\d{1,8})[-/](\d{4})(?!\d)") -> Column:
    """Notice numbers in a text, with leading zeros and either dash alike: number-year."""
    n, year = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    return F.array_distinct(F.zip_with(n, year, lambda a, b: F.concat_ws("-", F.regexp_replace(a, "^0+(?=\\d)", ""), b)))


def shared_terms(mine: Column, theirs: Column, idf: Column, most: int = 3) -> Column:
    """The rarest terms of two arrays' common ones; idf is a map."""
    common = F.transform(F.array_intersect(mine, theirs), lambda t: F.struct((-F.element_at(idf, t)).alias("o"), t.alias("t")))
    return F.transform(F.slice(F.array_sort(common), 1, most), lambda x: x["t"])


def label_order(labels: Column) -> Column:
    """A key by which rows sort as by their sorted labels; rows without labels come last."""
    return F.when(F.size(labels) > 0, F.array_join(F.array_sort(F.array_distinct(labels)), "\u0000")).otherwise(F.lit("￿"))


def in_language_order(column: Column, collation: str = "UNICODE") -> Column:
    """A key by which texts sort as readers of a language expect, accents and case after letters; `collation` may name a language, such as sv."""
    return F.collate(column, collation)


def label_order_in(labels: Column, collation: str = "UNICODE") -> Column:
    """Labels, once each, in a language's order; rows sort by the array as by the labels in turn."""
    return F.array_sort(F.array_distinct(F.transform(labels, lambda x: F.collate(x, collation))))


def freshness(first_seen: Column, updated: Column, now: Column, zone: str = "Europe/London") -> dict[str, Column]:
    """new (seen first within a day), updated (within a day, and not new), added_today (on the zone's calendar day, not later)."""
    age = lambda t: F.timestamp_diff("SECOND", t, now)
    day = lambda t: F.to_date(F.from_utc_timestamp(t, zone))
    new = F.coalesce(age(first_seen).between(0, 86399), F.lit(False))
    return {
        "new": new, "updated": ~new & F.coalesce(age(updated).between(0, 86399), F.lit(False)),
        "added_today": F.coalesce((day(first_seen) == day(now)) & (first_seen <= now), F.lit(False)),
    }


def permitted_url(url: Column, hosts: list[str]) -> Column:
    """Links by https, without credentials or a port of their own, to a listed host or one below it."""
    host = F.lower(F.regexp_extract(url, r"^https://([^/?#@:]+)(?:[/?#]|$)", 1))
    ok = reduce(lambda a, b: a | b, [(host == h) | host.endswith(f".{h}") for h in hosts], F.lit(False))
    return F.coalesce((host != "") & ok, F.lit(False))
