"""Identity of notices: exact keys, families, and what revisions leave of each fact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidstream.sources.shared import stored


def record_id(procedure: Column, url: Column, lot: Column) -> Column:
    """A record's id; the prefix and the form are fixed values, for ids that are exchanged with others."""
    return F.concat(F.lit("sig_"), F.substring(F.sha2(F.concat_ws("|", F.coalesce(procedure, url), F.coalesce(lot, F.lit(""))), 256), 1, 20))


def exact_keys(procedure: Column, references: Column, urls: Column, lot: Column) -> Column:
    """Keys under which a notice is found, strongest first, each bound to its lot."""
    suffix = F.concat(F.lit("|lot:"), F.coalesce(lot, F.lit("")))
    own = F.array_compact(F.array(F.when(procedure != "", F.concat(F.lit("ocid:"), procedure))))
    listed = lambda prefix, xs: F.transform(F.coalesce(xs, F.array().cast("array<string>")), lambda x: F.concat(F.lit(prefix), x))
    return F.array_distinct(F.transform(F.concat(own, listed("ref:", references), listed("url:", urls)), lambda k: F.concat(k, suffix)))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that each node of (a, b) is connected with.

    Labels fall to the least of the neighbours' and then to their own label's label, so rounds grow with the logarithm
    of a path's length; each is written, and only a flag comes to the driver.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("c")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("c").alias("near"))
        lower = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("c").alias("was"), F.least("c", "near").alias("c"))
        lower = stored(lower, "labels")
        if not lower.where("c != was").limit(1).count():  # no neighbour has a lesser one, so they are equal throughout
            return lower.select("node", F.col("c").alias("component"))
        jump = lower.select(F.col("node").alias("c"), F.col("c").alias("next"))
        labels = stored(lower.join(jump, "c", "left").select("node", F.least("c", F.coalesce("next", "c")).alias("c")), "labels")


def key_components(keyed: DataFrame, node: str, key: str) -> DataFrame:
    """(node, component) of nodes that share keys, by way of others too. A key ties its nodes to its least node only."""
    hub = keyed.groupBy(key).agg(F.min(node).alias("a"))
    edges = keyed.join(hub, key).select("a", F.col(node).alias("b")).distinct()
    return components(edges).withColumnRenamed("node", node)


#: A field without a new fact.
EMPTY = ("", "unknown")


def has_fact(value: Column) -> Column:
    return value.isNotNull() & ~value.cast("string").isin(*EMPTY)


def merged_revisions(df: DataFrame, key: list[str], order: list[str], columns: list[str], units: list[list[str]] = ()) -> DataFrame:
    """One row of each key: for each column the last fact, so that a sparse revision wipes nothing out.

    units: columns that move together, such as an amount's bounds and currency, taken from the last revision with any.
    """
    at = F.struct(*order)
    pick = [F.max_by(c, F.when(has_fact(F.col(c)), at)).alias(c) for c in columns]
    for unit in units:
        some = F.coalesce(*[F.when(has_fact(F.col(c)), F.lit(True)) for c in unit])
        pick += [F.max_by(c, F.when(some, at)).alias(c) for c in unit]
    return df.groupBy(*key).agg(*pick, F.count("*").alias("revisions"))
