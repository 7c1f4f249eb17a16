"""Nested JSON as rows: every value with its path, what stands under a key at any depth, and histories of facts as runs of versions.

A value is told by its path, such as $.lots[0].id, and kept as JSON text, so its type stays what it was. One level is opened after the other, by
`variant_explode`, until nothing nested is left; levels are as many as the deepest payload has.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidstream.operators.ordered import round_robin
from bidstream.sources.shared import stored


def _nested(text: Column) -> Column:
    """Whether a value, told by its JSON text, has values of its own to open."""
    return text.startswith("{") & (text != "{}") | text.startswith("[") & (text != "[]")


def _once(value: Column) -> Column:
    """A generator of one row: filters above it stay above, so a value is worked out once and not again for each mention."""
    return F.explode_outer(F.array(value))


def opened(df: DataFrame, key: list[str], payload: str, names: list[str] | None = None) -> DataFrame:
    """(key.., path, name, text, leaf): every value in a JSON text, at any depth, the outermost itself too.

    name: the key that a value stands under, null for the outermost and for members of arrays. leaf: it has no values of its own; an empty object or
    array is a leaf. A text that is no JSON gives none. With `names`, only the values under these, and no others are kept on the way but for what is to be opened.
    """
    wanted = F.lit(True) if names is None else F.coalesce(F.col("name").isin(names), F.lit(False))
    own = [f"own{i}_" for i in range(len(key))]  # the keys' names may be those of what explodes
    level = df.select(*[F.col(k).alias(o) for k, o in zip(key, own, strict=True)], F.lit("$").alias("path"), F.lit(None).cast("string").alias("name"), _once(F.try_parse_json(payload)).alias("v")).where("v is not null")
    levels = []
    while True:
        text = level.select(*own, "path", "name", _once(F.to_json("v")).alias("text")).withColumn("leaf", ~_nested(F.col("text")))
        level = stored(text.where(wanted | ~F.col("leaf")), "nested-level")
        levels.append(level.where(wanted))
        inner = level.where("not leaf")
        if not inner.limit(1).count():
            break
        parts = inner.withColumn("v", F.parse_json("text")).lateralJoin(level.sparkSession.tvf.variant_explode(F.col("v").outer()))
        step = F.when(F.col("key").isNotNull(), F.concat(F.lit("."), "key")).otherwise(F.concat(F.lit("["), F.col("pos"), F.lit("]")))
        level = parts.select(*own, F.concat("path", step).alias("path"), F.col("key").alias("name"), F.col("value").alias("v"))
    return reduce(DataFrame.unionByName, levels).select(*[F.col(o).alias(k) for k, o in zip(key, own, strict=True)], "path", "name", "text", "leaf")


def values_under(df: DataFrame, key: list[str], payload: str, names: list[str]) -> DataFrame:
    """(key.., path, text): all values that stand under one of the keys `names`, at any depth, objects and arrays too."""
    return opened(df, key, payload, names).select(*key, "path", "text")


def fact_runs(versions: DataFrame, key: str, order: list[str], payload: str) -> DataFrame:
    """(key, path, first, last, text): for how long each leaf of a key's versions kept its value, versions being numbered from 1 in order.

    A reversible history: a version has the leaves whose runs hold its number. Runs are found by joins on a version's number and by numbering
    in sorted ranges, so a key with most of the versions is no single task's work.
    """
    numbered = stored(round_robin(versions.select(key, *order, payload), key, order), "fact-versions")
    leaves = opened(numbered.select(key, "turn", payload), [key, "turn"], payload).where("leaf").select(key, "turn", "path", "text")
    leaves = stored(leaves, "fact-leaves")
    near = lambda by: leaves.select(key, (F.col("turn") + by).alias("turn"), "path", "text")
    edges = lambda by, name: _numbered(leaves.join(near(by), [key, "turn", "path", "text"], "left_anti"), key, name)
    starts, ends = edges(1, "first"), edges(-1, "last")
    return starts.join(ends.drop("text"), [key, "path", "nth"]).select(key, "path", "first", "last", "text")


def _numbered(edges: DataFrame, key: str, name: str) -> DataFrame:
    """Starts or ends of runs with their number among those of a key's path."""
    rows = edges.select(key, "path", F.struct(F.col(key), "path").alias("stratum_"), F.col("turn").alias(name), "text")
    return round_robin(rows, "stratum_", [name]).drop("stratum_").withColumnRenamed("turn", "nth")


def versions_again(runs: DataFrame, key: str) -> DataFrame:
    """(key, version, facts): each version's leaves, a map of paths to JSON texts, from the runs."""
    rows = runs.select(key, F.explode(F.sequence("first", "last")).alias("version"), F.struct("path", "text").alias("fact"))
    return rows.groupBy(key, "version").agg(F.map_from_entries(F.array_sort(F.collect_list("fact"))).alias("facts"))


def version_at(runs: DataFrame, key: str, version: Column) -> DataFrame:
    """(key, facts) of one version of each key, only the runs that hold it."""
    held = runs.where((F.col("first") <= version) & (F.col("last") >= version))
    return held.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", "text")))).alias("facts"))
