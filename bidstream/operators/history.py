"""Histories: timelines, reversible versions, lots that awards settle, publication checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def timeline(df: DataFrame, key: str, item: list[str], into: str, newest_first: bool = False) -> DataFrame:
    """A key's items in order of their fields."""
    return df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*item)), asc=not newest_first).alias(into))


def in_published_scope(history: DataFrame, published: DataFrame, keys: list[str]) -> DataFrame:
    """History rows of which any key is published; a row comes once."""
    hit = F.lit(False)
    out = history
    for k in keys:
        seen = published.select(F.col(k).alias(f"seen_{k}")).where(F.col(f"seen_{k}").isNotNull()).distinct()
        out = out.join(seen, F.col(k) == F.col(f"seen_{k}"), "left")
        hit = hit | F.col(f"seen_{k}").isNotNull()
    return out.where(hit).select(*history.columns)


def packed(versions: DataFrame, key: str, order: list[str], facts: str) -> DataFrame:
    """The current version of each key, and for each older one the patch that leads back to it.

    facts: a map. A patch holds what the older version has otherwise (restore) and what it lacks (remove), against the
    next version. (key, order.., current, facts, restore, remove, digest); digest is the older version's own.
    """
    w = W.partitionBy(key).orderBy(*order)
    after = F.lead(facts).over(w)
    restore = F.map_filter(facts, lambda k, v: ~(F.map_contains_key("after_", k) & F.element_at("after_", k).eqNullSafe(v)))
    remove = F.array_except(F.map_keys("after_"), F.map_keys(facts))
    return versions.withColumn("after_", after).withColumn("current", F.col("after_").isNull()).select(
        key, *order, "current", F.when(F.col("current"), F.col(facts)).alias(facts), F.when(~F.col("current"), restore).alias("restore"),
        F.when(~F.col("current"), F.array_sort(remove)).alias("remove"), map_digest(F.col(facts)).alias("digest"),
    )


def unpacked(pack: DataFrame, key: str, order: list[str], facts: str) -> DataFrame:
    """All versions again: (key, order.., facts, digest).

    Patches are applied from the newest back, as a running fold over the key's patches; a key's history is bounded by
    how often its publisher revises it.
    """
    step = F.struct(*order, "current", facts, "restore", "remove", "digest")
    at = lambda s: F.struct(*[s[c] for c in order])
    newest_first = lambda a, b: F.when(at(a) > at(b), -1).when(at(a) < at(b), 1).otherwise(0)
    chain = pack.groupBy(key).agg(F.array_sort(F.collect_list(step), newest_first).alias("chain"))
    back = lambda last, s: F.map_concat(
        F.map_filter(last, lambda k, v: ~F.array_contains(s["remove"], k) & ~F.array_contains(F.map_keys(s["restore"]), k)), s["restore"]
    )
    rebuilt = F.aggregate(
        "chain", F.array().cast(f"array<{_map_type(pack, facts)}>"),
        lambda done, s: F.concat(done, F.array(F.when(s["current"], s[facts]).otherwise(back(F.element_at(done, F.when(F.size(done) > 0, F.size(done)).otherwise(F.lit(None))), s)))),
    )
    zipped = F.explode(F.arrays_zip(F.col("chain").alias("s"), F.col("rebuilt").alias("f")))
    return chain.withColumn("rebuilt", rebuilt).select(key, zipped.alias("x")).select(key, *[f"x.s.{c}" for c in order], F.col("x.f").alias(facts), F.col("x.s.digest").alias("digest"))


def _map_type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def map_digest(facts: Column) -> Column:
    """SHA-256 of a map, whatever the order of its entries."""
    entries = F.array_sort(F.transform(F.map_entries(facts), lambda e: F.to_json(F.array(e["key"], F.coalesce(e["value"].cast("string"), F.lit("\u0000"))))))
    return F.sha2(F.array_join(entries, ","), 256)


def settled_lots(lots: DataFrame, awards: DataFrame) -> DataFrame:
    """Lots (procedure, lot, status) with the status that active awards (procedure, lot) give, and whether all of a procedure's are awarded."""
    hit = awards.select("procedure", "lot").distinct().withColumn("hit_", F.lit(True))
    out = lots.join(hit, ["procedure", "lot"], "left").withColumn("status", F.when(F.col("hit_"), "awarded").otherwise(F.col("status"))).drop("hit_")
    all_awarded = out.groupBy("procedure").agg(F.bool_and(F.col("status") == "awarded").alias("complete"))
    return out.join(all_awarded, "procedure")


def conflicts(df: DataFrame, key: str, digest: Column) -> DataFrame:
    """Keys that have rows of different content."""
    return df.groupBy(key).agg(F.count("*").alias("rows"), F.count_distinct(digest).alias("contents")).where("contents > 1")


def manifest(df: DataFrame, partition: str, key: str) -> DataFrame:
    """(partition, rows, keys, checksum) of what is published; the checksum does not depend on order."""
    return df.groupBy(partition).agg(
        F.count("*").alias("rows"), F.count_distinct(key).alias("keys"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("checksum")
    )


def manifest_faults(df: DataFrame, listed: DataFrame, partition: str, key: str) -> DataFrame:
    """Partitions whose rows are not those that the manifest lists, or whose keys repeat; none if all is well."""
    found, names = manifest(df, partition, key), ["rows", "keys", "checksum"]
    side = lambda x, s: x.select(partition, *[F.col(c).alias(f"{c}_{s}") for c in names])
    same = F.lit(True)
    for c in names:
        same = same & F.col(f"{c}_f").eqNullSafe(F.col(f"{c}_l"))
    return side(found, "f").join(side(listed, "l"), partition, "full").where(~same | (F.col("rows_f") != F.col("keys_f"))).select(partition)
