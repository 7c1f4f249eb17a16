"""Sinks: shards with manifests, bounded buckets, month archives, upserts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bidstream.operators import history, ordered
from bidstream.sources.shared import stored


def bucket_of(key: str, digits: int = 2) -> Column:
    """One of 16 ** digits buckets, by the key's SHA-256."""
    return F.substring(F.sha2(F.col(key).cast("string"), 256), 1, digits)


def write_shards(df: DataFrame, path: str, partition: str, key: str, rows_a_file: int = 100_000) -> DataFrame:
    """Writes one folder for each value of `partition`, and returns the manifest that a reader checks them against.

    Rows are dealt out by partition and by the key's hash, so a large partition has many writers.
    """
    dealt = df.repartition(partition, F.pmod(F.xxhash64(key), F.lit(16)))
    dealt.write.mode("overwrite").option("maxRecordsPerFile", rows_a_file).partitionBy(partition).parquet(path)
    return history.manifest(df, partition, key)


def verified(spark: SparkSession, path: str, listed: DataFrame, partition: str, key: str, schema) -> DataFrame:
    """The shards, or ValueError if they are not as listed."""
    df = spark.read.schema(schema).parquet(path).select(*schema.fieldNames())
    wrong = history.manifest_faults(df, listed, partition, key).limit(10).collect()
    if wrong:
        raise ValueError(f"not as published: {[r[0] for r in wrong]}")
    return df


def archive_months(df: DataFrame, path: str, at: str, key: str, order: list[str]) -> None:
    """Adds rows to an archive by month; of a key in a month the last stays, and months without new rows are not touched.

    The months that change are written to the shared folder first and read from there, so what is overwritten is read by
    nothing that may have to run again.
    """
    spark = df.sparkSession
    new = df.withColumn("month", F.date_format(at, "yyyy-MM"))
    months = [r[0] for r in new.select("month").distinct().collect()]  # calendar months
    try:
        old = spark.read.parquet(path).where(F.col("month").isin(months)).withColumn("month", F.col("month").cast("string"))
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = new.limit(0)
    merged = ordered.latest(old.select(*new.columns).unionByName(new), [key, "month"], order)
    held = stored(merged, "archive")
    held.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)
    # which months a key is in, a file for each month that was written, in order of the key's hash
    names = held.select(key, "month", bucket_of(key, 4).alias("hash"))
    names.repartition("month").sortWithinPartitions("month", "hash").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(f"{path}.index")


def months_of(spark: SparkSession, path: str, keys: DataFrame, key: str) -> DataFrame:
    """(key, month) of the keys that an archive holds, from its index, which has no more than a key and a month for each."""
    wanted = keys.select(key).distinct().withColumn("hash", bucket_of(key, 4))
    index = spark.read.parquet(f"{path}.index").withColumn("month", F.col("month").cast("string"))
    return index.join(wanted, [key, "hash"], "left_semi").select(key, "month")


def restored(spark: SparkSession, path: str, keys: DataFrame, key: str) -> DataFrame:
    """All archived rows with these keys, whatever months they are in: the index says which, and no other month is opened."""
    hits = stored(months_of(spark, path, keys, key), "archive-hits")
    return from_archive(spark, path, hits, key)


def from_archive(spark: SparkSession, path: str, wanted: DataFrame, key: str) -> DataFrame:
    """Archived rows with the keys of `wanted` (key, month): only the months that are asked for are read."""
    months = [r[0] for r in wanted.select("month").distinct().collect()]  # calendar months
    rows = spark.read.parquet(path).withColumn("month", F.col("month").cast("string")).where(F.col("month").isin(months))
    return rows.join(wanted.select(key, "month"), [key, "month"], "left_semi")


def compacted(df: DataFrame, key: str, order: list[str], apply: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """One row (rows, keys, dropped, lost): what it comes to if of each key only the last row stays.

    A dry run without `apply`. With it the compacted rows, from the shared folder, are handed to it, but only if no key is lost.
    """
    small = stored(ordered.latest(df, [key], order), "compacted")
    before = df.agg(F.count("*").alias("rows"), F.count_distinct(key).alias("keys"))
    after = small.agg(F.count("*").alias("kept"), F.count_distinct(key).alias("kept_keys"))
    report = before.crossJoin(after).select("rows", "keys", (F.col("rows") - F.col("kept")).alias("dropped"), (F.col("keys") - F.col("kept_keys")).alias("lost"))  # one row each
    if apply is not None:
        if report.first()["lost"]:
            raise ValueError("keys would be lost")
        apply(small)
    return report


def bounded_leaves(df: DataFrame, key: str, size: Column, most_bytes: int, depth: int | None = None) -> DataFrame:
    """`df` with leaf: the file that a row goes to, so that no file has more than `most_bytes`, of whatever number of rows.

    Rows lie in cells by the first digits of their key's SHA-256; cells are merged to the shortest prefix that holds no more than the bound, as in
    a trie that splits until its leaves fit. A cell that is larger by itself, as of one key with many rows, is parted in an order of
    its rows' hashes; only a row that is larger by itself can exceed the bound then. depth: digits of a cell, by default enough for some hundred cells a file.
    """
    rows = df.withColumn("size_", size.cast("long")).withColumn("hash_", F.sha2(F.col(key).cast("string"), 256))
    if depth is None:
        total = rows.agg(F.sum("size_")).first()[0] or 0
        depth = max(2, len(f"{total // most_bytes:x}") + 2)
    rows = rows.withColumn("cell_", F.substring("hash_", 1, depth))
    cells = stored(rows.groupBy("cell_").agg(F.sum("size_").alias("bytes_")), "leaf-cells")
    prefixes = cells.select("cell_", "bytes_", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("digits_")).withColumn("prefix_", F.substr("cell_", F.lit(1), F.col("digits_")))
    sums = prefixes.groupBy("prefix_").agg(F.sum("bytes_").alias("sum_"))
    fitting = prefixes.join(sums, "prefix_").groupBy("cell_").agg(F.min(F.when(F.col("sum_") <= most_bytes, F.col("digits_"))).alias("digits_"), F.first("bytes_").alias("bytes_"))
    whole = fitting.select("cell_", F.when(F.col("digits_").isNotNull(), F.substr("cell_", F.lit(1), F.col("digits_"))).alias("leaf_"))
    placed = stored(rows.join(whole, "cell_"), "leaf-rows")
    # what is too large by itself is cut by running sums, half a bound at a time; a row of more than half takes a file of its own
    large, own = placed.where("leaf_ is null"), placed.where("leaf_ is not null").withColumn("leaf", F.concat(F.lit("p"), "leaf_"))
    if not large.limit(1).count():
        return own.select(*df.columns, "leaf")
    half = max(most_bytes // 2, 1)
    alone = F.col("size_") > half
    weighed = large.withColumn("weight_", F.when(alone, 2 * half).otherwise(F.col("size_"))).withColumn("tie_", F.xxhash64(*[F.col(c) for c in df.columns]))
    summed = ordered.running_sums(weighed, "cell_", ["hash_", "tie_"], "weight_")
    part = F.floor((F.col("running_") - F.col("weight_")) / half).cast("string")
    parted = summed.withColumn("leaf", F.concat(F.lit("p"), "cell_", F.lit("-"), part, F.when(alone, "x").otherwise("")))
    return own.select(*df.columns, "leaf").unionByName(parted.select(*df.columns, "leaf"))


def write_bounded(df: DataFrame, path: str, key: str, size: Column, most_bytes: int) -> DataFrame:
    """Writes a folder with one file for each leaf, and returns the manifest: (leaf, rows, bytes, keys)."""
    leaves = stored(bounded_leaves(df, key, size, most_bytes), "leaves")
    leaves.repartition("leaf").write.mode("overwrite").partitionBy("leaf").parquet(path)
    return leaves.groupBy("leaf").agg(F.count("*").alias("rows"), F.sum(size.cast("long")).alias("bytes"), F.count_distinct(key).alias("keys"))


#: A snapshot of more bytes than this is kept compressed, and no file has more than this after that; fixed.
RETAINED_PLAIN, RETAINED_FILE = 8 << 20, 64 << 20


def write_retained(df: DataFrame, path: str, order: list[str], plain: int = RETAINED_PLAIN, a_file: int = RETAINED_FILE) -> str:
    """Writes a snapshot as JSON lines in order, plain or, above a size, gzipped; the codec, none or gzip.

    The same rows give the same lines in the same files, so a snapshot that did not change looks the same to whoever compares it. Rows are ordered by
    ranges, and there are as many files as their bytes need.
    """
    line = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    size = df.agg(F.sum(F.octet_length(line) + 1)).first()[0] or 0
    codec = "gzip" if size > plain else "none"
    files = max(1, -(-size // a_file))
    rows = df.repartitionByRange(files, *order).sortWithinPartitions(*order) if files > 1 else df.coalesce(1).sortWithinPartitions(*order)
    rows.select(line.alias("value")).write.mode("overwrite").option("compression", codec).text(path)
    return codec


def write_if_changed(df: DataFrame, path: str, listed: DataFrame | None, partition: str, key: str) -> tuple[DataFrame, bool]:
    """Writes `df` unless its manifest is the one that is listed already; the manifest, and whether anything was written."""
    now = history.manifest(df, partition, key)
    if listed is not None and not history.manifest_faults(df, listed, partition, key).limit(1).count():
        return now, False
    return write_shards(df, path, partition, key), True


def upserted(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The table with changed rows in the place of old ones, and new rows; `changes` has one row of a key."""
    return table.join(changes.select(key), key, "left_anti").unionByName(changes)
