"""File-backed feeds: validated snapshots, incremental cursors, envelopes, pairs, predecessors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class SchemaFault(ValueError):
    """A feed that is not as agreed; its cursor must not move."""


def csv_snapshot(
    spark: SparkSession, path: str, schema: T.StructType, key: str, encoding: str = "UTF-8", rows_before: int = 0, least_share: float = 0.75,
) -> DataFrame:
    """A whole CSV snapshot, or SchemaFault: for a missing column, a malformed row, a repeated key, a shrunken file."""
    header = spark.read.option("header", True).option("encoding", encoding).csv(path).columns
    missing = [f.name for f in schema.fields if f.name not in header]
    if missing or len(set(header)) < len(header):
        raise SchemaFault(f"missing columns {missing}, or repeated ones in {header}")
    typed = T.StructType([schema[c] if c in schema.fieldNames() else T.StructField(c, T.StringType()) for c in header] + [T.StructField("malformed_", T.StringType())])
    rows = (
        spark.read.schema(typed).option("header", True).option("encoding", encoding).option("multiLine", True).option("escape", '"')
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "malformed_").csv(path).cache()
    )
    n, bad, keys = rows.agg(F.count("*"), F.count("malformed_"), F.count_distinct(key)).first()
    rows.unpersist()
    if bad or keys < n or n < least_share * rows_before:
        raise SchemaFault(f"{n} rows after {rows_before}, {bad} malformed, {keys} keys")
    return rows.select(*schema.fieldNames())


def latest_or_conflict(df: DataFrame, key: str, at: str, content: Column) -> tuple[DataFrame, DataFrame]:
    """The latest revision of each key, and keys of which two latest ones differ."""
    newest = df.join(df.groupBy(key).agg(F.max(at).alias(at)), [key, at]).withColumn("content_", content)
    state = newest.groupBy(key).agg(F.count_distinct("content_").alias("n_"))
    good = newest.join(state.where("n_ = 1"), key, "left_semi").dropDuplicates([key]).drop("content_")
    return good, state.where("n_ > 1").select(key)


def latest_terminal(df: DataFrame, key: str, at: str, terminal: Column) -> DataFrame:
    """The latest row of each key; at a tie of times a terminal state wins."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(at, terminal)).alias("row")).select(key, "row.*")


def overlap_window(df: DataFrame, at: str, watermark: Column, overlap: str, through: Column, identity: list[str]) -> DataFrame:
    """Rows after the watermark less an overlap, up to a fixed end; repeats of one identity once. The end is the next watermark."""
    return df.where((F.col(at) > watermark - F.expr(f"INTERVAL {overlap}")) & (F.col(at) <= through)).dropDuplicates(identity)


def keyset_page(df: DataFrame, key: str, cursor: int | None, size: int) -> DataFrame:
    """The next `size` rows after a cursor, in order of the key: a pushed-down filter and a top-k, no offset."""
    after = df if cursor is None else df.where(F.col(key) > cursor)
    return after.orderBy(key).limit(size)


def merged_lanes(lanes: DataFrame) -> DataFrame:
    """Lanes (page, after, through) that want the same page become one request for it."""
    return lanes.groupBy("page").agg(F.min("after").alias("after"), F.max("through").alias("through"), F.count("*").alias("lanes"))


def work_queue(partitions: DataFrame, budget: int) -> DataFrame:
    """The next `budget` partitions: untried before failed ones, which go to the back by their last try."""
    return partitions.orderBy(F.col("failed_at").asc_nulls_first(), "partition").limit(budget)


def anchored(page: DataFrame, key: str, anchor: Column | str | int) -> DataFrame:
    """Whether an overlap's anchor is still where it was: one row (found). Without it a feed replays from the front."""
    return page.agg(F.coalesce(F.bool_or(F.col(key) == anchor), F.lit(False)).alias("found"))


def gated(df: DataFrame, relevant: Column) -> tuple[DataFrame, DataFrame]:
    """Relevant rows and the others; nothing is dropped, and an unknown answer is no."""
    yes = F.coalesce(relevant, F.lit(False))
    return df.where(yes), df.where(~yes)


def paired(left: DataFrame, right: DataFrame, stem: str) -> tuple[DataFrame, DataFrame]:
    """Stems in both archives, joined, and those that wait for their other half."""
    both = left.join(right, stem)
    waiting = left.select(stem).join(right.select(stem), stem, "left_anti").union(right.select(stem).join(left.select(stem), stem, "left_anti"))
    return both, waiting


RELEASE = "struct<ocid: string, id: string, date: string, tag: array<string>, tender: struct<title: string, value: struct<amount: double, currency: string>>>"


def releases(df: DataFrame, column: str, key: str) -> DataFrame:
    """(key, release): releases of a JSON payload, be it a list, an object of releases or of records, or one release."""
    schema = f"struct<releases: array<{RELEASE}>, records: array<struct<compiledRelease: {RELEASE}>>, ocid: string>"
    text = F.trim(F.col(column))
    listed = F.from_json(text, f"array<{RELEASE}>")
    whole, one = F.from_json(text, schema), F.from_json(text, RELEASE)
    found = (
        F.when(text.startswith("["), listed).when(whole["releases"].isNotNull(), whole["releases"])
        .when(whole["records"].isNotNull(), F.transform(whole["records"], lambda r: r["compiledRelease"])).when(whole["ocid"].isNotNull(), F.array(one))
    )
    return df.select(key, F.explode(found).alias("release"))


def predecessors(links: DataFrame, starts: DataFrame, most_depth: int = 5) -> DataFrame:
    """(start, id, depth): the rows that corrections (id, predecessor) lead back to, to a depth, each join one step.

    A row that leads back to itself is reached again and kept out; see cyclic().
    """
    step = starts.select(F.col("id").alias("start"), "id").withColumn("depth", F.lit(0)).withColumn("path", F.array("id"))
    out = step
    for depth in range(1, most_depth + 1):
        step = (
            step.join(links.select("id", "predecessor"), "id").where(~F.array_contains("path", F.col("predecessor")))
            .select("start", F.col("predecessor").alias("id"), F.lit(depth).alias("depth"), F.concat("path", F.array("predecessor")).alias("path"))
        )
        out = out.unionByName(step)
    return out.drop("path")


def cyclic(links: DataFrame, most_depth: int = 5) -> DataFrame:
    """Ids that lead back to themselves within a depth: an error of the publisher."""
    step, found = links.select(F.col("id").alias("start"), F.col("predecessor").alias("at")), None
    for _ in range(most_depth):
        back = step.where("start = at").select(F.col("start").alias("id"))
        found = back if found is None else found.union(back)
        step = step.where("start != at").join(links.select(F.col("id").alias("at"), "predecessor"), "at").select("start", F.col("predecessor").alias("at"))
    return found.distinct()
