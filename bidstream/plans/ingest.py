"""Queries of sources and sinks, over orders as feed rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from bidstream.plans.notices import now
from bidstream.sources import feeds, shared, sinks
from bidstream.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT o_orderkey FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 50")
def keyset_page(spark, d):
    """A page of fifty rows after a cursor: the feature."""
    return feeds.keyset_page(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 1000, 50)


@query("""
SELECT DISTINCT user_id, event_type FROM events WHERE ts > TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 6 HOUR AND ts <= TIMESTAMP '2024-01-16 00:00:00'
""")
def overlap_window(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_type", "ts")
    return feeds.overlap_window(rows, "ts", now("2024-01-15 00:00:00"), "6 HOURS", now("2024-01-16 00:00:00"), ["user_id", "event_type"]).drop("ts")


@query("""
SELECT o_custkey % 97 AS page, min(o_orderkey) AS after, max(o_orderkey) AS through, count(*) AS lanes FROM orders GROUP BY 1
""")
def merged_lanes(spark, d):
    return feeds.merged_lanes(table(spark, d, "orders").select((F.col("o_custkey") % 97).alias("page"), F.col("o_orderkey").alias("after"), F.col("o_orderkey").alias("through")))


@query("""
SELECT o_custkey, o_orderdate_day AS day, o_orderstatus FROM (SELECT o_custkey, strftime(o_orderdate, '%Y-%m') AS o_orderdate_day, o_orderstatus, o_orderkey FROM orders)
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate_day DESC, (o_orderstatus = 'F')::INT DESC, o_orderstatus DESC) = 1
""")
def latest_terminal(spark, d):
    """A finished order wins among those of a customer's last month."""
    rows = table(spark, d, "orders").select("o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("day"), "o_orderstatus")
    return feeds.latest_terminal(rows, "o_custkey", "day", F.struct(F.col("o_orderstatus") == "F", "o_orderstatus"))


@query("""
WITH m AS (SELECT o_custkey, max(strftime(o_orderdate, '%Y')) AS y FROM orders GROUP BY o_custkey),
n AS (SELECT o_custkey, count(DISTINCT o_orderstatus) AS n FROM orders JOIN m USING (o_custkey) WHERE strftime(o_orderdate, '%Y') = y GROUP BY o_custkey)
SELECT n > 1 AS conflict, count(*) AS keys FROM n GROUP BY 1
""")
def revision_conflicts(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", F.date_format("o_orderdate", "yyyy").alias("y"), "o_orderstatus")
    good, bad = feeds.latest_or_conflict(rows, "o_custkey", "y", F.col("o_orderstatus"))
    return good.select(F.lit(False).alias("conflict")).union(bad.select(F.lit(True).alias("conflict"))).groupBy("conflict").agg(F.count("*").alias("keys"))


@query("""
SELECT l_orderkey IS NULL OR o_orderkey IS NULL AS waiting, count(*) AS stems FROM
(SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 25) FULL JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O') ON l_orderkey = o_orderkey GROUP BY 1
""")
def paired_archives(spark, d):
    left = table(spark, d, "lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("stem")).distinct()
    right = table(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("stem"))
    both, waiting = feeds.paired(left, right, "stem")
    return both.select(F.lit(False).alias("waiting")).union(waiting.select(F.lit(True).alias("waiting"))).groupBy("waiting").agg(F.count("*").alias("stems"))


@query("""
SELECT coalesce(contains(lower(text), 'license') OR contains(text, ' | '), false) AS relevant, count(*) AS n FROM documents GROUP BY 1
""")
def relevance_gate(spark, d):
    docs = table(spark, d, "documents")
    yes, no = feeds.gated(docs, F.lower("text").contains("license") | F.col("text").contains(" | "))
    return yes.select(F.lit(True).alias("relevant")).union(no.select(F.lit(False).alias("relevant"))).groupBy("relevant").agg(F.count("*").alias("n"))


@query("SELECT 'ocds-' || o_orderkey AS ocid, o_orderpriority AS title, o_totalprice AS amount FROM orders WHERE o_orderkey % 50 <> 49")
def release_envelopes(spark, d):
    """Releases of payloads in four shapes; every fiftieth payload holds none."""
    value = F.struct(F.col("o_totalprice").alias("amount"), F.lit("EUR").alias("currency"))
    one = F.struct(F.concat(F.lit("ocds-"), F.col("o_orderkey").cast("string")).alias("ocid"), F.col("o_orderkey").cast("string").alias("id"), F.struct(F.col("o_orderpriority").alias("title"), value.alias("value")).alias("tender"))
    shape = F.col("o_orderkey") % 4
    payload = (
        F.when(F.col("o_orderkey") % 50 == 49, F.lit("{}")).when(shape == 0, F.to_json(F.array(one))).when(shape == 1, F.to_json(F.struct(F.array(one).alias("releases"))))
        .when(shape == 2, F.to_json(F.struct(F.array(F.struct(one.alias("compiledRelease"))).alias("records")))).otherwise(F.to_json(one))
    )
    raw = table(spark, d, "orders").select("o_orderkey", payload.alias("payload"))
    return feeds.releases(raw, "payload", "o_orderkey").select("release.ocid", "release.tender.title", "release.tender.value.amount")


@query("""
WITH RECURSIVE w AS (SELECT o_orderkey AS start, o_orderkey AS id, 0 AS depth FROM orders
  UNION ALL SELECT start, id // 3, depth + 1 FROM w WHERE id > 2 AND depth < 5)
SELECT start, id, depth FROM w WHERE id IN (SELECT o_orderkey FROM orders)
""")
def predecessor_walk(spark, d):
    """From every order: corrections lead to a third of their number, five steps at most."""
    ids = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    links = ids.where("id > 2").withColumn("predecessor", F.floor(F.col("id") / 3))
    return feeds.predecessors(links, ids)


@query("SELECT substr(sha256(o_orderkey::VARCHAR), 1, 2) AS bucket, count(*) AS n, min(o_orderkey) AS first_id FROM orders GROUP BY 1")
def hash_buckets(spark, d):
    keyed = table(spark, d, "orders").select("o_orderkey", sinks.bucket_of("o_orderkey").alias("bucket"))
    return keyed.groupBy("bucket").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_id"))


@query("SELECT o_orderstatus, count(*) AS n, sum(o_totalprice::DECIMAL(18, 2))::DOUBLE AS total FROM orders GROUP BY 1")
def market_shards(spark, d):
    """Shards written, verified against their manifest, and read back."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    path = f"{shared.shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    listed = sinks.write_shards(orders, path, "o_orderstatus", "o_orderkey")
    back = sinks.verified(spark, path, listed, "o_orderstatus", "o_orderkey", orders.schema)
    return back.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders UNION ALL SELECT -1, 'N'")
def bucket_upsert(spark, d):
    base = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    changed = base.where("o_orderkey % 10 = 0").withColumn("o_orderstatus", F.lit("X")).union(base.limit(1).select(F.lit(-1).cast("long"), F.lit("N")))
    return sinks.upserted(base, changed, "o_orderkey")


#: The name that the whole query had beside one of a part.
QUERIES["predecessor_walk_whole"], SQL["predecessor_walk_whole"] = QUERIES["predecessor_walk"], SQL["predecessor_walk"]
