"""Queries of tiers, overlaps, freshness and queues."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidstream.operators import tiers
from bidstream.plans.notices import NOTICES_SQL, notices, now
from bidstream.sources import queues
from bidstream.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""
WITH {NOTICES_SQL}, q AS (SELECT * FROM notices WHERE id % 20 = 0)
SELECT query, id, min(tier)::INTEGER AS tier FROM (
  SELECT q.id AS query, n.id, 0 AS tier FROM q JOIN notices n USING (buyer_id) WHERE q.id <> n.id
  UNION ALL SELECT q.id, n.id, 1 FROM q JOIN notices n USING (nation, segment, day) WHERE q.id <> n.id
  UNION ALL SELECT q.id, n.id, 2 FROM q JOIN notices n USING (region, priority, status, day) WHERE q.id <> n.id) GROUP BY ALL
""")
def related_tiers(spark, d):
    """For every twentieth notice: others of its buyer, of its market and day, of its region's like."""
    rows = notices(spark, d)
    return tiers.tiered(rows.where("id % 20 = 0"), rows, "id", [["buyer_id"], ["nation", "segment", "day"], ["region", "priority", "status", "day"]])


@query("""
WITH s AS (SELECT DISTINCT l_suppkey AS supplier, l_orderkey AS id, l_orderkey % 20 = 0 AS asked FROM lineitem)
SELECT supplier, id, asked, count(*) FILTER (asked) OVER w AS asking, count(*) OVER w AS members FROM s
WINDOW w AS (PARTITION BY supplier) QUALIFY asking > 0
""")
def supplier_overlap_classes(spark, d):
    """Every twentieth order asks: the suppliers of these, with all orders that share them, and how many ask and are there."""
    held = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set("l_suppkey").alias("ids"))
    return tiers.overlap_classes(held.where("id % 20 = 0"), held, "ids", "id").withColumnRenamed("id_", "supplier")


@query("""
WITH s AS (SELECT l_orderkey AS id, list_sort(list(DISTINCT l_suppkey)) AS ids FROM lineitem GROUP BY 1), e AS (SELECT id, ids, unnest(ids) AS supplier FROM s),
pairs AS (SELECT a.id FROM e a JOIN e b USING (supplier) WHERE a.id % 20 = 0 AND a.id <> b.id AND list_intersect(a.ids, b.ids).list_min() = supplier),
links AS (SELECT id, count(*) AS links FROM pairs GROUP BY 1)
SELECT supplier, id, id % 20 = 0 AS asked, count(*) FILTER (id % 20 = 0) OVER w AS asking, count(*) OVER w AS members, CASE WHEN id % 20 = 0 THEN coalesce(links, 0) END AS links FROM e LEFT JOIN links USING (id)
WINDOW w AS (PARTITION BY supplier) QUALIFY asking > 0
""")
def supplier_overlap(spark, d):
    """As supplier_overlap_classes, and of each order that asks how many other orders share a supplier with it, over all pairs of these."""
    held = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set("l_suppkey").alias("ids"))
    asking = held.where("id % 20 = 0")
    classes = tiers.overlap_classes(asking, held, "ids", "id").withColumnRenamed("id_", "supplier")
    return classes.join(tiers.overlap_links(asking, held, "ids", "id"), "id", "left").select("supplier", "id", "asked", "asking", "members", "links")


@query("""
SELECT event_id, ts > TIMESTAMP '2024-01-20 09:30:00' - INTERVAL 1 DAY AND ts <= TIMESTAMP '2024-01-20 09:30:00' AS new,
  ts::DATE = DATE '2024-01-20' AND ts <= TIMESTAMP '2024-01-20 09:30:00' AS added_today FROM events
""")
def fresh_rows(spark, d):
    """New within a day, and added on London's calendar day, which in January is UTC's."""
    at = F.col("ts").cast("timestamp_ntz")
    flags = tiers.freshness(at, at, now("2024-01-20 09:30:00"))
    return table(spark, d, "events").select("event_id", flags["new"].alias("new"), flags["added_today"].alias("added_today"))


@query("""
SELECT user_id, row_number() OVER (ORDER BY labels, user_id) AS rank FROM (
  SELECT user_id, string_agg(DISTINCT event_type, chr(0) ORDER BY event_type) AS labels FROM events GROUP BY user_id) QUALIFY rank <= 50
""")
def label_sequence(spark, d):
    """The first fifty users in order of their labels."""
    from bidstream.operators.search import ranked

    held = table(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("labels"))
    rows = held.select("user_id", tiers.label_order(F.col("labels")).alias("label_key"))
    return ranked(rows, [F.col("label_key"), F.col("user_id")], 50).select("user_id", "rank")


@query("""
SELECT o_orderkey FROM orders WHERE NOT (o_orderkey % 2 = 0 AND (o_orderkey % 5 > 0 OR o_orderdate < o_orderdate) AND o_orderkey % 3 > 0)
""")
def pages_to_hydrate(spark, d):
    """Even rows are cached; of these every third is stale and every fifth has changed."""
    listing = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("sig"))
    fetched = F.when(F.col("o_orderkey") % 3 == 0, now("2001-05-30 00:00:00")).otherwise(now("2001-06-01 00:00:00"))
    sig = F.when(F.col("o_orderkey") % 5 == 0, "changed").otherwise(F.col("sig"))
    cache = listing.where("o_orderkey % 2 = 0").withColumn("fetched_at", fetched).withColumn("sig", sig)
    return queues.to_hydrate(listing, cache, "o_orderkey", "sig", now("2001-06-01 12:00:00")).select("o_orderkey")


@query("SELECT count(*) AS rows, count(DISTINCT o_orderkey) AS keys, 1::BIGINT AS revisions, true AS complete FROM orders")
def snapshot_complete(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", F.lit("r1").alias("revision"))
    return queues.completeness(orders, "o_orderkey", orders.count(), "revision")


@query("""
SELECT doc_id, number FROM (SELECT doc_id, unnest(list_distinct(list_transform(range(1, 3), lambda i: (doc_id % 9) || '-' || (2000 + doc_id % 3)))) AS number FROM documents)
""")
def control_number_keys(spark, d):
    """Notice numbers that a text writes with zeros and either dash are one key."""
    year = (2000 + F.col("doc_id") % 3).cast("string")
    n = (F.col("doc_id") % 9).cast("string")
    text = F.concat(F.lit("see 000"), n, F.lit("-"), year, F.lit(" and "), n, F.lit("/"), year, F.lit("."))
    return table(spark, d, "documents").select("doc_id", F.explode(tiers.control_numbers(text)).alias("number"))


#: Names that the whole queries had beside ones of a part, which is asked no more.
for _old, _name in (("related_tiers_whole", "related_tiers"), ("label_sequence_whole", "label_sequence")):
    QUERIES[_old], SQL[_old] = QUERIES[_name], SQL[_name]
