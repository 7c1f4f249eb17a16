"""Queries of revisions, snapshots, windows and increments, over events and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidstream.functions.dates import micros
from bidstream.operators import history, identity, ordered, snapshots
from bidstream.plans.notices import EVENTS_NOW, now
from bidstream.sources.tables import table
from bidstream.streaming import incremental

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def events(spark, d):
    return table(spark, d, "events").withColumn("at_us", micros(F.col("ts")))


#: A revision without a value, as publishers send them: every third.
def _sparse():
    return F.when(F.col("event_id") % 3 != 0, F.col("value"))


_SPARSE_SQL = "CASE WHEN event_id % 3 <> 0 THEN value END"


@query("""
SELECT user_id, event_type, event_id, value, epoch_us(ts) AS at_us FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1
""")
def latest_revision(spark, d):
    rows = events(spark, d).select("user_id", "event_type", "event_id", "value", "at_us")
    return ordered.latest(rows, ["user_id", "event_type"], ["at_us", "event_id"])


@query(f"""
SELECT event_id, user_id, last_value({_SPARSE_SQL} IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS known_value FROM events
""")
def latest_ignoring_nulls(spark, d):
    rows = events(spark, d).select("event_id", "user_id", "at_us", _sparse().alias("known_value"))
    return ordered.filled_forward(rows, ["user_id"], ["at_us", "event_id"], ["known_value"]).drop("at_us")


@query(f"""
WITH e AS (SELECT user_id, ts, event_id, {_SPARSE_SQL} AS v, CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS kind FROM events)
SELECT user_id, arg_max(v, (ts, event_id)) FILTER (v IS NOT NULL) AS value, arg_max(kind, (ts, event_id)) FILTER (kind <> '') AS kind, count(*) AS revisions FROM e GROUP BY user_id
""")
def sparse_merge(spark, d):
    """Empty fields change nothing; each column's last fact stays."""
    rows = events(spark, d).select("user_id", "at_us", "event_id", _sparse().alias("value"), F.when(F.col("event_type") != "error", F.col("event_type")).otherwise("").alias("kind"))
    return identity.merged_revisions(rows, ["user_id"], ["at_us", "event_id"], ["value", "kind"])


def _days(spark, d):
    """For each day, the last value of each user who appears: a publisher's snapshot of that day."""
    rows = events(spark, d).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return ordered.latest(rows.select("user_id", "day", "event_id", "at_us", "event_type"), ["user_id", "day"], ["at_us", "event_id"])


_DAYS_SQL = """days AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_type FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d') ORDER BY ts DESC, event_id DESC) = 1)"""


@query(f"""
WITH {_DAYS_SQL}, a AS (FROM days WHERE day = '2024-01-10'), b AS (FROM days WHERE day = '2024-01-11')
SELECT user_id, CASE WHEN a.user_id IS NULL THEN 'new' WHEN b.user_id IS NULL THEN 'gone' ELSE 'changed' END AS change
FROM a FULL JOIN b USING (user_id) WHERE a.event_type IS DISTINCT FROM b.event_type
""")
def snapshot_diff(spark, d):
    days = _days(spark, d)
    return snapshots.differences(days.where("day = '2024-01-10'"), days.where("day = '2024-01-11'"), "user_id", "event_type")


@query("""
WITH listed AS (SELECT DISTINCT user_id, strftime(ts, '%Y-%m-%d') AS day FROM events WHERE event_type <> 'view')
SELECT user_id, max(day) AS last_listed FROM listed GROUP BY user_id
HAVING max(day) < (SELECT min(day) FROM (SELECT DISTINCT day FROM listed ORDER BY day DESC LIMIT 2))
""")
def two_snapshot_absence(spark, d):
    listed = events(spark, d).where("event_type <> 'view'").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).distinct()
    return snapshots.absent_twice(listed, "user_id", "day")


@query(f"""
WITH e AS (SELECT *, date_diff('second', ts, TIMESTAMP '{EVENTS_NOW}') AS age FROM events WHERE ts <= TIMESTAMP '{EVENTS_NOW}'), m AS (
  SELECT event_id, event_type,
    row_number() OVER (PARTITION BY event_type, ts::DATE ORDER BY ts DESC, event_id DESC) = 1 AND ts >= TIMESTAMP '{EVENTS_NOW}' - INTERVAL 7 DAY AS daily,
    row_number() OVER (PARTITION BY event_type, date_trunc('week', ts) ORDER BY ts DESC, event_id DESC) = 1 AND ts >= TIMESTAMP '{EVENTS_NOW}' - INTERVAL 28 DAY AS weekly FROM e)
FROM m WHERE daily OR weekly
""")
def daily_weekly_retention(spark, d):
    return ordered.rotation(events(spark, d), "event_type", "ts", "event_id", now(EVENTS_NOW)).select("event_id", "event_type", "daily", "weekly")


@query("""
SELECT event_id, count(*) OVER w AS in_window, (sum((value * 100)::BIGINT) OVER w)::BIGINT AS cents FROM events
WINDOW w AS (PARTITION BY user_id % 10 ORDER BY epoch(date_trunc('second', ts))::BIGINT RANGE BETWEEN 61 PRECEDING AND CURRENT ROW)
""")
def sliding_61s(spark, d):
    rows = events(spark, d).select("event_id", (F.col("user_id") % 10).alias("lane"), F.floor(F.col("at_us") / 1000000).alias("sec"), F.round(F.col("value") * 100).cast("long").alias("amount"))
    return ordered.sliding(rows, ["lane"], F.col("sec"), 61, "amount").select("event_id", "in_window", F.col("sum_window").alias("cents"))


@query("SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS turn FROM documents")
def round_robin(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    return ordered.round_robin(docs, "source", [F.desc("n_chars"), "doc_id"]).select("doc_id", "source", "turn")


@query("""
SELECT user_id, string_agg(event_id::VARCHAR, ',' ORDER BY ts, event_id) AS last_ids FROM (
  SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 30) GROUP BY user_id
""")
def keep_last_n(spark, d):
    kept = ordered.last_n(events(spark, d), ["user_id"], ["at_us", "event_id"], 30, "items")
    return kept.select("user_id", F.array_join(F.transform("items", lambda x: x["event_id"].cast("string")), ",").alias("last_ids"))


@query("""
SELECT event_id, user_id, event_type FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type, ts::DATE ORDER BY ts DESC, event_id DESC) = 1
""")
def same_day_repeat(spark, d):
    rows = events(spark, d).select("event_id", "user_id", "event_type", "ts", "at_us")
    return ordered.once_a_day(rows, ["user_id", "event_type"], "ts", ["at_us", "event_id"]).select("event_id", "user_id", "event_type")


@query("""
WITH u AS (
  SELECT o_orderkey AS id, 0 AS p, 'rejected' AS store FROM orders WHERE o_orderkey % 2 = 0
  UNION ALL SELECT o_orderkey, 1, 'archive' FROM orders WHERE o_orderkey % 3 = 0
  UNION ALL SELECT o_orderkey, 2, 'canonical' FROM orders WHERE o_orderkey % 5 = 0)
SELECT id, arg_max(store, p) AS store FROM u GROUP BY id
""")
def precedence_union(spark, d):
    """Three stores that overlap; the most canonical has the say."""
    keys = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    frames = [keys.where(F.col("id") % m == 0).withColumn("store", F.lit(s)) for m, s in ((2, "rejected"), (3, "archive"), (5, "canonical"))]
    return ordered.by_precedence(frames, ["id"])


@query("""
SELECT c_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderdate DESC, o_orderkey DESC) AS order_ids, count(*) AS n FROM customer
JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey
""")
def buyer_timeline(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderdate", "o_orderkey")
    lines = history.timeline(rows.join(table(spark, d, "customer").select("c_custkey"), "c_custkey", "left_semi"), "c_custkey", ["o_orderdate", "o_orderkey"], "items", newest_first=True)
    return lines.select("c_custkey", F.array_join(F.transform("items", lambda x: x["o_orderkey"].cast("string")), ",").alias("order_ids"), F.size("items").cast("long").alias("n"))


@query("""
SELECT l_orderkey, string_agg(l_linenumber::VARCHAR || ':' || l_partkey::VARCHAR, ',' ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey) AS lots FROM lineitem GROUP BY l_orderkey
""")
def procedure_timeline(spark, d):
    lines = history.timeline(table(spark, d, "lineitem"), "l_orderkey", ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey"], "items")
    return lines.select("l_orderkey", F.array_join(F.transform("items", lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string"))), ",").alias("lots"))


@query("""
SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 450000)
OR o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 49)
""")
def history_semi(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    buyers = orders.where("o_orderstatus = 'O' and o_totalprice > 450000").select("o_custkey", F.lit(None).cast("long").alias("o_orderkey"))
    lots = table(spark, d, "lineitem").where("l_returnflag = 'R' and l_quantity > 49").select(F.lit(None).cast("long").alias("o_custkey"), F.col("l_orderkey").alias("o_orderkey"))
    return history.in_published_scope(orders, buyers.unionByName(lots), ["o_custkey", "o_orderkey"]).select("o_orderkey")


@query("""
WITH lots AS (SELECT DISTINCT l_orderkey AS procedure, l_linenumber AS lot FROM lineitem),
awards AS (SELECT DISTINCT l_orderkey AS procedure, l_linenumber AS lot FROM lineitem WHERE l_returnflag <> 'N'),
s AS (SELECT procedure, lot, CASE WHEN a.lot IS NULL THEN 'active' ELSE 'awarded' END AS status FROM lots LEFT JOIN awards a USING (procedure, lot))
SELECT procedure, lot, status, bool_and(status = 'awarded') OVER (PARTITION BY procedure) AS complete FROM s
""")
def lot_award_propagation(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("procedure"), F.col("l_linenumber").alias("lot"), "l_returnflag")
    lots = lines.select("procedure", "lot").distinct().withColumn("status", F.lit("active"))
    return history.settled_lots(lots, lines.where("l_returnflag <> 'N'")).select("procedure", "lot", "status", "complete")


@query("""
WITH RECURSIVE keyed AS (SELECT DISTINCT l_orderkey AS id, l_partkey || '/' || l_suppkey AS k FROM lineitem),
hubs AS (SELECT k, min(id) AS hub FROM keyed GROUP BY k),
edges AS (SELECT DISTINCT id AS a, hub AS b FROM keyed JOIN hubs USING (k) WHERE id <> hub UNION SELECT DISTINCT hub, id FROM keyed JOIN hubs USING (k) WHERE id <> hub),
cc(id, c) USING KEY (id) AS (
  SELECT DISTINCT id, id FROM keyed
  UNION
  SELECT e.b, min(r.c) FROM cc r JOIN edges e ON e.a = r.id JOIN recurring.cc old ON old.id = e.b WHERE r.c < old.c GROUP BY e.b)
SELECT id, c AS component FROM cc
""")
def identity_components(spark, d):
    """Orders that line items of one part and supplier tie together, through any number of others."""
    keyed = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.concat_ws("/", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("key")).distinct()
    return identity.key_components(keyed, "id", "key")


#: The name that the whole query had beside one of a part.
QUERIES["identity_components_whole"], SQL["identity_components_whole"] = QUERIES["identity_components"], SQL["identity_components"]


@query("SELECT user_id, event_id, epoch_us(ts) AS at_us, sha256('[\"k' || event_id % 3 || '\",\"' || value::VARCHAR || '\"],[\"type\",\"' || event_type || '\"]') AS digest, true AS alike FROM events")
def version_pack_roundtrip(spark, d):
    """Versions that were packed into patches, as they come back: a digest of their facts, and whether it is the one before."""
    facts = F.map_from_arrays(F.array(F.lit("type"), F.concat(F.lit("k"), (F.col("event_id") % 3).cast("string"))), F.array(F.col("event_type"), F.col("value").cast("string")))
    versions = events(spark, d).select("user_id", "at_us", "event_id", facts.alias("facts"))
    back = history.unpacked(history.packed(versions, "user_id", ["at_us", "event_id"], "facts"), "user_id", ["at_us", "event_id"], "facts")
    now_ = history.map_digest(F.col("facts"))
    return back.select("user_id", "event_id", "at_us", now_.alias("digest"), now_.eqNullSafe(F.col("digest")).alias("alike"))


@query(f"""
SELECT user_id, arg_max(({_SPARSE_SQL})::VARCHAR, (ts, event_id)) FILTER ({_SPARSE_SQL} IS NOT NULL) AS value, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id
""")
def stream_replay_equal(spark, d):
    """Records after four batches that come in no order of time."""
    rows = events(spark, d).select("user_id", "at_us", "event_id", _sparse().alias("value"), "event_type")
    return incremental.replayed(rows, F.pmod(F.xxhash64("event_id"), F.lit(4)), 4, ["user_id"], ["at_us", "event_id"], ["value", "event_type"])


@query("SELECT conv_id, turn, role, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn), 'none') AS before, count(*) OVER (PARTITION BY conv_id) AS turns FROM conversations")
def conversation_turns(spark, d):
    from pyspark.sql import Window as W

    w = W.partitionBy("conv_id")
    return table(spark, d, "conversations").select(
        "conv_id", "turn", "role", F.coalesce(F.lag("role").over(w.orderBy("turn")), F.lit("none")).alias("before"), F.count("*").over(w).alias("turns")
    )


@query("""
WITH b AS (SELECT o_orderkey AS id, o_orderstatus AS s, o_orderpriority AS p FROM orders),
l AS (SELECT id, CASE WHEN id % 3 = 0 THEN s || 'l' ELSE s END AS s, p FROM b), r AS (SELECT id, CASE WHEN id % 5 = 0 THEN s || 'r' ELSE s END AS s, CASE WHEN id % 7 = 0 THEN NULL ELSE p END AS p FROM b)
SELECT id, CASE WHEN l.s IS NOT DISTINCT FROM b.s THEN r.s ELSE l.s END AS s, CASE WHEN l.p IS NOT DISTINCT FROM b.p THEN r.p ELSE l.p END AS p,
  CASE WHEN id % 15 = 0 THEN 's' ELSE '' END AS conflicts FROM b JOIN l USING (id) JOIN r USING (id)
""")
def three_way_merge(spark, d):
    base = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p"))
    local = base.withColumn("s", F.when(F.col("id") % 3 == 0, F.concat("s", F.lit("l"))).otherwise(F.col("s")))
    remote = base.withColumn("s", F.when(F.col("id") % 5 == 0, F.concat("s", F.lit("r"))).otherwise(F.col("s"))).withColumn("p", F.when(F.col("id") % 7 != 0, F.col("p")))
    return snapshots.merged_three_ways(base, local, remote, "id").withColumn("conflicts", F.array_join("conflicts", ","))
