"""Queries of state in streams: retries that wait and pages that are confirmed, over the events."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from bidstream.sources import windowed
from bidstream.sources.shared import shared_dir
from bidstream.sources.tables import table
from bidstream.streaming import inventory

QUERIES, SQL = {}, {}
#: Parts by time that the stream reads one after the other, and after how many of them it is stopped and started anew; what came since is one micro-batch.
PARTS, STOP = 4, 1


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _streamed(spark, events, processor, *more):
    """What a processor tells of the events, read in order of time in several runs, each of which goes on from the checkpoint of the one before.

    Parts are cut by time, to the millisecond as timers are, since ids need not follow it and a late row would be lost. Each is written by as many tasks as read it.
    """
    inventory.with_state_store(spark)
    top = f"{shared_dir(spark)}/inventory-{uuid.uuid4().hex}"
    at = F.unix_millis("ts")
    low, high = (x or 0 for x in events.agg(F.min(at), F.max(at)).first())
    step = (high - low) // PARTS + 1
    for p in range(PARTS):
        events.where(at.between(low + p * step, low + (p + 1) * step - 1)).write.mode("append").parquet(f"{top}/in")
        if (p + 1) % STOP == 0 or p + 1 == PARTS:
            source = spark.readStream.schema(events.schema).parquet(f"{top}/in")
            inventory.drain(inventory.told(source, F.col("user_id"), F.col("ts"), processor, *more), f"{top}/out", f"{top}/checkpoint")
    return spark.read.parquet(f"{top}/out").drop("batch")


@query("""
WITH e AS (SELECT user_id::VARCHAR AS key, epoch_us(ts) // 1000 AS at_ms, event_id, event_type = 'purchase' AS ok FROM events WHERE event_type IN ('error', 'purchase')),
g AS (SELECT *, coalesce(sum(ok::INT) OVER (PARTITION BY key ORDER BY at_ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp, lead(at_ms) OVER (PARTITION BY key ORDER BY at_ms, event_id) AS next_ms FROM e),
n AS (SELECT *, count(*) FILTER (NOT ok) OVER (PARTITION BY key, grp ORDER BY at_ms, event_id) AS attempts FROM g),
d AS (SELECT *, at_ms + 600000 * pow(2, least(attempts - 1, 5))::BIGINT AS due_ms FROM n)
SELECT key, at_ms, 'waiting' AS status, attempts, due_ms FROM d WHERE NOT ok
UNION ALL SELECT key, at_ms, 'done', attempts, NULL FROM d WHERE ok AND attempts > 0
UNION ALL SELECT key, due_ms, 'due', attempts, due_ms FROM d WHERE NOT ok AND due_ms <= coalesce(next_ms, (SELECT max(at_ms) FROM e))
""")
def retry_queue(spark, d):
    """Users' errors as failures that wait ten minutes and more, their purchases as the success that ends it."""
    events = table(spark, d, "events").where("event_type in ('error', 'purchase')").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "purchase").alias("ok"))
    return _streamed(spark, events, inventory.Retries(600_000), F.col("ok"), F.col("event_id").alias("tie"))


@query("""
WITH e AS (SELECT user_id::VARCHAR AS key, epoch_us(ts) // 1000 AS at_ms, event_id, event_type AS digest FROM events),
p AS (SELECT *, lag(at_ms) OVER w AS was, lag(digest) OVER w AS before, lead(at_ms) OVER w AS next_ms FROM e WINDOW w AS (PARTITION BY key ORDER BY at_ms, event_id)),
s AS (SELECT *, was IS NULL OR at_ms >= was + 5400000 AS fresh FROM p),
r AS (SELECT *, sum((fresh OR digest <> before)::INT) OVER (PARTITION BY key ORDER BY at_ms, event_id) AS run FROM s),
t AS (SELECT *, row_number() OVER (PARTITION BY key, run ORDER BY at_ms, event_id) AS times FROM r)
SELECT key, at_ms, CASE WHEN fresh THEN 'read' WHEN digest <> before THEN 'changed' ELSE 'verified' END AS status, times AS attempts, at_ms + 5400000 AS due_ms FROM t WHERE times <= 2
UNION ALL SELECT key, at_ms + 5400000, 'forgotten', times, NULL FROM t WHERE at_ms + 5400000 <= coalesce(next_ms, (SELECT max(at_ms) FROM e))
""")
def pages_confirmed(spark, d):
    """Users as pages, what they do as a page's digest: confirmed by two readings alike in a row, forgotten after ninety minutes."""
    events = table(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("digest"))
    return _streamed(spark, events, inventory.Confirmations(5_400_000), F.col("digest"), F.col("event_id").alias("tie"))


#: Orders by status as lanes, windows of so many days, so many a batch; open orders have a reserve.
LANES = {"O": {"first": "1995-01-01", "last": "2001-12-31", "reserved": 2}, "F": {"first": "1995-01-01", "last": "1999-06-30"}, "P": {"first": "1997-01-01", "last": "1997-12-31"}}
DAYS, BUDGET = 100, 5


@query(f"""
WITH RECURSIVE lanes AS (SELECT * FROM (VALUES ('O', DATE '1995-01-01', DATE '2001-12-31'), ('F', DATE '1995-01-01', DATE '1999-06-30'), ('P', DATE '1997-01-01', DATE '1997-12-31')) t(lane, first, last)),
sizes AS (SELECT max(n) FILTER (lane = 'O') AS o, max(n) FILTER (lane = 'F') AS f, max(n) FILTER (lane = 'P') AS p FROM (SELECT lane, ((last - first + 1) + {DAYS - 1}) // {DAYS} AS n FROM lanes)),
steps(batch, left_, turn, a, b, c) AS (
  SELECT 0, {BUDGET}, 0, 0::BIGINT, 0::BIGINT, 0::BIGINT
  UNION ALL SELECT CASE WHEN left_ = 0 THEN batch + 1 ELSE batch END, CASE WHEN left_ = 0 THEN {BUDGET} WHEN turn < 2 THEN left_ - (a < o)::INT ELSE left_ - CASE (turn - 2) % 3 WHEN 0 THEN (a < o)::INT WHEN 1 THEN (b < f)::INT ELSE (c < p)::INT END END,
    CASE WHEN left_ = 0 THEN 0 ELSE turn + 1 END, a + (left_ > 0 AND a < o AND (turn < 2 OR (turn - 2) % 3 = 0))::INT, b + (left_ > 0 AND turn >= 2 AND (turn - 2) % 3 = 1 AND b < f)::INT, c + (left_ > 0 AND turn >= 2 AND (turn - 2) % 3 = 2 AND c < p)::INT
  FROM steps, sizes WHERE a < o OR b < f OR c < p),
ends AS (SELECT batch, max(a) AS a, max(b) AS b, max(c) AS c FROM steps GROUP BY batch),
r AS (SELECT o_orderkey, o_orderstatus AS lane, (o_orderdate::DATE - first)::BIGINT // {DAYS} AS number FROM orders JOIN lanes ON lane = o_orderstatus AND o_orderdate::DATE BETWEEN first AND last)
SELECT o_orderkey, lane, number::INTEGER AS number, (SELECT min(batch) FROM ends WHERE CASE lane WHEN 'O' THEN a WHEN 'F' THEN b ELSE c END > number)::INTEGER AS batch FROM r
""")
def windows_drained(spark, d):
    """Orders by windows of a hundred days, five windows a micro-batch, lanes in turns; stopped after two batches and started anew."""
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("lane"), F.col("o_orderdate").cast("date").alias("day"))
    top = f"{shared_dir(spark)}/windows-{uuid.uuid4().hex}"
    read = lambda w: windowed.read_windows(orders, "lane", "day", w).select("o_orderkey", "lane", "number")
    for most in (2, None):
        windowed.drain_windows(windowed.windows_stream(spark, LANES, DAYS, BUDGET), read, f"{top}/out", f"{top}/checkpoint", most)
    return spark.read.parquet(f"{top}/out").select("o_orderkey", "lane", "number", F.col("batch").cast("int").alias("batch"))
