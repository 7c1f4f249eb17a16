"""Queries of records: reconciliation, duplicates, archives, streams, cursors, listings."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from bidstream.operators import duplicates, listings, reconcile
from bidstream.operators.identity import exact_keys
from bidstream.plans.notices import EVENTS_NOW, now
from bidstream.sources import cursors, sinks
from bidstream.sources.shared import shared_dir
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


def _revisions(spark, d):
    """Events as revisions: a user is a procedure; every fourth revision is sparse, and one of each eleven is a whole snapshot."""
    e = table(spark, d, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    sparse = F.col("event_id") % 4 == 0
    user = F.col("user_id").cast("string")
    return e.select(
        F.col("event_id").alias("id"), "at", F.when(F.col("event_id") % 11 == 0, "whole").otherwise("feed").alias("source"),
        F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("p"), user)).otherwise("").alias("ocid"), "user_id",
        F.when(~sparse, F.col("event_type")).otherwise("").alias("title"), F.when(~sparse & (F.col("event_id") % 3 > 0), F.col("value")).alias("amount"),
        F.when(~sparse, F.concat(F.lit("c"), (F.col("event_id") % 5).cast("string"))).alias("currency"),
        exact_keys(F.lit(""), F.array(F.concat(F.lit("u"), user)), F.array().cast("array<string>"), F.lit("")).alias("keys"),
    )


_ROWS = """
r AS (SELECT event_id AS id, epoch_us(ts) AS seen, user_id, event_id % 11 = 0 AS whole, CASE WHEN event_id % 4 > 0 THEN event_type ELSE '' END AS title,
  CASE WHEN event_id % 4 > 0 AND event_id % 3 > 0 THEN value END AS amount, CASE WHEN event_id % 4 > 0 THEN 'c' || event_id % 5 END AS currency FROM events),
o AS (SELECT *, whole OR title <> '' AS title_ok, whole OR amount IS NOT NULL OR currency IS NOT NULL AS unit_ok FROM r),
g AS (SELECT *, sum(title_ok::INT) OVER w AS tg, sum(unit_ok::INT) OVER w AS ug, row_number() OVER w AS nth FROM o WINDOW w AS (PARTITION BY user_id ORDER BY seen, id)),
s AS (SELECT *, CASE WHEN tg > 0 THEN first_value(title) OVER (PARTITION BY user_id, tg ORDER BY seen, id) END AS title_now,
  CASE WHEN ug > 0 THEN first_value(amount) OVER (PARTITION BY user_id, ug ORDER BY seen, id) END AS amount_now,
  CASE WHEN ug > 0 THEN first_value(currency) OVER (PARTITION BY user_id, ug ORDER BY seen, id) END AS currency_now FROM g),
h AS (SELECT *, array_to_string(list_filter([CASE WHEN title_now IS DISTINCT FROM lag(title_now) OVER w THEN 'title' END,
    CASE WHEN amount_now IS DISTINCT FROM lag(amount_now) OVER w THEN 'amount' END, CASE WHEN currency_now IS DISTINCT FROM lag(currency_now) OVER w THEN 'currency' END], lambda x: x IS NOT NULL), ',') AS fields
  FROM s WINDOW w AS (PARTITION BY user_id ORDER BY seen, id)),
c AS (SELECT *, nth > 1 AND fields <> '' AS changed FROM h)"""

_FACTS = ["title", "amount", "currency"]


@query(f"""
WITH {_ROWS}, last AS (SELECT user_id, min(id) AS record, arg_max(id, (seen, id)) AS last_id, min(seen) AS first_seen, max(seen) AS last_seen, count(*) AS versions,
  count(*) FILTER (changed) AS changes FROM c GROUP BY user_id),
logged AS (SELECT user_id, string_agg(seen || ' ' || fields, ';' ORDER BY seen, fields) AS log FROM (SELECT * FROM c WHERE changed QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seen DESC, fields DESC) <= 30) GROUP BY user_id)
SELECT record, title_now AS title, amount_now AS amount, currency_now AS currency, first_seen, last_seen, versions, changes, coalesce(log, '') AS log
FROM last JOIN c ON c.user_id = last.user_id AND c.id = last_id LEFT JOIN logged ON logged.user_id = last.user_id
""")
def reconcile_fold(spark, d):
    """Records of all revisions: the last facts, the amount and its currency together, snapshots whole, and the log of changes."""
    rows = reconcile.with_records(_revisions(spark, d))
    history = reconcile.revised(rows, "record", ["at", "id"], _FACTS, [["amount", "currency"]], ("whole",))
    out = reconcile.records(history, "record", ["at", "id"], "at", _FACTS)
    log = F.coalesce(F.array_join(F.transform("log", lambda x: F.concat_ws(" ", x["at"].cast("string"), x["fields"])), ";"), F.lit(""))
    return out.withColumn("log", log)


@query("""
WITH e AS (SELECT user_id, epoch_us(ts) AS seen, event_type AS kind, (event_id % 3)::INTEGER AS lot FROM events),
newest AS (SELECT user_id, max(seen) AS newest FROM e GROUP BY user_id),
s AS (SELECT user_id, kind, lot, max(seen) AS last_at FROM e GROUP BY ALL)
SELECT s.user_id, kind, lot, CASE WHEN last_at = newest THEN 'current' ELSE 'superseded' END AS status FROM s JOIN newest USING (user_id)
QUALIFY last_at = newest OR row_number() OVER (PARTITION BY s.user_id, last_at = newest ORDER BY last_at DESC, kind, lot) <= 5
""")
def deadline_history(spark, d):
    """Deadlines that later revisions replace."""
    e = table(spark, d, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_type").alias("kind"), (F.col("event_id") % 3).cast("int").alias("lot"))
    return reconcile.deadline_history(e, "user_id", "at", ["kind", "lot"], most=5)


@query("""
WITH v AS (SELECT user_id, event_type AS source, event_id % 7 AS release, max(epoch_us(ts)) AS seen FROM events GROUP BY ALL)
SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seen DESC, source, release) <= 10
""")
def provenance_versions(spark, d):
    """The last ten versions of each record."""
    e = table(spark, d, "events").select("user_id", F.col("event_type").alias("source"), (F.col("event_id") % 7).alias("release"), F.unix_micros(F.col("ts").cast("timestamp")).alias("seen"))
    return reconcile.provenance(e, "user_id", ["source", "release"], "seen", most=10)


@query("""
WITH d AS (SELECT l_orderkey, l_suppkey % 4 AS url, arg_max(l_partkey, (l_shipdate, l_linenumber, l_partkey, l_suppkey)) AS part, min((l_shipdate, l_linenumber, l_partkey, l_suppkey)) AS came FROM lineitem GROUP BY ALL)
SELECT l_orderkey, url, part FROM d QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY came DESC, url DESC) <= 3
""")
def documents_by_url(spark, d):
    """Of a procedure's documents with one address the last, three at most."""
    lines = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 4).alias("url"), F.col("l_partkey").alias("part"), "l_shipdate", "l_linenumber", F.col("l_partkey").alias("p"), "l_suppkey")
    return reconcile.last_by_url(lines, "l_orderkey", ["l_shipdate", "l_linenumber", "p", "l_suppkey"], most=3).select("l_orderkey", "url", "part")


@query("""
WITH lots AS (SELECT DISTINCT l_orderkey AS procedure, l_linenumber AS lot FROM lineitem),
awards AS (SELECT DISTINCT l_orderkey AS procedure, l_linenumber AS lot FROM lineitem WHERE l_returnflag <> 'N' AND l_suppkey % 10 > 0 AND l_partkey % 3 > 0),
s AS (SELECT procedure, lot, 'active' AS source_status, CASE WHEN a.lot IS NULL THEN 'active' ELSE 'awarded' END AS status FROM lots LEFT JOIN awards a USING (procedure, lot))
SELECT *, CASE WHEN bool_and(status = 'awarded') OVER (PARTITION BY procedure) THEN 'complete' END AS procedure_status FROM s
""")
def lot_award_rollback(spark, d):
    """Lots that awards settle; every tenth supplier's award was withdrawn, and a third of them never became active, so their lots fall back."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("procedure"), F.col("l_linenumber").alias("lot"), "l_returnflag", "l_suppkey", "l_partkey")
    awards = lines.where("l_returnflag <> 'N'").select(
        "procedure", F.array("lot").alias("lot_ids"), F.when(F.col("l_suppkey") % 10 == 0, "Withdrawn").otherwise("active").alias("status"),
        F.when(F.col("l_partkey") % 3 == 0, F.array(F.lit("pending"))).when(F.col("l_partkey") % 3 == 1, F.array(F.lit("active"))).alias("award_statuses"),
    )
    return reconcile.lot_outcomes(lines.select("procedure", "lot").distinct().withColumn("status", F.lit("active")), awards)


@query("""
WITH b AS (SELECT user_id, count(*) AS v, count(DISTINCT event_type) AS c FROM events WHERE event_id % 5 > 0 GROUP BY user_id), a AS (SELECT user_id, count(*) AS v, count(DISTINCT event_type) AS c FROM events GROUP BY user_id)
SELECT count(*) FILTER (b.v IS NULL) AS new_records, count(*) FILTER (a.c > coalesce(b.c, 0)) AS material_updates, sum(a.v - coalesce(b.v, 1))::BIGINT AS merged FROM a LEFT JOIN b USING (user_id)
""")
def run_counts(spark, d):
    state = lambda rows: rows.groupBy("user_id").agg(F.count("*").alias("versions"), F.count_distinct("event_type").alias("changes"))
    e = table(spark, d, "events")
    return reconcile.run_counts(state(e.where("event_id % 5 > 0")), state(e), "user_id")


@query("""
WITH RECURSIVE a AS (SELECT o_orderkey, o_custkey, o_orderpriority AS p, o_totalprice AS v, o_orderdate AS t FROM orders),
c AS (SELECT min(o_orderkey) AS id, o_custkey, p, v, t FROM a GROUP BY ALL),
f AS (SELECT 2 * id AS id, 0 AS feed, o_custkey, p, v, t FROM c UNION ALL
  SELECT 2 * id + 1, 1, o_custkey, p, v * (CASE WHEN id % 3 = 0 THEN 1.05 ELSE 1.01 END), t + to_hours(CASE WHEN id % 5 = 0 THEN 30 ELSE 20 END) FROM c),
p AS (SELECT x.id AS a, y.id AS b FROM f x JOIN f y ON x.o_custkey = y.o_custkey AND x.p = y.p AND x.id < y.id
  AND abs(epoch(x.t) - epoch(y.t)) <= 86400 AND abs(x.v - y.v) <= greatest(1, 0.02 * x.v)),
e AS (SELECT a, b FROM p UNION SELECT b, a FROM p), reach AS (SELECT id, id AS c FROM f UNION SELECT e.b, r.c FROM reach r JOIN e ON e.a = r.id)
SELECT id, min(c) AS "group" FROM reach GROUP BY id
""")
def fuzzy_dupes(spark, d):
    """Orders as notices, and again as a second publisher has them: a letter more in the buyer's name, other amounts and days."""
    orders, buyers = table(spark, d, "orders"), table(spark, d, "customer").select("c_custkey", "c_name")
    one = orders.groupBy("o_custkey", "o_orderpriority", "o_totalprice", "o_orderdate").agg(F.min("o_orderkey").alias("k")).join(buyers, F.col("o_custkey") == F.col("c_custkey"))
    title = F.concat(F.lit("Works and services of the kind "), "o_orderpriority")
    day = F.col("o_orderdate").cast("timestamp")
    k, none = F.col("k"), F.lit(None).cast("string")
    feed = lambda i, name, amount, due: one.select(
        (2 * k + i).alias("id"), F.lit(f"feed{i}").alias("source"), name.alias("buyer"), title.alias("title"), due.alias("deadline"), amount.alias("amount"),
        F.lit("EUR").alias("currency"), none.alias("lot"), F.lit("").alias("ocid"), day.cast("date").alias("published"),
    )
    first = feed(0, F.col("c_name"), F.col("o_totalprice"), day)
    other = feed(1, F.concat("c_name", F.lit("x")), F.col("o_totalprice") * F.when(k % 3 == 0, 1.05).otherwise(1.01), F.timestamp_add("HOUR", F.when(k % 5 == 0, 30).otherwise(20), day))
    return duplicates.duplicate_groups(first.unionByName(other))


@query("""
SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max((CASE WHEN event_id % 4 > 0 THEN value END)::VARCHAR, (ts, event_id)) FILTER (event_id % 4 > 0) AS value FROM events GROUP BY user_id
""")
def stream_upsert(spark, d):
    """The table that a stream of micro-batches over the events' file leaves behind, when all of it is read."""
    events = table(spark, d, "events")
    top = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows = events.select("user_id", "ts", "event_id", F.when(F.col("event_id") % 4 > 0, F.col("value")).alias("value"), "event_type")
    rows.repartition(4).write.parquet(f"{top}/in")
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{top}/in")
    key, order, columns = ["user_id"], ["ts", "event_id"], ["event_type", "value"]
    incremental.stream_into(spark, source, f"{top}/table", f"{top}/checkpoint", key, order, columns, buckets=8).trigger(availableNow=True).start().awaitTermination()
    return incremental.facts(incremental.current_state(spark, f"{top}/table"), key, columns)


@query("""
SELECT o_custkey, strftime(o_orderdate, '%Y-%m') AS month, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY ALL
""")
def archive_months(spark, d):
    """An archive by month after two runs: the earlier orders, then all with every third key."""
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    path = f"{shared_dir(spark)}/months-{uuid.uuid4().hex}"
    for part in ("o_orderkey % 3 > 0", "o_orderkey % 3 = 0"):
        sinks.archive_months(orders.where(part), path, "o_orderdate", "o_custkey", ["o_orderdate", "o_orderkey"])
    return spark.read.parquet(path).select("o_custkey", F.col("month").cast("string").alias("month"), "o_orderkey")


@query("""
SELECT count(*) AS rows, count(DISTINCT o_custkey) AS keys, count(*) - count(DISTINCT o_custkey) AS dropped, 0::BIGINT AS lost FROM orders
""")
def compaction_report(spark, d):
    return sinks.compacted(table(spark, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"])


@query("""
WITH o AS (SELECT o_orderpriority || '/' || o_custkey % 40 AS feed, epoch_us(max(o_orderdate)) AS through, bool_and(o_totalprice < 440000) AS ok FROM orders GROUP BY 1)
SELECT feed, CASE WHEN ok THEN greatest(through, 0) END AS cursor, CASE WHEN ok THEN 0 ELSE 2 END::BIGINT AS attempts, CASE WHEN ok THEN NULL ELSE epoch_us(TIMESTAMP '2001-06-02 12:30:00') END AS retry
FROM o
""")
def cursor_moves(spark, d):
    """Cursors of feeds after two runs: a feed with a window that failed twice stays where it was and waits twice as long."""
    orders = table(spark, d, "orders")
    windows = orders.select(F.concat_ws("/", "o_orderpriority", (F.col("o_custkey") % 40).cast("string")).alias("feed"), F.col("o_orderdate").cast("timestamp").alias("through"), (F.col("o_totalprice") < 440000).alias("complete"))
    state, path = cursors.loaded(spark, "", 0), f"{shared_dir(spark)}/cursors-{uuid.uuid4().hex}"
    for run, day in enumerate(("2001-06-01", "2001-06-02")):
        cursors.saved(cursors.moved(state, windows, F.lit(f"{day} 12:00:00").cast("timestamp")), path, run)
        state = cursors.loaded(spark, path, run + 1)
    return state.select("feed", F.unix_micros("cursor").alias("cursor"), "attempts", F.unix_micros("retry_at").alias("retry"))


_TIERED = "CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END"


@query(f"""
SELECT o_orderkey, row_number() OVER (ORDER BY {_TIERED}, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate END, CASE WHEN o_orderkey % 4 > 0 THEN o_orderdate + INTERVAL 3 DAY END) DESC NULLS LAST, o_orderkey) AS rank
FROM orders WHERE o_orderstatus = 'F' QUALIFY rank <= 200
""")
def award_ranking(spark, d):
    """Awards: tier, then the award's date or else its publication."""
    from bidstream.operators.search import ranked

    rows = table(spark, d, "orders").where("o_orderstatus = 'F'").withColumns({
        "priority": F.when(F.col("o_orderpriority") == "1-URGENT", "platform").when(F.col("o_orderpriority") == "2-HIGH", "ai").otherwise("other"),
        "award_date": F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderdate")), "published": F.when(F.col("o_orderkey") % 4 > 0, F.date_add("o_orderdate", 3).cast(table(spark, d, "orders").schema["o_orderdate"].dataType)),
    })
    return ranked(rows, listings.award_order("priority", ["award_date", "published"], "o_orderkey"), 200).select("o_orderkey", "rank")


@query(f"""
SELECT o_orderkey, row_number() OVER (ORDER BY {_TIERED}, o_orderdate DESC, o_orderkey) AS rank FROM orders WHERE o_orderstatus <> 'F' QUALIFY rank <= 200
""")
def work_ranking(spark, d):
    """What is worked on next: tier, latest publication, key."""
    from bidstream.operators.search import ranked

    rows = table(spark, d, "orders").where("o_orderstatus <> 'F'").withColumn("priority", F.when(F.col("o_orderpriority") == "1-URGENT", "platform").when(F.col("o_orderpriority") == "2-HIGH", "ai").otherwise("other"))
    return ranked(rows, listings.queue_order("priority", "o_orderdate", "o_orderdate", "o_orderkey"), 200).select("o_orderkey", "rank")


@query("""
SELECT l_suppkey, string_agg(l_orderkey::VARCHAR, ',' ORDER BY d DESC, l_orderkey) AS awards FROM (
  SELECT DISTINCT l_suppkey, l_orderkey, max(CASE WHEN l_linenumber > 1 THEN strftime(l_shipdate, '%Y-%m-%d') ELSE '' END) OVER (PARTITION BY l_suppkey, l_orderkey) AS d FROM lineitem WHERE l_returnflag = 'R')
GROUP BY l_suppkey
""")
def supplier_awards(spark, d):
    """A supplier's awards, latest first; those of a first line have no date and come last."""
    day = F.when(F.col("l_linenumber") > 1, F.date_format("l_shipdate", "yyyy-MM-dd")).otherwise("")
    one = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy("l_suppkey", "l_orderkey").agg(F.max(day).alias("d"))
    listed = F.array_sort(F.collect_list(F.struct("d", "l_orderkey")), lambda a, b: F.when(a["d"] > b["d"], -1).when(a["d"] < b["d"], 1).when(a["l_orderkey"] < b["l_orderkey"], -1).otherwise(1))
    return one.groupBy("l_suppkey").agg(listed.alias("items")).select("l_suppkey", F.array_join(F.transform("items", lambda x: x["l_orderkey"].cast("string")), ",").alias("awards"))


@query("""
SELECT 'all' AS view, o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0) UNION ALL
SELECT 'saved', o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 = 0)
""")
def personal_views(spark, d):
    orders, people = table(spark, d, "orders").select("o_custkey", "o_orderkey"), table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"))
    saved, hidden = people.where("o_custkey % 7 = 0"), people.where("o_custkey % 3 = 0")
    views = [listings.personal(orders, "o_custkey", saved, hidden, v).select(F.lit(v).alias("view"), "o_orderkey") for v in ("all", "saved")]
    return views[0].unionByName(views[1])


@query("""
SELECT o_orderpriority, o_orderstatus, count(*) AS rows, count(*) FILTER (o_totalprice > 300000) AS large, count(*) FILTER (o_orderdate >= DATE '2000-01-01') AS late FROM orders GROUP BY ALL
""")
def audit_counts(spark, d):
    return listings.audit_counts(table(spark, d, "orders"), ["o_orderpriority", "o_orderstatus"], {"large": F.col("o_totalprice") > 300000, "late": F.col("o_orderdate") >= F.lit("2000-01-01").cast("date")})


@query("""
SELECT source, count(*) FILTER (lang = 'en') AS original, count(*) FILTER (lang <> 'en' AND doc_id % 3 = 0 AND doc_id % 2 = 0) AS translated,
  count(*) FILTER (lang <> 'en' AND doc_id % 3 = 0 AND doc_id % 2 = 1) AS outdated, count(*) FILTER (lang <> 'en' AND doc_id % 3 > 0) AS missing FROM documents GROUP BY source
""")
def translation_coverage(spark, d):
    """Every third text has a translation, and every second of these was made of an older text."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", F.sha2("text", 256).alias("hash"))
    made = docs.where("doc_id % 3 = 0").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("hash")).otherwise("old").alias("hash"))
    return listings.coverage(docs, made, "doc_id", "hash", "source")


@query("""
SELECT doc_id, spent FROM (SELECT doc_id, sum(greatest(n_chars, 1)) OVER (ORDER BY n_chars, doc_id)::BIGINT AS spent FROM documents WHERE lang <> 'en' AND doc_id % 3 > 0) WHERE spent <= 20000
""")
def translation_queue(spark, d):
    """The shortest open texts, as many as 20,000 characters hold."""
    docs = table(spark, d, "documents").where("lang <> 'en'").select("doc_id", "n_chars", F.sha2("text", 256).alias("hash"))
    made = docs.where("doc_id % 3 = 0").select("doc_id", "hash")
    return listings.translation_queue(docs, made, "doc_id", "hash", "n_chars", 20000, [F.col("n_chars"), F.col("doc_id")]).select("doc_id", F.col("spent").cast("long").alias("spent"))


@query("""
WITH v AS (SELECT 'awards' AS view, o_orderkey FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'history', o_orderkey FROM orders WHERE o_orderdate < DATE '1999-01-01' UNION ALL SELECT 'opportunities', o_orderkey FROM orders WHERE o_orderstatus = 'O')
SELECT view, count(*) AS rows, count(DISTINCT o_orderkey) AS keys FROM v GROUP BY view
""")
def view_manifests(spark, d):
    views = {"awards": F.col("o_orderstatus") == "F", "history": F.col("o_orderdate") < F.lit("1999-01-01").cast("date"), "opportunities": F.col("o_orderstatus") == "O"}
    return listings.view_manifest(table(spark, d, "orders"), "o_orderkey", views).drop("checksum")


@query(f"""
SELECT event_id FROM events WHERE event_type <> 'purchase' OR (TIMESTAMP '{EVENTS_NOW}' - ts) < INTERVAL 11 DAY
""")
def current_set(spark, d):
    """Purchases are over and stay for ten days; all else stays."""
    e = table(spark, d, "events")
    status = F.when(F.col("event_type") == "purchase", "awarded").otherwise("active")
    return e.where(listings.is_current(status, F.lit(None).cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"), now(EVENTS_NOW), days=10)).select("event_id")
