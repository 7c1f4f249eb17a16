"""Queries of nested payloads, histories of facts, quotas, archives by key, files bounded by bytes, and orders by language."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from bidstream.operators import backfill, listings, nested, ordered, tiers
from bidstream.operators.reconcile import compatible, is_older
from bidstream.sources import sinks
from bidstream.sources.shared import shared_dir
from bidstream.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _payloads(spark, d):
    """(o_orderkey, payload): an order with its line items as JSON text, values of several kinds and depths."""
    line = F.concat(
        F.lit('{"id":'), "l_linenumber", F.lit(',"value":{"amount":'), F.col("l_quantity").cast("long"), F.lit(',"tax":['), F.col("l_partkey") % 3, F.lit(","), F.col("l_suppkey") % 2, F.lit(']},"flag":"'), "l_returnflag", F.lit('"}'),
    )
    lots = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.struct("l_linenumber", line.alias("t")).alias("x")).groupBy("o_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), ",").alias("lots"))
    orders = table(spark, d, "orders").join(lots, "o_orderkey", "left")
    text = F.concat(
        F.lit('{"id":'), "o_orderkey", F.lit(',"status":"'), "o_orderstatus", F.lit('","none":null,"empty":{},"lots":['), F.coalesce("lots", F.lit("")), F.lit('],"buyer":{"id":'), "o_custkey", F.lit(',"ok":'),
        F.when(F.col("o_custkey") % 2 == 0, "true").otherwise("false"), F.lit("}}"),
    )
    return orders.select("o_orderkey", text.alias("payload"))


_PAYLOADS_SQL = """
lots AS (SELECT l_orderkey AS o_orderkey, string_agg('{"id":' || l_linenumber || ',"value":{"amount":' || l_quantity::BIGINT || ',"tax":[' || l_partkey % 3 || ',' || l_suppkey % 2 || ']},"flag":"' || l_returnflag || '"}', ',' ORDER BY l_linenumber, '{"id":' || l_linenumber || ',"value":{"amount":' || l_quantity::BIGINT || ',"tax":[' || l_partkey % 3 || ',' || l_suppkey % 2 || ']},"flag":"' || l_returnflag || '"}') AS lots FROM lineitem GROUP BY 1),
payloads AS (SELECT o_orderkey, '{"id":' || o_orderkey || ',"status":"' || o_orderstatus || '","none":null,"empty":{},"lots":[' || coalesce(lots, '') || '],"buyer":{"id":' || o_custkey || ',"ok":' || CASE WHEN o_custkey % 2 = 0 THEN 'true' ELSE 'false' END || '}}' AS payload FROM orders LEFT JOIN lots USING (o_orderkey))"""


@query(f"""
WITH {_PAYLOADS_SQL}
SELECT key AS name, count(*) AS places, count(DISTINCT o_orderkey) AS orders, count(DISTINCT t.value::VARCHAR) AS texts, max(length(t.fullkey)) AS longest_path
FROM payloads, json_tree(payload) t WHERE key IN ('id', 'value', 'tax', 'none', 'empty', 'ok') GROUP BY 1
""")
def nested_values(spark, d):
    """What stands under six keys at any depth of all payloads, whole objects and arrays among it."""
    found = nested.values_under(_payloads(spark, d), ["o_orderkey"], "payload", ["id", "value", "tax", "none", "empty", "ok"])
    name = F.regexp_extract("path", r"([^.]+)$", 1)
    return found.groupBy(name.alias("name")).agg(
        F.count("*").alias("places"), F.count_distinct("o_orderkey").alias("orders"), F.count_distinct("text").alias("texts"), F.max(F.length("path")).cast("long").alias("longest_path")
    )


@query(f"WITH {_PAYLOADS_SQL} SELECT o_orderkey, t.fullkey AS path, t.value::VARCHAR AS text FROM payloads, json_tree(payload) t WHERE key IN ('tax', 'buyer') ")
def nested_paths(spark, d):
    """Arrays and objects under two keys, with their paths."""
    return nested.values_under(_payloads(spark, d), ["o_orderkey"], "payload", ["tax", "buyer"])


def _versions(spark, d):
    """(user, event_id, payload): a third of all events are one user's, whose facts change now and then."""
    user = F.when(F.col("event_id") % 3 == 0, F.lit(-1)).otherwise(F.col("user_id"))
    facts = F.concat(
        F.lit('{"type":"'), "event_type", F.lit('","n":'), F.floor(F.col("event_id") / 50) % 4, F.when(F.col("event_id") % 7 < 5, F.concat(F.lit(',"lots":['), F.floor(F.col("event_id") / 20) % 3, F.lit(',{"k":"'), F.col("event_id") % 2, F.lit('"}]'))).otherwise(F.lit("")), F.lit("}"),
    )
    return table(spark, d, "events").select(user.alias("user"), "event_id", facts.alias("payload"))


_VERSIONS_SQL = """
versions AS (SELECT CASE WHEN event_id % 3 = 0 THEN -1 ELSE user_id END AS "user", event_id, '{"type":"' || event_type || '","n":' || (event_id // 50) % 4 || CASE WHEN event_id % 7 < 5 THEN ',"lots":[' || (event_id // 20) % 3 || ',{"k":"' || event_id % 2 || '"}]' ELSE '' END || '}' AS payload FROM events),
numbered AS (SELECT "user", row_number() OVER (PARTITION BY "user" ORDER BY event_id) AS turn, payload FROM versions),
leaves AS (SELECT "user", turn, t.fullkey AS path, t.value::VARCHAR AS text FROM numbered, json_tree(payload) t WHERE t.type NOT IN ('OBJECT', 'ARRAY')),
islands AS (SELECT *, turn - row_number() OVER (PARTITION BY "user", path, text ORDER BY turn) AS island FROM leaves)"""


@query(f'WITH {_VERSIONS_SQL} SELECT "user", path, min(turn) AS first, max(turn) AS last, text FROM islands GROUP BY "user", path, text, island')
def fact_runs(spark, d):
    """How long each fact of each user stood, by path."""
    return nested.fact_runs(_versions(spark, d), "user", ["event_id"], "payload")


@query(f"""WITH {_VERSIONS_SQL} SELECT "user", turn AS version, count(*) AS facts, sha256(string_agg(path || '=' || text, ',' ORDER BY path)) AS digest FROM leaves GROUP BY "user", turn""")
def fact_versions(spark, d):
    """All versions again, from the runs."""
    out = nested.versions_again(nested.fact_runs(_versions(spark, d), "user", ["event_id"], "payload"), "user")
    text = F.array_join(F.transform(F.array_sort(F.map_entries("facts")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return out.select("user", "version", F.size("facts").cast("long").alias("facts"), F.sha2(text.cast("binary"), 256).alias("digest"))


@query("""
WITH o AS (SELECT l_orderkey, l_linenumber, sum(l_quantity::BIGINT) OVER (ORDER BY l_extendedprice, l_orderkey, l_linenumber)::BIGINT AS total FROM lineitem)
SELECT * FROM o WHERE total <= 300000
""")
def running_quota(spark, d):
    """Line items from the cheapest on, as many as a quota of 300,000 pieces holds."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", F.col("l_quantity").cast("long").alias("n"))
    out = ordered.running_total(lines, [F.col("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], F.col("n"))
    return out.where("total <= 300000").select("l_orderkey", "l_linenumber", "total")


@query("""
WITH u AS (SELECT event_type AS model, timezone('America/Los_Angeles', ts AT TIME ZONE 'UTC')::DATE AS day, count(*) AS calls, count(*) FILTER (event_id % 10 = 0) AS returned FROM events GROUP BY ALL),
last AS (SELECT max(day) AS day FROM u), n AS (SELECT count(*) AS n FROM events), models AS (SELECT DISTINCT event_type AS model, n // 40 + 37 * length(event_type) AS per_day FROM events, n),
r AS (SELECT model, per_day, used, greatest(per_day - used, 0) AS "left" FROM (SELECT m.model, per_day, coalesce(calls - returned, 0)::BIGINT AS used FROM models m LEFT JOIN (SELECT * FROM u JOIN last USING (day)) x ON x.model = m.model)),
turns AS (SELECT model, unnest(range(1, "left" + 1)) AS turn FROM r WHERE "left" >= 5),
won AS (SELECT model, count(*) AS "limit" FROM (SELECT * FROM turns ORDER BY turn, model LIMIT 500) GROUP BY 1)
SELECT model, used, "left", coalesce("limit", 0) AS "limit" FROM r LEFT JOIN won USING (model)
""")
def quota_ledger(spark, d):
    """What each kind of events has left of its daily quota, and how 500 calls are shared out among them."""
    events = table(spark, d, "events").select("event_id", F.col("event_type").alias("model"), listings.quota_day(F.col("ts").cast("timestamp")).alias("day"))
    uses = events.groupBy("model", "day").agg(F.count("*").alias("calls"), F.count_if(F.col("event_id") % 10 == 0).alias("returned"))
    n, last = events.agg(F.count("*"), F.max("day")).first()
    models = events.select("model").distinct().withColumn("per_day", F.lit(n // 40) + 37 * F.length("model"))
    return listings.allowances(listings.remaining(models, uses, F.lit(last)), 500, 5).select("model", "used", "left", "limit")


@query("""
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, round(o_totalprice, 2) AS price FROM orders WHERE o_custkey % 50 = 7
""")
def archive_restored(spark, d):
    """Orders of every fiftieth customer back from an archive by month, by their keys alone."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("day"), F.round("o_totalprice", 2).alias("price"))
    path = f"{shared_dir(spark)}/archive-of-orders-{uuid.uuid4().hex}"
    sinks.archive_months(orders, path, "day", "o_orderkey", ["day"])
    return sinks.restored(spark, path, orders.where("o_custkey % 50 = 7"), "o_orderkey").select("o_orderkey", "month", "price")


@query("""
WITH r AS (SELECT doc_id, strlen(text) AS n, sha256(doc_id::VARCHAR) AS h FROM documents),
s AS (SELECT digits, substr(h, 1, digits) AS prefix, sum(n) AS bytes FROM r, (SELECT unnest(range(0, 5)) AS digits) GROUP BY ALL),
leaf AS (SELECT doc_id, n, min(digits) AS digits FROM r JOIN s ON prefix = substr(h, 1, digits) WHERE bytes <= 150000 GROUP BY ALL)
SELECT 'p' || substr(sha256(doc_id::VARCHAR), 1, digits) AS leaf, count(*) AS rows, sum(n)::BIGINT AS bytes FROM leaf GROUP BY ALL
""")
def byte_leaves(spark, d):
    """Documents in files of no more than 150,000 bytes."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    size = F.octet_length("text")
    return sinks.bounded_leaves(docs, "doc_id", size, 150_000, 4).groupBy("leaf").agg(F.count("*").alias("rows"), F.sum(size.cast("long")).alias("bytes"))


_ACCENTS = (("a", "ä"), ("e", "é"), ("i", "í"), ("o", "ö"), ("u", "û"))
_NAME_SQL = "p_name || ' ' || p_type"
for _plain, _accent in _ACCENTS:
    _NAME_SQL = f"CASE WHEN (p_partkey + {ord(_plain)}) % 3 = 0 THEN replace({_NAME_SQL}, '{_plain}', '{_accent}') ELSE {_NAME_SQL} END" if _plain in "aeo" else _NAME_SQL


@query(f"""
WITH n AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 4 = 0 THEN upper({_NAME_SQL}) ELSE {_NAME_SQL} END AS name FROM part)
SELECT p_partkey, name, row_number() OVER (PARTITION BY p_brand ORDER BY name COLLATE de, p_partkey)::INTEGER AS nth FROM n
""")
def names_in_order(spark, d):
    """Names with accents and capitals, numbered in each brand in the order that readers expect."""
    name = F.concat_ws(" ", "p_name", "p_type")
    for plain, accent in _ACCENTS:
        if plain in "aeo":
            name = F.when((F.col("p_partkey") + ord(plain)) % 3 == 0, F.replace(name, F.lit(plain), F.lit(accent))).otherwise(name)
    parts = table(spark, d, "part").select("p_partkey", "p_brand", F.when(F.col("p_partkey") % 4 == 0, F.upper(name)).otherwise(name).alias("name"))
    order = W.partitionBy("p_brand").orderBy(tiers.in_language_order(F.col("name")), "p_partkey")
    return parts.withColumn("nth", F.row_number().over(order)).select("p_partkey", "name", "nth")


@query("""
WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, 's' || o_orderkey % 3 AS source, CASE WHEN o_orderkey % 5 > 0 THEN 'n' || o_orderkey % 2 END AS ocid, CASE WHEN o_orderkey % 4 = 0 THEN 'L1' END AS lot_id,
  CASE o_orderkey % 3 WHEN 0 THEN ['L1', 'L2'] WHEN 1 THEN ['L2', 'L1'] ELSE ['L1'] END AS lots, o_orderstatus = 'F' AS award, o_orderdate::DATE AS day FROM orders),
p AS (SELECT *, lag(k) OVER w AS pk, lag(source) OVER w AS ps, lag(ocid) OVER w AS po, lag(lot_id) OVER w AS pl, lag(lots) OVER w AS plots, lag(award) OVER w AS pa, lag(day) OVER w AS pday FROM o WINDOW w AS (PARTITION BY c ORDER BY k))
SELECT k, pk, CASE WHEN source = ps AND source = 's2' AND ocid = po THEN lot_id IS NOT DISTINCT FROM pl
  ELSE NOT (NOT pa AND len(plots) > 1 AND award AND (lot_id IS NULL OR list_sort(plots) <> list_sort(lots))) AND lot_id IS NOT DISTINCT FROM pl AND NOT coalesce(source = ps AND ocid <> po, false) END AS same,
  CASE WHEN source = ps AND source = 's1' THEN day + (k % 7)::INTEGER < pday + (pk % 7)::INTEGER WHEN source = ps AND source = 's0' AND date_trunc('month', day) = date_trunc('month', pday) AND k % 2 = 0 THEN true
    ELSE date_trunc('month', day) < date_trunc('month', pday) END AS older FROM p WHERE pk IS NOT NULL
""")
def compatible_notices(spark, d):
    """Each order as a notice beside the customer's order before it as a record: whether they may be one, and which is the earlier revision."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    lots = F.when(k % 3 == 0, F.array(F.lit("L1"), F.lit("L2"))).when(k % 3 == 1, F.array(F.lit("L2"), F.lit("L1"))).otherwise(F.array(F.lit("L1")))
    notice = F.struct(
        k.alias("k"), F.concat(F.lit("s"), k % 3).alias("source"), F.when(k % 5 > 0, F.concat(F.lit("n"), k % 2)).alias("ocid"), F.when(k % 4 == 0, "L1").alias("lot_id"), lots.alias("lot_ids"),
        F.when(F.col("o_orderstatus") == "F", "AWARD").otherwise("TENDER").alias("signal_type"), F.date_trunc("month", day).alias("updated"), F.date_trunc("month", day).alias("first_seen"),
        F.date_add(day, (k % 7).cast("int")).alias("last_seen"), k.cast("string").alias("alias"),
    )
    rows = table(spark, d, "orders").select("o_custkey", notice.alias("n")).withColumn("r", F.lag("n").over(W.partitionBy("o_custkey").orderBy("n.k"))).where("r is not null")
    # the record names every notice after it whose number is even
    named = F.col("r").withField("aliases", F.when(F.col("n.k") % 2 == 0, F.array("n.alias")).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("r", named)
    return rows.select(F.col("n.k").alias("k"), F.col("r.k").alias("pk"), compatible(F.col("r"), F.col("n"), ("s2",)).alias("same"), is_older(F.col("n"), F.col("r"), ("s1",), ("s0",)).alias("older"))


@query("""
WITH n AS (SELECT o_orderkey AS id, o_custkey % 100 AS b, CASE WHEN o_orderkey % 3 = 0 THEN 'FUNDING' WHEN o_orderstatus = 'F' THEN 'AWARD' ELSE 'TENDER' END AS t, 's' || o_orderkey % 4 AS source, o_totalprice AS v FROM orders)
SELECT id, CASE WHEN id % 4 = 0 THEN 'id:a' || b WHEN id % 4 < 3 THEN 'name:buyer ' || b || '@DE+FR' END AS buyer_id, CASE WHEN id % 4 = 0 THEN 'identifier' WHEN id % 4 < 3 THEN 'name' END AS buyer_basis,
  CASE WHEN id % 5 > 0 THEN 'ocid:o' || id // 2 ELSE 'url:https://n.example/' || id END AS procedure_id,
  CASE WHEN id % 6 = 0 THEN 'given' WHEN id % 7 = 0 THEN NULL WHEN t = 'AWARD' THEN 'unknown' WHEN source = 's0' THEN 'grant_range' WHEN source = 's1' THEN 'estimated_contract' ELSE 'unknown' END AS amount_kind,
  CASE WHEN id % 8 = 0 THEN 'tender:given' WHEN id % 8 = 1 THEN '' WHEN t = 'FUNDING' THEN 'application:2026-01-01' ELSE 'unknown:2026-01-01' END AS deadlines, CASE WHEN id % 9 = 0 THEN 'W' WHEN id % 9 = 1 THEN '' ELSE 'A and B' END AS winners FROM n
""")
def notices_completed(spark, d):
    """Orders as notices that lack this or that, with identities and the facts that can be told."""
    i, none = F.col("o_orderkey"), F.lit(None).cast("string")
    b = F.col("o_custkey") % 100
    rows = table(spark, d, "orders").select(
        i.alias("id"), F.when(i % 4 == 0, F.array(F.lit(" "), F.concat(F.lit("b"), b), F.concat(F.lit("a"), b))).alias("buyer_identifiers"), F.when(i % 4 < 3, F.concat(F.lit(" Buyer  "), b)).alias("buyer_name"),
        F.array(F.lit("FR"), F.lit("DE")).alias("countries"), F.when(i % 5 > 0, F.concat(F.lit("o"), F.floor(i / 2))).otherwise("").alias("ocid"), F.concat(F.lit("https://n.example/"), i).alias("url"),
        F.when(i % 3 == 0, "FUNDING").when(F.col("o_orderstatus") == "F", "AWARD").otherwise("TENDER").alias("signal_type"), F.concat(F.lit("s"), i % 4).alias("source"), none.cast("double").alias("value_min"),
        F.when(i % 7 > 0, F.col("o_totalprice")).alias("value_max"), F.when(i % 6 == 0, "given").otherwise("").alias("amount_kind"), F.when(i % 8 != 1, "2026-01-01").alias("deadline_at"),
        F.when(i % 8 == 0, F.array(F.struct(F.lit("tender").alias("kind"), none.alias("lot_id"), F.lit("given").alias("value")))).alias("deadlines"),
        F.when(i % 9 == 0, F.array(F.lit("W"))).otherwise(F.array().cast("array<string>")).alias("winners"), F.when(i % 9 > 1, "A and B").alias("supplier"),
    )
    out = backfill.completed(rows, {"s0": "grant_range", "s1": "estimated_contract"})
    return out.select(
        "id", "buyer_id", "buyer_basis", "procedure_id", "amount_kind", F.coalesce(F.array_join(F.transform("deadlines", lambda x: F.concat_ws(":", x["kind"], x["value"])), ","), F.lit("")).alias("deadlines"),
        F.array_join("winners", ",").alias("winners"),
    )


@query("""
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN CASE WHEN o_orderkey % 4 > 0 THEN '2027-01-01' END WHEN o_orderkey % 3 = 0 AND o_orderkey % 5 = 0 THEN o_orderdate::DATE::VARCHAR
  ELSE o_orderdate::DATE::VARCHAR || CASE WHEN o_orderkey % 5 = 0 THEN 'T00:00:00Z' ELSE 'T10:00:00Z' END END AS deadline_at,
  CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN 'u' || o_orderkey % 2 || ':new,x:new,u1:old' ELSE 'u' || o_orderkey % 2 || ':old,u1:old' END AS documents FROM orders
""")
def facts_backfilled(spark, d):
    """Orders of one source in three, half of which have a cached original."""
    i, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date").cast("string")
    document = lambda url, title: F.struct(url.alias("url"), F.lit(title).alias("title"))
    own = F.concat(F.lit("u"), i % 2)
    rows = table(spark, d, "orders").select(
        i.alias("id"), F.when(i % 3 == 0, "grants").otherwise("other").alias("source"), F.concat(day, F.when(i % 5 == 0, "T00:00:00Z").otherwise("T10:00:00Z")).alias("deadline_at"),
        F.array(document(own, "old"), document(F.lit("u1"), "old")).alias("documents"),
    )
    cache = table(spark, d, "orders").where("o_orderkey % 2 = 0").select(i.alias("id"), F.when(i % 4 > 0, "2027-01-01").alias("deadline_at"), F.array(document(own, "new"), document(F.lit("x"), "new")).alias("documents"))
    out = backfill.backfilled(rows, cache, "id", ["deadline_at"], "grants")
    return out.select("id", "deadline_at", F.array_join(F.transform("documents", lambda x: F.concat_ws(":", x["url"], x["title"])), ",").alias("documents"))


@query("""
WITH o AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN -1 WHEN o_orderkey % 10 = 1 THEN NULL ELSE o_custkey END AS buyer, o_orderkey // 4 AS procedure, o_orderdate::DATE AS day FROM orders)
SELECT id, CASE WHEN buyer IS NOT NULL THEN row_number() OVER (PARTITION BY buyer ORDER BY day, id) END AS buyer_place, CASE WHEN buyer IS NOT NULL THEN count(*) OVER (PARTITION BY buyer) END AS buyer_of,
  row_number() OVER (PARTITION BY procedure ORDER BY day, id) AS procedure_place, count(*) OVER (PARTITION BY procedure) AS procedure_of FROM o
""")
def timeline_places(spark, d):
    """Each order's place among its buyer's, one of whom has a third of all, and among its procedure's."""
    i = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(
        i.alias("id"), F.when(i % 3 == 0, F.lit(-1)).when(i % 10 != 1, F.col("o_custkey")).cast("long").alias("buyer"), F.floor(i / 4).alias("procedure"), F.col("o_orderdate").cast("date").alias("day"))
    out = backfill.in_timelines(rows, {"buyer": ["day", "id"], "procedure": ["day", "id"]})
    return out.select("id", "buyer_place", "buyer_of", "procedure_place", "procedure_of")
