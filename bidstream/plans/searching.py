"""Queries of filters, facets, counts, rankings and markets."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidstream.functions import text as tx
from bidstream.operators import search
from bidstream.plans.notices import MARKETS_SQL, NOTICES_SQL, areas, markets, notices, now
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
SELECT DISTINCT c_custkey, market FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
JOIN {MARKETS_SQL} USING (r_name)
""")
def market_membership(spark, d):
    buyers = table(spark, d, "customer").join(areas(spark, d), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "r_name")
    return search.market_members(buyers, "r_name", markets(spark)).select("c_custkey", "market")


@query(f"""
WITH {NOTICES_SQL} SELECT market, count(DISTINCT id) AS n_notices, count(DISTINCT buyer_id) AS n_buyers
FROM notices JOIN {MARKETS_SQL} ON region = r_name GROUP BY market
UNION ALL SELECT 'ALL', count(*), count(DISTINCT buyer_id) FROM notices
""")
def market_counts(spark, d):
    rows = notices(spark, d).select("id", "buyer_id", F.col("region").alias("r_name"))
    # an area in several markets counts in each, and once in all
    every = rows.select(F.lit("ALL").alias("market"), "id", "buyer_id")
    members = rows.join(markets(spark), "r_name").select("market", "id", "buyer_id")
    return members.union(every).groupBy("market").agg(F.count_distinct("id").alias("n_notices"), F.count_distinct("buyer_id").alias("n_buyers"))


@query("""
SELECT id, day, rank FROM (SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS day,
  row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 100
""")
def feed_recent(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return search.ranked(rows, [F.desc("day"), F.col("id")], 100)


_FEED_SQL = """
SELECT * FROM (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS value,
  row_number() OVER (ORDER BY CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END {} NULLS LAST, o_orderkey) AS rank FROM orders)
WHERE rank <= 100
"""


def _valued(spark, d):
    """Notices of status P have not published a value."""
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("value"))


@query(_FEED_SQL.format("DESC"))
def feed_value_high(spark, d):
    return search.ranked(_valued(spark, d), [F.desc_nulls_last("value"), F.col("id")], 100)


@query(_FEED_SQL.format("ASC"))
def feed_value_low(spark, d):
    return search.ranked(_valued(spark, d), [F.asc_nulls_last("value"), F.col("id")], 100)


#: Capability, pattern of it over lower-case text.
CAPABILITIES = {"licensing": "license", "secrets": "password|token", "tables": " \\| ", "shouting": "!!"}


@query("""
WITH found AS (
  SELECT doc_id, lang, n_chars, split_part(text, chr(10), 1) AS title, lower(text) AS body, quality FROM documents LEFT JOIN labels USING (doc_id)
), scored AS (
  SELECT doc_id, lang, n_chars,
    greatest(
      CASE WHEN contains(lower(title), 'license') THEN 50 WHEN contains(body, 'license') THEN 36 ELSE 0 END,
      CASE WHEN regexp_matches(lower(title), 'password|token') THEN 18 WHEN regexp_matches(body, 'password|token') THEN 9 ELSE 0 END,
      CASE WHEN contains(body, ' | ') THEN 6 ELSE 0 END, CASE WHEN contains(body, '!!') THEN 4 ELSE 0 END) AS points,
    least(3, contains(body, 'license')::INT + regexp_matches(body, 'password|token')::INT + contains(body, ' | ')::INT + contains(body, '!!')::INT) AS breadth,
    coalesce(quality, 0) AS actionable
  FROM found
)
SELECT doc_id, points, breadth, actionable, rank FROM (
  SELECT *, row_number() OVER (ORDER BY points DESC, actionable DESC, breadth DESC, n_chars DESC, doc_id) AS rank FROM scored WHERE points > 0)
WHERE rank <= 100
""")
def best_match(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    title, body = F.lower(F.split_part("text", F.lit("\n"), F.lit(1))), F.lower("text")
    kind = {"licensing": ("explicit_title", "explicit"), "secrets": ("needs_title", "needs"), "tables": ("context", "context"), "shouting": ("hint", "hint")}
    evidence = F.array_compact(F.array(*[
        F.when(title.rlike(p), kind[c][0]).when(body.rlike(p), kind[c][1]) for c, p in CAPABILITIES.items()
    ]))
    held = F.array_compact(F.array(*[F.when(body.rlike(p), c) for c, p in CAPABILITIES.items()]))
    rows = docs.select("doc_id", "n_chars", search.evidence_points(evidence).alias("points"), search.breadth(held).alias("breadth"), F.coalesce("quality", F.lit(0)).alias("actionable"))
    order = [F.desc("points"), F.desc("actionable"), F.desc("breadth"), F.desc("n_chars"), F.col("doc_id")]
    return search.ranked(rows.where("points > 0"), order, 100).select("doc_id", "points", "breadth", "actionable", "rank")


@query(f"""
WITH {NOTICES_SQL} SELECT count(*) FILTER (status = 'O') AS open, count(*) FILTER (status = 'F') AS awarded, count(*) FILTER (status = 'P') AS pipeline,
  count(*) FILTER (value >= 300000) AS large, count(*) FILTER (status = 'O' AND priority = '1-URGENT') AS urgent, count(*) AS all_notices FROM notices
""")
def view_counts(spark, d):
    c = F.col
    return search.view_counts(notices(spark, d), {
        "open": c("status") == "O", "awarded": c("status") == "F", "pipeline": c("status") == "P", "large": c("value") >= 300000,
        "urgent": (c("status") == "O") & (c("priority") == "1-URGENT"), "all_notices": F.lit(True),
    })


@query(f"""
WITH {NOTICES_SQL}
SELECT 'region' AS facet, region AS value, count(*) AS n FROM notices WHERE segment IN ('BUILDING', 'MACHINERY') AND status = 'O' GROUP BY region
UNION ALL SELECT 'segment', segment, count(*) FROM notices WHERE region = 'ASIA' AND status = 'O' GROUP BY segment
UNION ALL SELECT 'status', status, count(*) FROM notices WHERE region = 'ASIA' AND segment IN ('BUILDING', 'MACHINERY') GROUP BY status
""")
def facets_excluding_self(spark, d):
    facets = {f: F.array(f) for f in ("region", "segment", "status")}
    chosen = {"region": F.col("region") == "ASIA", "segment": F.col("segment").isin("BUILDING", "MACHINERY"), "status": F.col("status") == "O"}
    return search.facet_counts(notices(spark, d), facets, chosen)


@query(f"""
WITH {NOTICES_SQL} SELECT id, value, strftime(day, '%Y-%m-%d') AS day FROM notices
WHERE contains(lower(buyer), '#00000001') AND contains(lower(region), 'a') AND status <> 'P' AND value >= 50000 AND value <= 400000
  AND day >= DATE '1996-01-01' AND day <= DATE '2000-12-31' AND starts_with(priority, '1')
""")
def filter_conjunction(spark, d):
    rows = notices(spark, d).withColumns({
        "value_max": F.when(F.col("status") != "P", F.col("value")), "published": F.col("day"), "regions": F.array("region"), "codes": F.array("priority"),
    })
    chosen = search.Filters(buyer="#00000001", region="a", code_prefix="1", value_from=50000, value_to=400000, date_from="1996-01-01", date_to="2000-12-31")
    return rows.where(search.conjunction(chosen.predicates())).select("id", "value", F.date_format("day", "yyyy-MM-dd").alias("day"))


#: Folding that both engines have: ASCII words in lower case.
_ASCII_SQL = "trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))"


def _ascii(column="text"):
    return F.trim(F.regexp_replace(F.lower(column), "[^a-z0-9]+", " "))


def _searched(spark, d, words, mode):
    docs = table(spark, d, "documents").select("doc_id", "source", _ascii().alias("folded"))
    return docs.where(tx.compiled_search(F.col("folded"), words, mode)).select("doc_id", "source")


def _text_sql(condition: str) -> str:
    return f"SELECT doc_id, source FROM (SELECT doc_id, source, ' ' || {_ASCII_SQL} || ' ' AS t FROM documents) WHERE {condition}"


@query(_text_sql("contains(t, 'licensed') AND contains(t, 'under') AND contains(t, ' the ')"))
def text_all_words(spark, d):
    return _searched(spark, d, "licensed under the", "all")


@query(_text_sql("contains(t, 'apache') OR contains(t, 'password') OR contains(t, ' gnu ')"))
def text_any(spark, d):
    return _searched(spark, d, "Apache password GNU", "any")


@query(_text_sql("contains(t, ' general public license ') AND contains(t, 'version')"))
def text_phrase(spark, d):
    return _searched(spark, d, '"General Public License" version', "all")


@query("""
SELECT doc_id, length(f) AS folded_chars, sha256(f) AS folded_sha256 FROM (
  SELECT doc_id, trim(regexp_replace(lower(strip_accents(text)), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS f FROM documents)
""")
def folded_search(spark, d):
    folded = table(spark, d, "documents").select("doc_id", tx.folded("text").alias("f"))
    return folded.select("doc_id", F.length("f").cast("long").alias("folded_chars"), F.sha2("f", 256).alias("folded_sha256"))


@query(f"""
WITH {NOTICES_SQL} SELECT id, datediff('day', DATE '2001-06-01', day + 30)::INTEGER AS days_left FROM notices
WHERE status = 'O' AND day + 30 > DATE '2001-06-01' AND day + 30 <= DATE '2001-06-16'
""")
def closing_soon(spark, d):
    """Open notices due within 15 days, as if due 30 days after their day."""
    rows = notices(spark, d).withColumn("deadline", F.date_add("day", 30).cast("timestamp_ntz"))
    chosen = search.Filters(due_within_days=15, more=[F.col("status") == "O"])
    at = now("2001-06-01 00:00:00")
    return rows.where(search.conjunction(chosen.predicates(at))).select("id", F.date_diff(F.to_date("deadline"), F.to_date(at)).alias("days_left"))


@query(f"""
WITH {NOTICES_SQL} SELECT nation, count(*) FILTER (id IS NOT NULL) AS n_notices, coalesce(sum(value::DECIMAL(18, 2)), 0)::DOUBLE AS total FROM
(SELECT n_name AS nation FROM nation) LEFT JOIN notices USING (nation) GROUP BY nation
""")
def country_coverage(spark, d):
    counted = notices(spark, d).groupBy("nation").agg(F.count("*").alias("n_notices"), F.sum(F.col("value").cast("decimal(18,2)")).alias("total"))
    every = table(spark, d, "nation").select(F.col("n_name").alias("nation"))
    return every.join(counted, "nation", "left").select("nation", F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"), F.coalesce(F.col("total").cast("double"), F.lit(0.0)).alias("total"))


_FACETS_SQL = """
f AS (SELECT *, CASE status WHEN 'F' THEN 'AWARD' WHEN 'P' THEN 'PIPELINE' ELSE 'LIVE_TENDER' END AS signal_type, CASE WHEN id % 3 = 0 THEN 'award' ELSE 'estimated_contract' END AS amount_kind,
  CASE WHEN id % 4 > 0 THEN 'EUR' ELSE 'GBP' END AS currency, CASE WHEN status = 'F' THEN day + 60 END AS award_date, CASE WHEN id % 5 > 0 THEN value END AS value_max, day + (id % 300)::INTEGER AS due FROM notices)"""


def _faceted(spark, d):
    """Notices with all that a reader may filter by."""
    i, day = F.col("id"), F.col("day")
    return notices(spark, d).withColumns({
        "provenance": F.array(F.concat(F.lit("s"), i % 7), F.concat(F.lit("s"), i % 5)), "signal_type": F.when(F.col("status") == "F", "AWARD").when(F.col("status") == "P", "PIPELINE").otherwise("LIVE_TENDER"),
        "capabilities": F.filter(F.array(F.lit("crm"), F.lit("ai")), lambda c: (i + F.length(c)) % 3 > 0), "categories": F.array("segment"), "regions": F.array("region", "nation"), "codes": F.array("priority"),
        "amount_kind": F.when(i % 3 == 0, "award").otherwise("estimated_contract"), "currency": F.when(i % 4 > 0, "EUR").otherwise("GBP"), "value_max": F.when(i % 5 > 0, F.col("value")),
        "published": day, "deadline": F.date_add(day, (i % 300).cast("int")).cast("timestamp_ntz"), "award_date": F.when(F.col("status") == "F", F.date_add(day, 60)),
        "suppliers": F.array(F.concat(F.lit("Fournisseur-"), i % 40), F.lit(None).cast("string")), "first_seen": day.cast("timestamp_ntz"), "updated": F.date_add(day, 1).cast("timestamp_ntz"),
    })


@query(f"""
WITH {NOTICES_SQL}, {_FACETS_SQL}
SELECT 'awards' AS choice, id FROM f WHERE status = 'F' AND (id % 7 = 2 OR id % 5 = 2) AND segment = 'BUILDING' AND amount_kind = 'award' AND currency = 'EUR' AND award_date >= DATE '1996-01-01' AND award_date <= DATE '2000-06-30'
  AND contains('fournisseur ' || id % 40, 'seur 1') AND value_max >= 1000
UNION ALL SELECT 'open', id FROM f WHERE status = 'O' AND (id + 3) % 3 > 0 AND contains(lower(buyer), '#0000000') AND (contains(lower(region), 'am') OR contains(lower(nation), 'am')) AND starts_with(priority, '2') AND value_max <= 300000
  AND due::TIMESTAMP > TIMESTAMP '2000-01-01' AND ceil(epoch(due::TIMESTAMP - TIMESTAMP '2000-01-01') / 86400) <= 90
UNION ALL SELECT 'new', id FROM f WHERE day = DATE '2000-01-01'
UNION ALL SELECT 'updated', id FROM f WHERE day = DATE '1999-12-31'
""")
def filter_all_facets(spark, d):
    """Four choices of a reader, which together use every facet."""
    at = now("2000-01-01 00:00:00")
    rows = _faceted(spark, d)
    chosen = {
        "awards": search.Filters(kind="AWARD", source="s2", sector="BUILDING", amount_kind="award", currency="EUR", award_from="1996-01-01", award_to="2000-06-30", supplier="SEUR 1", value_from=1000),
        "open": search.Filters(kind="LIVE_TENDER", capability="crm", buyer="#0000000", region="AM", code_prefix="2", value_to=300000, due_within_days=90),
        "new": search.Filters(change="new"), "updated": search.Filters(change="updated"),
    }
    parts = [rows.where(search.conjunction(f.predicates(at))).select(F.lit(name).alias("choice"), "id") for name, f in chosen.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query(f"""
WITH {NOTICES_SQL}, {_FACETS_SQL},
k AS (SELECT id, [0, 4, 6, 9, 18, 36, 50][id % 7 + 1] AS points, id % 2 AS coded, id % 3 AS tier, CASE status WHEN 'O' THEN 3 WHEN 'P' THEN 1 ELSE 0 END AS openness, id % 4 AS breadth, id % 5 AS in_title,
  CASE WHEN due::TIMESTAMP > TIMESTAMP '2000-01-01' THEN due END AS due, day FROM f)
SELECT 'best' AS "by", id, row_number() OVER (ORDER BY points DESC, coded DESC, tier, openness DESC, breadth DESC, in_title DESC, due NULLS LAST, day DESC, id) AS rank FROM k QUALIFY rank <= 300
UNION ALL SELECT 'recent', id, row_number() OVER (ORDER BY tier, day DESC, id) AS rank FROM k QUALIFY rank <= 100
UNION ALL SELECT 'deadline', id, row_number() OVER (ORDER BY tier, due NULLS LAST, id) AS rank FROM k QUALIFY rank <= 100
""")
def ordered_criteria(spark, d):
    """The first 300 by all nine criteria, and the first hundred of two orders by tier: top-k reports."""
    i, at = F.col("id"), now("2000-01-01 00:00:00")
    rows = _faceted(spark, d)
    state = F.when(F.col("status") == "O", "OPEN").when(F.col("status") == "P", "FUTURE").otherwise("AWARDED")
    points = F.get(F.array(*map(F.lit, [0, 4, 6, 9, 18, 36, 50])), (i % 7).cast("int"))
    best = search.best_order(points, i % 2, i % 3, state, i % 4, i % 5, F.col("deadline"), F.col("published"), i, at)
    orders = {"best": (best, 300)} | {by: (search.tiered_order(i % 3, by, F.col("published"), F.col("updated"), F.col("deadline"), at, i), 100) for by in ("recent", "deadline")}
    parts = [search.ranked(rows, order, most).select(F.lit(by).alias("by"), "id", "rank") for by, (order, most) in orders.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"""
WITH {NOTICES_SQL}, {_FACETS_SQL}
SELECT id FROM f WHERE contains(lower(segment || ' ' || nation || ' ' || regexp_replace(priority, '[^0-9A-Za-z]+', ' ', 'g')), 'build') AND contains(lower(segment || ' ' || nation || ' ' || regexp_replace(priority, '[^0-9A-Za-z]+', ' ', 'g')), 'urgent')
  AND contains('fournisseur ' || id % 40, 'seur 2') AND currency = 'EUR' AND day >= DATE '1996-01-01' AND value_max >= 5000 AND value_max <= 250000
""")
def related_choices(spark, d):
    """Related records that a reader's words, party, currency, days and amounts leave."""
    rows = _faceted(spark, d).select("id", F.concat_ws(" ", "segment", "nation", "priority").alias("text"), F.col("suppliers").alias("party"), "day", "currency", F.col("value_max").alias("value"))
    chosen = search.RelatedFilters(words="Build URGENT", party="seur-2", currency="EUR", day_from="1996-01-01", least=5000, most=250000)
    return rows.where(search.conjunction(chosen.predicates())).select("id")
