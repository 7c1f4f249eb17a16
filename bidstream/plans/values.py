"""Queries of functions over the given tables: texts, dates, amounts and names as they stand there, or as they are written from columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidstream.functions import dates, text as tx, translation as tr
from bidstream.operators import normalise, tiers
from bidstream.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""
SELECT doc_id, sha256(' ' || trim(regexp_replace(replace(strip_accents(lower(text)), 'ß', 'ss'), '[^\\p{L}\\p{N}_]+', ' ', 'g')) || ' ') AS for_index,
  sha256(trim(regexp_replace(strip_accents(lower(text)), '[^\\p{L}\\p{N}]+', ' ', 'g'))) AS for_query FROM documents
""")
def folded_documents(spark, d):
    """Whole documents as the index and as a search reads them."""
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return table(spark, d, "documents").select("doc_id", digest(tx.search_text(F.col("text"))).alias("for_index"), digest(tx.folded(F.col("text"))).alias("for_query"))


@query("""
SELECT o_orderkey, epoch_us(CASE o_orderkey % 7 WHEN 1 THEN o_orderdate::DATE::TIMESTAMP + INTERVAL 8 HOUR + INTERVAL 30 MINUTE WHEN 2 THEN o_orderdate::DATE::TIMESTAMP + INTERVAL 10 HOUR + INTERVAL 30 MINUTE
  WHEN 6 THEN NULL ELSE o_orderdate::DATE::TIMESTAMP END) AS instant FROM orders
""")
def dates_of_orders(spark, d):
    """Days of orders in seven written forms, one of which is none."""
    day, form = F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 7
    pattern = lambda p: F.date_format(day, p)
    text = (
        F.when(form == 0, pattern("yyyy-MM-dd")).when(form == 1, pattern("yyyy-MM-dd'T10:30:00+02:00'")).when(form == 2, pattern("yyyy-MM-dd'T10:30:00Z'"))
        .when(form == 3, pattern("dd/MM/yyyy")).when(form == 4, pattern("d MMM yyyy")).when(form == 5, pattern("yyyyMMdd")).otherwise(pattern("'week of' MMMM"))
    )
    return table(spark, d, "orders").select("o_orderkey", F.unix_micros(dates.parse_date(text)).alias("instant"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CASE WHEN l_partkey % 5 = 4 THEN NULL WHEN l_partkey % 5 = 0 THEN l_shipdate::DATE::VARCHAR
  WHEN l_partkey % 5 = 1 THEN l_shipdate::DATE::VARCHAR || 'T14:05:00+01:00' WHEN l_partkey % 5 = 2 THEN l_shipdate::DATE::VARCHAR || 'T14:05:00Z' ELSE l_shipdate::DATE::VARCHAR END AS deadline FROM lineitem
""")
def deadlines_of_lines(spark, d):
    """Days of shipping with clocks, either with an offset, both, or neither."""
    kind, day = F.col("l_partkey") % 5, F.col("l_shipdate").cast("date").cast("string")
    written = F.concat(day, F.when(kind.isin(1, 2), "+01:00").otherwise(""))
    clock = F.when(kind == 1, "14:05:00").when(kind == 2, "14:05:00Z").when(kind == 3, "14:05:00").when(kind == 4, "two o'clock")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", dates.xml_deadline(written, clock).alias("deadline"))


ZONES = ["Europe/London", "America/New_York", "Asia/Tokyo", None, "Nowhere/Zone"]
_ZONE_SQL = "[" + ", ".join(f"'{z}'" if z else "NULL" for z in ZONES) + "]"
_END_SQL = lambda day, zone, time: (
    f"CASE WHEN {zone} IN ('Europe/London', 'America/New_York', 'Asia/Tokyo') THEN epoch_us(timezone({zone}, CASE WHEN {time} THEN {day}::TIMESTAMP + INTERVAL 870 MINUTE ELSE {day}::TIMESTAMP + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND END)) "
    f"ELSE epoch_us({day}::TIMESTAMP + INTERVAL 36 HOUR - INTERVAL 1 MICROSECOND) END"
)


@query(f"""
WITH o AS (SELECT o_orderkey AS k, o_orderdate::DATE + 30 AS late, o_orderdate::DATE + 10 AS early, {_ZONE_SQL}[o_orderkey % 5 + 1] AS zone, o_orderkey % 2 = 0 AS timed FROM orders)
SELECT k, CASE WHEN k % 11 = 0 THEN NULL WHEN k % 3 = 0 THEN {_END_SQL("early", "zone", "false")} ELSE {_END_SQL("late", "coalesce(zone, '')", "timed")} END AS ends_us FROM o
""")
def deadline_instants(spark, d):
    """When each order's response window ends: tenders in local time or for a day, in known, unknown and no zones, applications before them, and superseded ones."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    zone = F.get(F.array(*[F.lit(z).cast("string") for z in ZONES]), (k % 5).cast("int"))
    none = F.lit(None).cast("string")
    fact = lambda kind, status, after, time, precision: F.struct(
        F.lit(kind).alias("kind"), status.alias("status"), F.date_add(day, after).cast("string").alias("date"), time.alias("time"), zone.alias("timezone"), precision.alias("precision"), none.alias("instant"))
    timed = k % 2 == 0
    status = F.when(k % 11 == 0, "superseded").otherwise("current")
    tender = fact("tender", status, 30, F.when(timed, "14:30"), F.when(timed, "local_time").otherwise("date"))
    listed = F.array(tender, fact("questions", F.lit("current"), 5, none, F.lit("date")))
    both = F.concat(listed, F.array(fact("application", status, 10, none, F.lit("date"))))
    return table(spark, d, "orders").select(k.alias("k"), F.unix_micros(dates.response_deadline(F.when(k % 3 == 0, both).otherwise(listed))).alias("ends_us"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN '' ELSE CASE WHEN o_orderkey % 4 = 1 THEN format('{:,}', round_even(o_totalprice, 0)::BIGINT) || ' to ' || format('{:,}', round_even(o_totalprice, 0)::BIGINT + 500) ELSE format('{:,}', round_even(o_totalprice, 0)::BIGINT) END
  || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE ' EUR' END END AS shown, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_totalprice END AS amount FROM orders
""")
def amounts_of_orders(spark, d):
    """Prices as readers see them, one or a range, with or without a currency; and as numbers, where they are not negative."""
    k, price = F.col("o_orderkey"), F.bround("o_totalprice", 0)
    low, high = F.when(k % 4 == 1, price), F.when(k % 4 == 1, price + 500).when(k % 4 != 3, price)
    text = F.when(k % 6 == 0, F.concat(F.lit("-"), F.col("o_totalprice").cast("string"))).otherwise(F.col("o_totalprice").cast("string"))
    return table(spark, d, "orders").select("o_orderkey", tx.money_shown(low, high, F.when(k % 5 != 0, "EUR")).alias("shown"), tx.money(text).alias("amount"))


@query("""
WITH c AS (SELECT doc_id, text, substr(text, 1, 119) AS cut FROM documents)
SELECT doc_id, CASE WHEN length(text) <= 120 THEN text WHEN regexp_matches(cut, '\\s\\S*$') THEN regexp_replace(cut, '\\s+\\S*$', '') || '…' ELSE cut || '…' END AS short FROM c
""")
def texts_cut(spark, d):
    """The first 120 characters of documents, at a word's end."""
    return table(spark, d, "documents").select("doc_id", tx.prefix(F.col("text"), 120).alias("short"))


@query("""
SELECT doc_id, true AS back, 0 AS faults, CASE WHEN regexp_matches(regexp_replace(text, 'https?://[^\\s<>"'')\\]]+|[\\w.+-]+@[\\w-]+(?:\\.[\\w-]+)+', ' ', 'g'), '[0-9]') THEN 'numbers' ELSE '' END AS found FROM documents
""")
def literals_of_documents(spark, d):
    """Texts with their literals masked and put back; a copy has no faults, one with another digit everywhere has, where there are any."""
    masked, literals = tr.masked(F.col("text"))
    other = F.translate("text", "0123456789", "1234567890")
    found = F.array_join(F.filter(tr.faults(F.col("text"), other), lambda x: x == "numbers"), ",")
    return table(spark, d, "documents").select("doc_id", (tr.restored(masked, literals) == F.col("text")).alias("back"), F.size(tr.faults(F.col("text"), F.col("text"))).alias("faults"), found.alias("found"))


@query("""
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN o_orderdate::DATE::VARCHAR WHEN 1 THEN o_orderdate::DATE::VARCHAR || 'T17:00' WHEN 2 THEN o_orderdate::DATE::VARCHAR || 'T12:00' WHEN 3 THEN '' ELSE o_orderdate::DATE::VARCHAR || '|' || (o_orderdate::DATE + 40)::VARCHAR END AS days FROM orders
""")
def prose_days(spark, d):
    """Days of orders told in sentences: alone, at 5pm, at noon before the day, after a stop word, and twice."""
    day, form = F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 5
    said = lambda x: F.date_format(x, "d MMMM yyyy")
    text = (
        F.when(form == 0, F.concat(F.lit("The closing date: "), said(day), F.lit(". Contract award later."))).when(form == 1, F.concat(F.lit("Closing date is "), said(day), F.lit(" at 5pm.")))
        .when(form == 2, F.concat(F.lit("Closing date: 12 noon on "), said(day))).when(form == 3, F.concat(F.lit("Closing date to be told. Contract award "), said(day)))
        .otherwise(F.concat(F.lit("Deadline for bids: "), said(F.date_add(day, 40)), F.lit("; closing date "), said(day)))
    )
    return table(spark, d, "orders").select("o_orderkey", F.array_join(dates.prose_deadlines(text, ("closing date", "deadline for bids"), ("contract award",)), "|").alias("days"))


@query("""
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'AWARD' WHEN 'P' THEN CASE WHEN o_orderkey % 3 = 0 THEN 'RFI' WHEN o_orderkey % 5 = 0 THEN 'EARLY_MARKET_ENGAGEMENT' ELSE 'PIPELINE' END
  ELSE CASE WHEN o_orderpriority = '1-URGENT' THEN 'FRAMEWORK' WHEN o_orderkey % 3 = 0 THEN 'RFI' WHEN o_orderkey % 7 = 0 THEN 'RFP' ELSE 'LIVE_TENDER' END END AS kind FROM orders
""")
def kinds_of_orders(spark, d):
    """Finished orders as awards, pending ones as plans, open ones as tenders, with what their titles and texts say."""
    k = F.col("o_orderkey")
    stage = F.when(F.col("o_orderstatus") == "F", "award").when(F.col("o_orderstatus") == "P", "planning").otherwise("tender")
    title = F.concat(F.lit("Order "), k, F.when(k % 3 == 0, " (RFI)").otherwise(""))
    text = F.concat(F.lit("Works. "), F.when(k % 5 == 0, "A soft market test. ").otherwise(""), F.when(k % 7 == 0, "Requests for proposals follow a request for proposal.").otherwise(""))
    return table(spark, d, "orders").select("o_orderkey", normalise.kind_of(stage, title, text, F.lit(None).cast("string"), F.col("o_orderpriority") == "1-URGENT").alias("kind"))


@query("""
WITH l AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n, CASE WHEN l_suppkey % 5 > 0 THEN 'https://docs.example/' || l_suppkey % 4 END AS url, l_partkey FROM lineitem),
f AS (SELECT k, url, min_by(l_partkey, n) AS part, min(n) AS n FROM l WHERE url IS NOT NULL GROUP BY k, url)
SELECT l.k, coalesce(string_agg(f.url || ' ' || f.part, '|' ORDER BY f.n), '') AS documents FROM (SELECT DISTINCT k FROM l) l LEFT JOIN f ON f.k = l.k GROUP BY l.k
""")
def documents_of_orders(spark, d):
    """Line items as documents, of which an order has one for each link: the first."""
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    url = F.when(F.col("l_suppkey") % 5 > 0, F.concat(F.lit("https://docs.example/"), F.col("l_suppkey") % 4))
    held = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.struct(url.alias("url"), F.col("l_partkey").cast("string").alias("title")).alias("d")))).alias("x"))
    first = normalise.first_documents(F.transform("x", lambda x: x["d"]))
    return held.select("k", F.array_join(F.transform(first, lambda x: F.concat_ws(" ", x["url"], x["title"])), "|").alias("documents"))


@query("""
SELECT doc_id, concat_ws(chr(10), CASE WHEN doc_id % 4 > 0 THEN source END, CASE WHEN doc_id % 3 > 0 THEN lang END, CASE WHEN doc_id % 5 > 0 THEN 'Due ' || doc_id END, n_chars::VARCHAR) AS brief,
  trim(regexp_replace(concat_ws(' ', CASE WHEN doc_id % 4 > 0 THEN source END, substr(text, 1, 60)), '\\s+', ' ', 'g')) AS joined, coalesce(CASE WHEN doc_id % 2 = 0 THEN 'en ' || doc_id END, 'fr ' || source) AS shown FROM documents
""")
def briefs_of_documents(spark, d):
    """What is known of documents in a few lines, as a search reads it, and in English where there is any."""
    i = F.col("doc_id")
    source, lang, due = F.when(i % 4 > 0, F.col("source")), F.when(i % 3 > 0, F.col("lang")), F.when(i % 5 > 0, i.cast("string"))
    texts = F.create_map(F.lit("fr"), F.concat(F.lit("fr "), "source"), F.lit("en"), F.when(i % 2 == 0, F.concat(F.lit("en "), i)).otherwise(" "))
    return table(spark, d, "documents").select(
        "doc_id", tx.brief(source, lang, due, F.col("n_chars").cast("string")).alias("brief"), tx.joined(source, F.substring("text", 1, 60)).alias("joined"), tx.in_language(texts).alias("shown"),
    )


@query("""
SELECT page_id, starts_with(url, 'https://') AND regexp_matches(url, '^https://([^/?#@:]+\\.)?example\\.com([/?#]|$)') AS permitted,
  (page_id % 1000)::VARCHAR || '-' || (2020 + page_id % 5) AS number FROM pages
""")
def links_of_pages(spark, d):
    """Which pages' links may be shown, and control numbers that their texts would name, with zeros and either dash."""
    i = F.col("page_id")
    text = F.concat(F.lit("see "), F.lpad((i % 1000).cast("string"), 5, "0"), F.when(i % 2 == 0, "/").otherwise("-"), (i % 5 + 2020).cast("string"), F.lit(", and page 12"))
    return table(spark, d, "pages").select("page_id", tiers.permitted_url(F.col("url"), ["example.com"]).alias("permitted"), F.array_join(tiers.control_numbers(text), ",").alias("number"))
