"""Queries of nested XML: orders written as notices, line items as their lots, and read back by schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidstream.sources import notices_xml as nx
from bidstream.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _lots(spark, d, text):
    """(o_orderkey, lots): an order's line items, each written as text, in order."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.struct("l_linenumber", text.alias("t")).alias("lot"))
    return lines.groupBy("o_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("lot")), lambda x: x["t"]), "").alias("lots"))


def _element(name, *content):
    return F.concat(F.lit(f"<{name}>"), *content, F.lit(f"</{name.split(' ')[0]}>"))


def _eforms(spark, d):
    """Orders as notices in eForms; some are cut short, declare a type, are another document, or have another name than their file."""
    day = lambda c: F.col(c).cast("date").cast("string")
    even = F.col("l_linenumber") % 2 == 0
    period = _element(
        "cac:TenderSubmissionDeadlinePeriod", _element("cbc:EndDate", day("l_shipdate"), F.when(even, "").otherwise("Z")),
        F.when(even, F.lit("<cbc:EndTime>12:00:00+01:00</cbc:EndTime>")).otherwise(F.lit("")),
    )
    asked = F.when(F.col("l_linenumber") % 3 == 0, _element("cac:ParticipationRequestReceptionPeriod", _element("cbc:EndDate", F.date_add(F.col("l_shipdate").cast("date"), (F.col("l_suppkey") % 5 - 2).cast("int")).cast("string")))).otherwise(F.lit(""))
    system = F.when(F.col("l_returnflag") == "A", F.lit('<cac:ContractingSystem><cbc:ContractingSystemTypeCode listName="framework-agreement">fa-mix</cbc:ContractingSystemTypeCode></cac:ContractingSystem>')).otherwise(F.lit(""))
    lot = _element(
        "cac:ProcurementProjectLot", F.concat(F.lit('<cbc:ID schemeName="Lot">LOT-'), F.col("l_linenumber"), F.lit("</cbc:ID>")),
        _element("cac:ProcurementProject", _element("cbc:Name", F.concat(F.lit("Parts &amp; "), "l_linestatus"))), _element("cac:TenderingProcess", period, asked, system),
    )
    key = F.col("o_orderkey")
    root = F.when(key % 19 == 0, "Invoice").when(key % 4 == 0, "ContractAwardNotice").otherwise("ContractNotice")
    body = F.concat(_element("cbc:ID", key.cast("string")), _element("cbc:VersionID", F.lit("01")), _element("cbc:NoticeTypeCode", F.lit("cn-standard")), "lots")
    text = F.concat(F.when(key % 17 == 0, "<!DOCTYPE x>").otherwise("<?xml version='1.0'?>"), F.lit("<"), root, F.lit(' xmlns:cbc="urn:b" xmlns:cac="urn:a">'), body, F.lit("</"), root, F.lit(">"))
    xml = F.when(key % 13 == 0, F.substr(text, F.lit(1), F.length(text) - 30)).otherwise(text)
    stem = F.concat(F.when(key % 23 == 0, key + 1).otherwise(key).cast("string"), F.lit("-01"))
    return _lots(spark, d, lot).select("o_orderkey", stem.alias("stem"), xml.alias("xml"))


_FAULT = "CASE WHEN k % 17 = 0 THEN 'unsafe' WHEN k % 19 = 0 THEN 'another document' WHEN k % 13 = 0 THEN 'malformed' WHEN k % 23 = 0 THEN 'another notice' END"


@query(f"""
WITH l AS (SELECT l_orderkey AS k, l_linenumber AS n, l_linestatus AS mode, l_returnflag = 'A' AS fa, l_shipdate::DATE AS s, l_shipdate::DATE + (l_suppkey % 5 - 2)::INTEGER AS c FROM lineitem WHERE {_FAULT.replace('k %', 'l_orderkey %')} IS NULL),
t AS (SELECT *, CASE WHEN n % 2 = 0 THEN s::VARCHAR || 'T12:00:00+01:00' ELSE s::VARCHAR END AS st, CASE WHEN n % 2 = 0 THEN s::TIMESTAMP + INTERVAL 11 HOUR ELSE s::TIMESTAMP END AS sa FROM l)
SELECT k::VARCHAR AS notice_id, 'LOT-' || n AS lot_id, 'Parts & ' || mode AS title, CASE WHEN n % 3 = 0 AND (c::TIMESTAMP < sa OR (c::TIMESTAMP = sa AND c::VARCHAR < st)) THEN c::VARCHAR ELSE st END AS deadline, fa AS framework FROM t
""")
def eforms_lots(spark, d):
    """A row for each lot of all notices that can be read."""
    return nx.eforms_lots(nx.eforms(_eforms(spark, d))).select("notice_id", "lot_id", "title", "deadline", "framework")


@query(f"SELECT k, {_FAULT} AS fault, CASE WHEN {_FAULT} IS NULL THEN k % 4 = 0 END AS result, CASE WHEN {_FAULT} IS NULL THEN n END AS lots FROM (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1)")
def eforms_faults(spark, d):
    """Every file with its fault, or what it is and how many lots it has."""
    out = nx.eforms(_eforms(spark, d))
    return out.select(F.col("o_orderkey").alias("k"), "fault", "result", F.size("lots").cast("long").alias("lots"))


def _feed(spark, d):
    """Pages of an Atom feed, one for each day, whose entries are orders; every 29th day's page is not in order, and some entries are withdrawn."""
    clock = lambda n: F.concat(F.lit("T"), F.lpad(F.floor(n / 3600).cast("string"), 2, "0"), F.lit(":"), F.lpad(F.floor(n / 60 % 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((n % 60).cast("string"), 2, "0"), F.lit("Z"))
    lot = _element(
        "cac:ProcurementProjectLot", _element("cbc:ID", F.col("l_linenumber").cast("string")),
        _element("cac:ProcurementProject", _element("cbc:Name", F.col("l_linestatus")), _element("cac:RequiredCommodityClassification", _element("cbc:ItemClassificationCode", F.lpad((F.col("l_partkey") % 1000).cast("string"), 8, "0")))),
    )
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("price"), F.col("o_orderdate").cast("date").alias("day"))
    rows = rows.join(_lots(spark, d, lot), "o_orderkey", "left")
    key = F.col("o_orderkey")
    second = key % 86000
    state = F.when(F.col("o_orderstatus") == "F", "ADJ").when(F.col("o_orderstatus") == "P", "EV").otherwise("PUB")
    day = F.col("day").cast("string")
    folder = _element(
        "ext:ContractFolderStatus", _element("cbc:ContractFolderID", F.concat(F.lit("R/"), key)), _element("ebc:ContractFolderStatusCode listURI=\"u\"", state),
        _element("ext:LocatedContractingParty", _element("cac:Party", _element("cac:PartyName", _element("cbc:Name", F.concat(F.lit("Órgano "), "o_custkey"))))),
        _element("cac:ProcurementProject", _element("cbc:Name", F.concat(F.lit("Servicio "), "o_orderpriority")), _element("cac:BudgetAmount", F.concat(F.lit('<cbc:TaxExclusiveAmount currencyID="EUR">'), "price", F.lit("</cbc:TaxExclusiveAmount>")))),
        F.coalesce("lots", F.lit("")),
        _element("cac:TenderingProcess", _element("cbc:ProcedureCode", (key % 12).cast("string")), _element("cbc:ContractingSystemCode", (key % 5).cast("string")),
                 _element("cac:TenderSubmissionDeadlinePeriod", _element("cbc:EndDate", F.date_add("day", 30).cast("string")), _element("cbc:EndTime", F.lit("14:00:00")))),
    )
    entry = _element("entry", _element("id", F.concat(F.lit("https://feed.example/e/"), key)), _element("updated", F.concat(day, clock(second))), F.concat(F.lit('<link href="https://portal.example/n/'), key, F.lit('"/>')), folder)
    gone = F.concat(F.lit('<at:deleted-entry ref="https://feed.example/e/'), key, F.lit('" when="'), day, clock(second), F.lit('"/>'))
    withdrawn = key % 31 == 0
    order = F.struct(F.when(F.dayofyear("day") % 29 == 0, second).otherwise(-second).alias("o"), key.alias("k"), F.when(withdrawn, "").otherwise(entry).alias("e"), F.when(withdrawn, gone).otherwise("").alias("g"))
    pages = rows.groupBy("day").agg(F.array_sort(F.collect_list(order)).alias("x"))
    text = lambda part: F.array_join(F.transform("x", lambda x: x[part]), "")
    head = F.concat(F.lit('<feed xmlns="urn:atom" xmlns:at="urn:t" xmlns:cac="urn:a" xmlns:cbc="urn:b" xmlns:ebc="urn:e" xmlns:ext="urn:x"><updated>'), F.col("day").cast("string"), F.lit("T23:59:59Z</updated>"))
    return pages.select("day", F.concat(head, text("g"), text("e"), F.lit("</feed>")).alias("xml"))


_PAGES_SQL = """
o AS (SELECT o_orderkey AS k, o_custkey, o_orderstatus AS st, o_orderpriority, o_totalprice, o_orderdate::DATE AS day, o_orderkey % 86000 AS second, o_orderkey % 31 = 0 AS gone FROM orders),
bad AS (SELECT day FROM o WHERE NOT gone AND dayofyear(day) % 29 = 0 GROUP BY day HAVING count(DISTINCT second) > 1),
good AS (SELECT * FROM o WHERE day NOT IN (SELECT day FROM bad)),
facts AS (SELECT *, k % 12 IN (3, 6, 7, 11) OR k % 5 IN (3, 4) AS shut, CASE WHEN gone THEN 'WITHDRAWN' WHEN st = 'F' THEN 'ADJ' WHEN st = 'P' THEN 'EV' ELSE 'PUB' END AS state FROM good)"""
_STATUS_SQL = "CASE WHEN gone THEN 'withdrawn' WHEN state = 'ADJ' THEN 'awarded' WHEN state = 'EV' OR shut THEN 'closed' ELSE 'active' END"


@query(f"""
WITH {_PAGES_SQL}
SELECT k::VARCHAR AS entry, state, {_STATUS_SQL} AS status, CASE WHEN state = 'ADJ' THEN 'AWARD' WHEN NOT gone AND k % 5 IN (1, 2) THEN 'FRAMEWORK' ELSE 'LIVE_TENDER' END AS kind,
  CASE WHEN gone THEN 'Withdrawn notice ' || k ELSE 'Servicio ' || o_orderpriority END AS title, CASE WHEN NOT gone THEN 'Órgano ' || o_custkey END AS buyer,
  CASE WHEN NOT gone THEN round(o_totalprice::DECIMAL(18,2)::DOUBLE, 2) END AS amount, CASE WHEN NOT gone THEN 'EUR' END AS currency, CASE WHEN NOT gone THEN (day + 30)::VARCHAR END AS deadline,
  CASE WHEN gone THEN 0 ELSE coalesce(n, 0) END AS lots FROM facts LEFT JOIN (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1) USING (k)
""")
def codice_facts(spark, d):
    """Entries of all pages that are in order, withdrawn ones too."""
    facts = nx.codice_facts(nx.codice_entries(_feed(spark, d), hosts=("portal.example",)))
    return facts.select("entry", "state", "status", "kind", "title", "buyer", F.round("amount", 2).alias("amount"), "currency", "deadline", F.size("lots").cast("long").alias("lots"))


@query(f"""
WITH {_PAGES_SQL}
SELECT k::VARCHAR AS entry, {_STATUS_SQL} AS status, l_linenumber::VARCHAR AS lot_id, l_linestatus AS title, lpad((l_partkey % 1000)::VARCHAR, 8, '0') AS code FROM facts JOIN lineitem ON l_orderkey = k WHERE NOT gone
""")
def codice_lots(spark, d):
    """A row for each lot of the entries."""
    lots = nx.codice_lots(nx.codice_facts(nx.codice_entries(_feed(spark, d), hosts=("portal.example",))))
    return lots.select("entry", "status", "lot_id", "title", F.array_join("codes", ",").alias("code"))


@query(f"WITH {_PAGES_SQL} SELECT day, 'not newest first' AS fault FROM bad")
def codice_faults(spark, d):
    """Pages that are held back whole."""
    return nx.codice_entries(_feed(spark, d), hosts=("portal.example",)).where("fault is not null").select("day", "fault")
