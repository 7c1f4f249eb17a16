"""Queries of functions: each order takes one of a list of cases, and the function is applied to the whole table of them.

The SQL has what has to come out, by hand, for each case.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidstream.functions import dates, text as tx, translation as tr
from bidstream.operators import classify, normalise, related, reviews, scope, tiers
from bidstream.operators.capabilities import Capability, prefiltered
from bidstream.sources.tables import table

QUERIES, SQL = {}, {}


def _literal(value: object, kind: str) -> str:
    if value is None:
        return f"NULL::{kind}"
    if isinstance(value, bool):
        return str(value).lower()
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else f"{value}::{kind}"


def cases(name: str, schema: str, columns: dict[str, str], rows: list[tuple], made: Callable[[DataFrame], list[Column]]) -> None:
    """Registers a query; rows: (inputs .., what comes out ..), by the schema of the inputs and the columns' SQL types."""
    n_in, n = len(schema.split(", ")), len(rows)

    def run(spark, d):
        listed = spark.createDataFrame([(i, *r[:n_in]) for i, r in enumerate(rows)], f"case_ int, {schema}")
        ids = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.pmod("o_orderkey", F.lit(n)).cast("int").alias("case_"))
        df = ids.join(F.broadcast(listed), "case_")  # one row for each case
        return df.select("id", *[c.alias(a) for c, a in zip(made(df), columns, strict=True)])

    values = ", ".join("(" + ", ".join([str(i), *[_literal(v, t) for v, t in zip(r[n_in:], columns.values(), strict=True)]]) + ")" for i, r in enumerate(rows))
    QUERIES[name] = run
    SQL[name] = f"SELECT o_orderkey AS id, v.* EXCLUDE (case_) FROM orders JOIN (VALUES {values}) AS v(case_, {', '.join(columns)}) ON o_orderkey % {n} = case_"


_LONG = "<p>" + "ab " * 8_500 + "end</p>"
c = lambda name: F.col(name)
listed = lambda column: F.array_join(column, "|")

cases("text_cleaned", "t string", {"n": "INTEGER", "shown": "VARCHAR", "plain": "VARCHAR"}, [
    ("<p>Hello&nbsp;<b>wörld</b></p><script>x()</script>", 11, "Hello wörld", "hello wörld"), ("a < b", 5, "a < b", "a b"), (None, 0, "", ""),
    ("ﬁne  ①\n", 6, "fine 1", "fine 1"), ("<style>p{}</style><p>X", 1, "X", "x"), (_LONG, 25_503, "ab ab ab ab ", "ab ab ab ab "),
], lambda df: [F.length(tx.clean(c("t"))), F.substring(tx.clean(c("t")), 1, 12), F.substring(tx.normal_text(c("t")), 1, 12)])

cases("text_folded", "t string", {"for_index": "VARCHAR", "for_query": "VARCHAR"}, [
    ("ÉcoleStraße_x", " ecolestrasse_x ", "ecolestraße x"), ("Road-Works_2", " road works_2 ", "road works 2"), (None, "  ", ""), ("ＡＢ①", " ab1 ", "ab1"),
], lambda df: [tx.search_text(c("t")), tx.folded(c("t"))])

cases("dates_parsed", "t string", {"instant": "VARCHAR"}, [
    ("2026-09-17", "2026-09-17 00:00:00"), ("2026-09-17T10:30:00Z", "2026-09-17 10:30:00"), ("2026-09-17T10:30:00+02:00", "2026-09-17 08:30:00"), ("17/09/2026", "2026-09-17 00:00:00"),
    ("17 September 2026", "2026-09-17 00:00:00"), ("7 Sep 2026", "2026-09-07 00:00:00"), ("20260917", "2026-09-17 00:00:00"), ("soon", None), (None, None), ("31/02/2026", None),
], lambda df: [F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), dates.parse_date(c("t")).cast("timestamp_ntz")), "yyyy-MM-dd HH:mm:ss")])

cases("day_and_clock", "day string, clock string", {"deadline": "VARCHAR"}, [
    ("2026-09-17", None, "2026-09-17"), ("2026-09-17+02:00", "10:30:00", "2026-09-17T10:30:00+02:00"), ("2026-09-17+02:00", "10:30:00Z", "2026-09-17T10:30:00Z"),
    ("2026-09-17", "10:30:00", "2026-09-17"), ("2026-09-17", "noon", None), ("soon", "10:30:00Z", None), (None, None, None),
], lambda df: [dates.xml_deadline(c("day"), c("clock"))])

_PROSE = [
    ("Application closing date: 9 September 2026. Contract award 1 October 2026", "2026-09-09"), ("Closing date is Thursday 3rd September 2026 at 5pm.", "2026-09-03T17:00"),
    ("Closing date 4 Sept 2026", None), ("Closing date: 12 noon on 14 May 2026", "2026-05-14T12:00"), ("Closing date 1 May 2026 and again: closing date 1 May 2026 at 17:30", "2026-05-01T17:30"),
    ("Closing date: award 2 June 2026", None), ("Nothing is due.", None), (None, None), ("Deadline for bids 31 June 2026", None), ("Deadline for bids: 30 Jun 2026, 12:00 hours; closing date 1 Feb 2026", "2026-02-01|2026-06-30T12:00"),
]
cases("prose_deadlines", "t string", {"days": "VARCHAR"}, [(t, w or "") if t is not None else (t, None) for t, w in _PROSE],
      lambda df: [listed(dates.prose_deadlines(c("t"), ("closing date", "deadline for bids"), ("contract award", "award")))])

cases("engagement_deadline", "t string", {"day": "VARCHAR"}, [
    ("Please respond by 5 May 2026. Contract start 1 July 2026", "2026-05-05"), ("Responses by noon", None), ("Expressions of interest by 2 March 2027 at 10am", "2027-03-02T10:00"), ("Contract start 1 July 2026", None),
], lambda df: [dates.engagement_deadline(c("t"))])

cases("shown_deadline", "a string, b string", {"shown": "VARCHAR"}, [
    ("2026-01-01", "2026-03-01", "2026-03-01"), ("2026-04-01", "2026-03-01", "2026-03-01"), ("2026-01-01", "2025-03-01", "2026-01-01"), (None, "2026-03-01", "2026-03-01"), (None, None, None),
], lambda df: [F.date_format(dates.shown_deadline(F.array(c("a").cast("timestamp_ntz"), c("b").cast("timestamp_ntz")), F.lit("2026-02-01").cast("timestamp_ntz")), "yyyy-MM-dd")])

cases("literals_checked", "s string, t string", {"faults": "VARCHAR", "masked": "VARCHAR", "back": "VARCHAR"}, [
    ("See https://x.org/a and 12,5 m", "Voir https://x.org/a et 12,5 m", "", "See ⟦⟧ and ⟦⟧ m", "See https://x.org/a and 12,5 m"), ("Pay 10", "Payer 11", "numbers", "Pay ⟦⟧", "Pay 10"),
    ("Mail a@b.org", "Écrire", "mailboxes", "Mail ⟦⟧", "Mail a@b.org"), ("x", " ", "empty", "x", "x"), ("Go to http://a.b", "Aller", "links", "Go to ⟦⟧", "Go to http://a.b"),
    ("a long text that has more than forty letters in it", "court", "length", "a long text that has more than forty letters in it", "a long text that has more than forty letters in it"),
], lambda df: [listed(tr.faults(c("s"), c("t"))), tr.masked(c("s"))[0], tr.restored(*tr.masked(c("s")))])

cases("languages_told", "t string", {"code": "VARCHAR", "parts": "VARCHAR"}, [
    ("the road and the bridge", "en", "the road |and the |bridge"), ("die Brücke und der Weg", "de", "die Brücke |und der Weg"), ("le pont et la route", "fr", "le pont et |la route"), ("xyz", None, "xyz"),
], lambda df: [tr.language(c("t")), listed(tr.pieces(c("t"), 11))])

cases("names_compared", "a string, b string", {"ratio": "DOUBLE"}, [
    ("abcd", "abxd", 75.0), ("", "", 100.0), ("a", "b", 0.0), (None, "x", None), ("City of X", "City of X", 100.0), ("abcdefghij", "abcdefghijk", 95.238),
], lambda df: [F.round(related.indel_ratio(c("a"), c("b")), 3)])

cases("texts_picked", "t map<string,string>", {"shown": "VARCHAR"}, [
    ({"fr": "Pont", "en": "Bridge"}, "Bridge"), ({"fr": "Pont", "en": " "}, "Pont"), ({"fr": "Pont", "de": "Brücke"}, "Brücke"), ({}, None),
], lambda df: [tx.in_language(c("t"))])

cases("texts_shortened", "t string", {"short": "VARCHAR", "lot": "VARCHAR"}, [
    ("Lot 2: Bridges and roads of the city", "Lot 2: Bridges and…", "Bridges and roads of the city"), ("🙂🙂🙂", "🙂🙂🙂", "🙂🙂🙂"), ("🙂" * 30, "🙂" * 19 + "…", "🙂" * 30), ("Los 3", "Los 3", None), ("Works", "Works", None),
], lambda df: [tx.prefix(c("t"), 20), tx.lot_title(c("t"), F.lit("works"))])

cases("amounts_shown", "a double, b double, u string", {"shown": "VARCHAR", "money": "DOUBLE"}, [
    (1000.0, 250000.0, "EUR", "1,000 to 250,000 EUR", 250000.0), (None, 1234567.0, "GBP", "1,234,567 GBP", 1234567.0), (5.0, 5.0, None, "5", 5.0), (None, None, "EUR", "", None), (1.0, -3.0, "X", "1 to -3 X", None),
], lambda df: [tx.money_shown(c("a"), c("b"), c("u")), tx.money(c("b").cast("string"))])

cases("keys_sought", "j string", {"found": "VARCHAR"}, [
    ('{"a": {"id": "1", "b": [{"id": 2}, {"c": {"id": "x \\"y\\""}}]}}', '1|2|x "y"'), ('{"b": 1}', ""), ("no json", ""), ('{"id": true, "x": "id"}', "true"),
], lambda df: [listed(tx.under_key(c("j"), "id"))])

cases("briefs", "t string, b string, d string, x string", {"brief": "VARCHAR", "joined": "VARCHAR"}, [
    ("Bridge", "City", "2026-05-01", "Short text", "Bridge\nCity\nDue 2026-05-01\nShort text", "Bridge City Short text"), ("Bridge", None, None, None, "Bridge", "Bridge"), (None, None, None, None, "", ""),
], lambda df: [tx.brief(c("t"), c("b"), c("d"), c("x")), tx.joined(c("t"), c("b"), c("x"))])

cases("scope_exclusions", "t string, x string, k array<string>", {"why": "VARCHAR", "kind": "VARCHAR"}, [
    ("Office furniture", "Desks and chairs", [], "goods or works", "none"), ("Office furniture", "Develop a booking platform for rooms", [], None, "delivery"), ("Maintenance of paths", "x", ["45233000"], "works by code", "none"),
    ("Maintenance of paths", "Repair of the bridge", [], "works by code", "none"), ("Maintenance of paths", "The bridge is excluded", [], None, "none"), ("Job: engineer", "Full time", None, "vacancy", "none"),
    ("Job: engineer", "Through an agency", [], None, "none"), ("Digital strategy", "Workshops", [], None, "generic_digital"), ("New CRM", "Implementation", [], None, "business_system"),
    ("Leistungen", "Entwicklung einer Software für Anträge", [], None, "delivery"), ("Prestations", "Réalisation d'un site internet", [], None, "delivery"), ("Services", "No software is required", [], None, "none"),
    ("Grant for the arts", "Funding", [], "grant", "none"), ("Health", "Social care for adults", [], "care or training", "none"),
], lambda df: [scope.exclusion(c("t"), c("x"), c("k")), scope.scope_kind(c("t"), c("x"))])

_SENSES = [
    scope.Sense("mulesoft"), scope.Sense("flow", needs=("approval", "automation"), reach=3), scope.Sense("AI", cased=True), scope.Sense("apex", bars=("mountain", "roof")), scope.Sense("application", bars=("job application", "planning application")),
]
cases("senses_told", "t string", {"meant": "VARCHAR"}, [
    ("An approval flow in MuleSoft", "mulesoft|flow"), ("The flow of water. Automation elsewhere", ""), ("AI assistant", "AI"), ("ai ai captain", ""), ("Apex of the roof", ""), ("Apex code", "apex"),
    ("A planning application", ""), ("No MuleSoft, but an application", "application"), ("MuleSoft is not required", ""), (None, ""),
], lambda df: [listed(scope.meant(c("t"), _SENSES))])

cases("affirmations", "t string", {"affirmed": "BOOLEAN"}, [
    ("We need crm.", True), ("No crm is wanted.", False), ("Without a portal; crm wanted", True), ("crm is excluded", False), ("crm is not required", False), ("sans crm", False), ("a crms", False),
], lambda df: [scope.says(F.get(scope.clauses(F.element_at(F.split(c("t"), ";"), -1)), 0), scope.words(("crm",)))])

_ORDER = "1. Summary of the work\nDesign and build a new digital service for permits in the city\n2. Location London\n3. Pricing model Fixed"
cases("call_offs", "t string", {"clause": "VARCHAR"}, [
    (_ORDER, "Design and build a new digital service for permits in the city"), ("Summary of the work tbc\n2. Location X", None), ("Design a platform for all of us and them", None),
    ("Summary of the work We need people to interview many users of our shops\n2. Location build software", None),
], lambda df: [scope.call_off(c("t"), "Summary of the work", ("Location", "Pricing model"))])

cases("quote_contexts", "q string", {"context": "VARCHAR"}, [
    ("Develop a new platform", "delivery"), ("The existing platform runs on servers", "existing_system"), ("We may explore a platform", "uncertain"), ("A platform", "mention"), (None, "mention"),
], lambda df: [F.coalesce(scope.quote_context(c("q")), F.lit("mention"))])

cases("scope_texts", "t string", {"scope": "VARCHAR", "asked": "VARCHAR"}, [
    ("Roads under ISO 9001. Bidders must register on the portal. Mail a@b.org", "Roads under  . Mail  ", ""), ("The supplier must have insurance. Nice work.", "The supplier must have insurance. Nice work.", "The supplier must have insurance."),
], lambda df: [F.regexp_replace(classify.scope_text(c("t")), r" +\.", "  ."), listed(classify.requirements(c("t")))])

_QUOTED = "array<struct<points:int,capability:string,phrase:string,quote:string>>"
cases("evidence_compacted", f"e {_QUOTED}", {"slim": "VARCHAR", "stands": "INTEGER"}, [
    ([(58, "crm", "crm", "New crm"), (46, "crm", "crm", "A crm"), (32, "crm", "cases", "cases"), (16, "ai", "bot", "old bot"), (58, "crm", "crm", "New crm again")], "58 crm crm|46 crm crm|16 ai bot", 3), ([], "", 0),
], lambda df: [listed(F.transform(scope.compacted(c("e")), lambda x: F.concat_ws(" ", x["points"].cast("string"), x["capability"], x["phrase"]))),
               F.size(classify.traceable(c("e"), [F.lit("New crm again and cases"), F.lit(None).cast("string")]))])

cases("results_reused", "r string, s string", {"result": "VARCHAR"}, [
    ("kept", scope.signature("rules", 2), "kept"), ("old", scope.signature("rules", 1), None), ("same", "known", "same"), ("none", None, None),
], lambda df: [scope.reusable(c("r"), c("s"), scope.signature("rules", 2), ("known",))])

cases("notice_kinds", "s string, t string, x string, n string, f boolean", {"kind": "VARCHAR"}, [
    ("award", "Request for information", "x", None, False, "AWARD"), ("planning", "RFI: roads", "x", None, False, "RFI"), ("planning", "Roads", "x", "UK2", False, "EARLY_MARKET_ENGAGEMENT"),
    ("planning", "Roads", "soft market test", None, False, "EARLY_MARKET_ENGAGEMENT"), ("planning", "Roads", "x", None, True, "PIPELINE"), ("tender", "Roads", "rfi", None, True, "FRAMEWORK"),
    ("tender", "Roads", "word " * 400 + "request for proposal", None, False, "RFP"), ("tender", "Roads", None, None, None, "LIVE_TENDER"), (None, "Roads", "rfi", None, False, "RFI"),
], lambda df: [normalise.kind_of(c("s"), c("t"), c("x"), c("n"), c("f"))])

cases("documents_once", "d array<struct<url:string,title:string>>", {"urls": "VARCHAR"}, [
    ([("a", "1"), ("b", "2"), ("a", "3"), (None, "4"), ("", "5")], "a1|b2"), ([], ""), (None, None),
], lambda df: [listed(F.transform(normalise.first_documents(c("d")), lambda x: F.concat(x["url"], x["title"])))])

cases("links_permitted", "u string", {"ok": "BOOLEAN", "numbers": "VARCHAR"}, [
    ("https://a.gov/x 0012-2024", True, "12-2024"), ("https://b.a.gov?x=7/2023,007-2023", True, "7-2023"), ("http://a.gov/x", False, ""), ("https://u@a.gov/", False, ""), ("https://evila.gov/", False, ""), (None, False, None),
], lambda df: [tiers.permitted_url(F.split_part(c("u"), F.lit(" "), F.lit(1)), ["a.gov"]), listed(tiers.control_numbers(c("u")))])

cases("terms_shared", "a array<string>, b array<string>", {"terms": "VARCHAR"}, [
    (["x", "y", "z", "w"], ["w", "z", "y", "x"], "z|y|x"), (["x"], ["q"], ""), ([], [], ""),
], lambda df: [listed(tiers.shared_terms(c("a"), c("b"), F.create_map(*[F.lit(v) for v in ("x", 1.0, "y", 2.0, "z", 3.0, "w", 0.5)])))])


def _releases() -> list[tuple[str, ...]]:
    base = {
        "ocid": "o1", "id": "r1", "date": "2026-01-02", "tag": ["tender"], "buyer": {"name": " City  of X "},
        "tender": {"id": "t1", "title": "Request for information: roads", "description": "Works.", "status": "active", "value": {"amount": 10.5, "currency": "GBP"}, "lots": [{"id": "1", "title": "A"}, {"id": "2"}]},
    }
    award = base | {"id": "r2", "tag": ["award"], "awards": [{"id": "a", "status": "active", "date": "2026-03-01", "value": {"amount": 9}, "suppliers": [{"name": "S"}], "relatedLots": ["2"]}]}
    gone = base | {"id": "r4", "tag": ["tenderCancellation"]}
    return [(json.dumps(r), *w) for r, w in (
        (base, ("tender", "RFI", "active", "1|2", 10.5, "City of X")), (award, ("award", "AWARD", "active", "2", 9.0, "City of X")), (gone, ("tender", "RFI", "cancelled", "1|2", 10.5, "City of X")),
    )]


_RELEASES = _releases()


def _normalised(name: str, kind: str, columns: dict[str, str], rows: list[tuple], made: list[str], doc: str) -> None:
    """Registers a query that normalises one raw row for each order; a row's URL or number tells which case it is."""

    def run(spark, d):
        n = len(rows)
        raw = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "case_ int, payload " + ("string" if kind in normalise.TEXT_KINDS else "map<string,string>"))
        ids = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.pmod("o_orderkey", F.lit(n)).cast("int").alias("case_"))
        feed = ids.join(F.broadcast(raw), "case_").select(F.col("id").cast("string").alias("source"), F.lit("2026-01-03").alias("retrieved_at"), F.lit(kind).alias("kind"), "payload")
        out = normalise.NORMALISERS[kind](feed) if kind in normalise.TEXT_KINDS else normalise.normalised(feed, {kind: normalise.NORMALISERS[kind]})
        return out.select(F.col("source").cast("long").alias("id"), *[F.expr(e).alias(a) for e, a in zip(made, columns, strict=True)])

    run.__doc__ = doc
    values = ", ".join("(" + ", ".join([str(i), *[_literal(v, t) for v, t in zip(r[1:], columns.values(), strict=True)]]) + ")" for i, r in enumerate(rows))
    QUERIES[name] = run
    SQL[name] = f"SELECT o_orderkey AS id, v.* EXCLUDE (case_) FROM orders JOIN (VALUES {values}) AS v(case_, {', '.join(columns)}) ON o_orderkey % {len(rows)} = case_"


_KIND = {"kind": "VARCHAR", "stage": "VARCHAR", "status": "VARCHAR"}
_KIND_MADE = ["signal_type", "stage", "status"]

_normalised("normal_releases", "ocds", {"stage": "VARCHAR", "kind": "VARCHAR", "status": "VARCHAR", "lots": "VARCHAR", "most": "DOUBLE", "buyer": "VARCHAR"}, _RELEASES,
            ["stage", "signal_type", "status", "array_join(lot_ids, '|')", "value_max", "buyer_name"], "Open contracting releases: a tender, an award of a lot, a cancellation.")

_normalised("normal_federal", "federal_opportunities", {**_KIND, "most": "DOUBLE", "due": "VARCHAR"}, [
    ({"NoticeId": "a", "Title": "T", "Type": "Award Notice", "Active": "Yes", "Award$": "$1,234.50"}, "AWARD", "award", "awarded", 1234.5, None),
    ({"NoticeId": "d", "Title": "U", "Type": "Modification/Amendment/Cancel", "BaseType": "Sources Sought", "ResponseDeadLine": "2026-05-01", "Active": "No"}, "RFI", "planning", "closed", None, "2026-05-01"),
], [*_KIND_MADE, "value_max", "get(deadlines, 0).value"], "Federal opportunities.")

_U = "01234567-89ab-cdef-0123-456789abcde"
_EXPORT = json.loads(_RELEASES[0][0])
_normalised("normal_german_export", "ocds_with_gazette_ids", {"ids": "VARCHAR", "kind": "VARCHAR"}, [
    (json.dumps(_EXPORT | {"notice_id": f"{_U}f", "previous_notice_ids": [f"{_U}0", "x"]}), f"gazette-notice:{_U}f|gazette-notice:{_U}0", "RFI"), (json.dumps(_EXPORT | {"notice_id": "none"}), "", "RFI"),
], ["array_join(slice(external_ids, 2, 9), '|')", "signal_type"], "Releases of an exporter that names notices of the gazette.")

_GAZETTE = {"publication-number": "123-2026", "title-proc": {"fra": "Pont", "eng": ["Bridge", "two"]}, "description-proc": "Text", "buyer-name": {"fra": ["Ville"]}, "publication-date": "2026-01-02+01:00",
            "classification-cpv": ["45000000", "45233000"], "identifier-lot": ["LOT-1", "LOT-1"], "estimated-value-proc": "12.5", "estimated-value-cur-proc": ["EUR", "EUR"]}
_normalised("normal_gazette", "gazette", {**_KIND, "title": "VARCHAR", "due": "VARCHAR", "most": "DOUBLE", "currency": "VARCHAR", "codes": "VARCHAR"}, [
    (json.dumps(_GAZETTE | {"form-type": "competition", "deadline-receipt-tender-date-lot": ["2026-05-01+02:00"], "deadline-receipt-tender-time-lot": ["12:00:00+02:00"]}),
     "LIVE_TENDER", "tender", "active", "Bridge; two", "tender 2026-05-01T12:00:00+02:00", 12.5, "EUR", "45000000|45233000"),
    (json.dumps(_GAZETTE | {"form-type": "competition", "framework-agreement-lot": ["fa-mix"], "deadline-receipt-request-date-lot": ["2026-04-01", "2026-04-02"], "deadline-receipt-request-time-lot": ["10:00"], "deadline-receipt-tender-date-lot": "2026-05-01"}),
     "FRAMEWORK", "tender", "active", "Bridge; two", "application 2026-04-01|application 2026-04-02|invited_submission 2026-05-01", 12.5, "EUR", "45000000|45233000"),
    (json.dumps(_GAZETTE | {"form-type": "result", "notice-type": "veat", "total-value": 7, "total-value-cur": ["EUR", "USD"]}), "AWARD", "award", "closed", "Bridge; two", "", 7.0, None, "45000000|45233000"),
    (json.dumps(_GAZETTE | {"title-proc": {"deu": "Brücke"}, "form-type": "other", "competition-termination-proc": True}), "STRATEGIC_INTENT", "unknown", "cancelled", "Brücke", "", 12.5, "EUR", "45000000|45233000"),
], [*_KIND_MADE, "title", "array_join(transform(deadlines, d -> concat_ws(' ', d.kind, d.value)), '|')", "value_max", "currency", "array_join(codes, '|')"], "Notices of the European gazette, in several languages.")

_CITY = lambda notice, method="", title="t": {"request_id": "1", "section_name": "Procurement", "type_of_notice_description": notice, "selection_method_description": method, "short_title": title}
_normalised("normal_city_record", "city_record", _KIND, [
    (_CITY("Solicitation", "Request for Proposals"), "RFP", "tender", "active"), (_CITY("Award"), "AWARD", "award", "awarded"), (_CITY("Solicitation", title="Withdrawn: x"), "LIVE_TENDER", "tender", "cancelled"),
    (_CITY("Solicitation", "Sole Source"), "LIVE_TENDER", "tender", "closed"),
], _KIND_MADE, "Notices of a city's record.")

_BID = lambda kind, stage, **more: {"rampid": "1", "type": kind, "stagename": stage, "title": "t", "url": "https://x/1", **more}
_normalised("normal_regional_bids", "regional_bids", _KIND, [
    (_BID("RFP", "Open"), "RFP", "tender", "active"), (_BID("TOS", "Open"), "LIVE_TENDER", "tender", "restricted"), (_BID("RFI", "Closed"), "RFI", "planning", "closed"), (_BID("IFB", "?"), "LIVE_TENDER", "tender", "unverified"),
    (_BID("IFB", "Open", catalogue_removed="1"), "LIVE_TENDER", "tender", "not_listed"),
], _KIND_MADE, "Bids of a city's portal.")

_C = normalise.CANADA
_normalised("normal_canada_tenders", "canada_tenders", {**_KIND, "title": "VARCHAR", "due": "VARCHAR"}, [
    ({_C["reference"]: "S-22:T", f"{_C['title']}-fra": "Pont", f"{_C['title']}-eng": "Bridge", f"{_C['tender_text']}-fra": "Texte", f"{_C['tender_status']}-eng": "Open", _C["closing"]: "2026-07-01T14:00:00",
      f"{_C['notice']}-eng": "Request for Proposal", _C["published"]: "2026-06-01"}, "RFP", "tender", "active", "Pont", "2026-07-01T14:00:00-05:00"),
], [*_KIND_MADE, "title", "get(deadlines, 0).value"], "Canadian tenders in two languages.")

_normalised("normal_grants", "grants", {"status": "VARCHAR", "least": "DOUBLE", "due": "VARCHAR"}, [
    ({"id": "12", "title": "G", "status": "archived", "closeDate": "2026-09-01", "awardFloor": "1"}, "complete", 1.0, "2026-09-01"),
], ["status", "value_min", "get(deadlines, 0).value"], "Grants.")

_normalised("normal_federal_awards", "federal_awards", {"title": "VARCHAR", "most": "DOUBLE", "status": "VARCHAR"}, [
    ({"generated_internal_id": "A_1", "Award Amount": "5", "Recipient Name": "S"}, "Contract award A_1", 5.0, "awarded"),
], ["title", "value_max", "status"], "Federal awards.")


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


@_query("""
SELECT o_orderkey AS id, o_orderkey % 3 = 1 AS included, CASE WHEN o_orderkey % 3 IN (0, 1) AND o_orderkey % 5 > 0 THEN 'note' END AS guidance FROM orders WHERE NOT (o_orderkey % 3 = 0 AND o_orderkey % 5 > 0)
""".replace("o_orderkey % 3 = 1 AS included", "CASE WHEN o_orderkey % 3 = 1 AND o_orderkey % 5 > 0 THEN true END AS included"))
def reviewed_notices(spark, d):
    """People's decisions on two of three notices; those on every fifth were about an older text, and are void."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.sha2("o_orderpriority", 256).alias("source_hash"))
    hash_ = F.when(F.col("id") % 5 == 0, "old").otherwise(F.col("source_hash"))
    ledger = orders.where("id % 3 < 2").select("id", hash_.alias("source_hash"), F.when(F.col("id") % 3 == 0, "exclude").otherwise("include").alias("decision"), F.lit("note").alias("note"))
    return reviews.reviewed(orders, ledger).select("id", "included", "guidance")


@_query("SELECT o_orderkey || ':renewal' AS id, date_diff('day', DATE '2000-06-01', o_orderdate::DATE) AS days_left FROM orders WHERE date_diff('day', DATE '2000-06-01', o_orderdate::DATE) BETWEEN 0 AND 365")
def renewals(spark, d):
    """Contracts that end within a year, as inferred notices."""
    rows = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.lit("t").alias("title"), F.lit("b").alias("buyer_name"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("contract_end"))
    return reviews.renewals(rows, F.lit("2000-06-01")).select("id", F.col("days_left").cast("long").alias("days_left"))


@_query("SELECT o_orderkey FROM orders WHERE o_orderdate < DATE '1999-01-01' AND o_totalprice < 200000 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def disposable_records(spark, d):
    """Old and small notices of buyers without an urgent one."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority")
    old = [F.col("o_orderdate") < F.lit("1999-01-01").cast("date"), F.col("o_totalprice") < 200000]
    return reviews.disposable(orders, old, orders.where("o_orderpriority = '1-URGENT'"), "o_custkey").select("o_orderkey")


_VOCABULARY = [
    Capability("crm", "platform", explicit=("crm",), needs=("case handling",)), Capability("bot", "ai", contextual=("assistant",), context=("ai",)),
    Capability("link", "external_integration", needs=("interface",)),
]
_SCORED = [
    ("New CRM", "An AI assistant answers. Case handling too.", ["48000000"], 76, True, "platform", "bot,crm", 3), ("Roads", "No CRM is wanted.", [], 0, False, "other", "", 0),
    ("Assistant", "x", ["48000000"], 12, True, "other", "", 0), ("Case handling", None, None, 44, True, "platform", "crm", 1), ("AI assistant", "", [], 16, True, "other", "bot", 1),
    ("An interface", "", [], 10, False, "other", "link", 1), ("An interface", "", ["48100000"], 56, True, "other", "link", 1),
]


@_query("SELECT o_orderkey AS id, v.* EXCLUDE (case_) FROM orders JOIN (VALUES " + ", ".join(
    f"({i}, {r[3]}, {str(r[4]).lower()}, '{r[5]}', '{r[6]}', {r[7]})" for i, r in enumerate(_SCORED)
) + f") AS v(case_, score, candidate, priority, capabilities, quotes) ON o_orderkey % {len(_SCORED)} = case_")
def capability_cases(spark, d):
    """Scores of notices by evidence: in the title, by needs, in context, by code, negated, and of weak families alone."""
    listed_ = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(_SCORED)], "case_ int, title string, description string, codes array<string>")
    ids = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.pmod("o_orderkey", F.lit(len(_SCORED))).cast("int").alias("case_"))
    out = prefiltered(ids.join(F.broadcast(listed_), "case_"), _VOCABULARY, ("48",))
    return out.select("id", "score", "candidate", "priority", F.array_join("capabilities", ",").alias("capabilities"), F.size("evidence").alias("quotes"))


@_query("SELECT page_id, CASE WHEN contains(html, '<article>') THEN 1 ELSE 0 END::BIGINT AS articles, 0::BIGINT AS tags, 0::BIGINT AS scripts FROM pages")
def pages_cleaned(spark, d):
    """Whole pages as visible text: no tags of the pages' own kinds and no scripts are left, and the article's are counted."""
    pages = table(spark, d, "pages")
    text = tx.clean(c("html"))
    return pages.select("page_id", "html", text.alias("text")).select(
        "page_id", F.when(c("html").contains("<article>"), 1).otherwise(0).cast("long").alias("articles"),
        F.regexp_count("text", F.lit("</?(?:p|b|div|li|ul|article|h1|nav)>")).cast("long").alias("tags"), F.regexp_count("text", F.lit(r"track\(0\);|margin:0")).cast("long").alias("scripts"),
    )
