"""Nested XML by schema: lots with deadlines of their own, feeds, and what is held back."""

import pytest
from pyspark.sql import functions as F

from bidstream.sources import notices_xml as nx

ID = "0a1b2c3d-0000-4000-8000-00000000000f"
LOTS = """<cac:ProcurementProjectLot><cbc:ID schemeName="Lot">LOT-0001</cbc:ID><cac:ProcurementProject><cbc:Name languageID="DEU">Los A</cbc:Name></cac:ProcurementProject><cac:TenderingProcess>
<cac:TenderSubmissionDeadlinePeriod><cbc:EndDate>2026-05-02+02:00</cbc:EndDate><cbc:EndTime>10:00:00+02:00</cbc:EndTime></cac:TenderSubmissionDeadlinePeriod>
<cac:ParticipationRequestReceptionPeriod><cbc:EndDate>2026-04-01</cbc:EndDate></cac:ParticipationRequestReceptionPeriod>
<cac:ContractingSystem><cbc:ContractingSystemTypeCode listName="dps-usage">none</cbc:ContractingSystemTypeCode></cac:ContractingSystem>
<cac:ContractingSystem><cbc:ContractingSystemTypeCode listName="framework-agreement">fa-w-rc</cbc:ContractingSystemTypeCode></cac:ContractingSystem></cac:TenderingProcess></cac:ProcurementProjectLot>
<cac:ProcurementProjectLot><cbc:ID>LOT-0002</cbc:ID><cac:TenderingProcess><cac:TenderSubmissionDeadlinePeriod><cbc:EndDate>2026-03-01Z</cbc:EndDate><cbc:EndTime>bad</cbc:EndTime></cac:TenderSubmissionDeadlinePeriod></cac:TenderingProcess></cac:ProcurementProjectLot>"""


def eforms(body=LOTS, root="ContractNotice", ident=ID, head=""):
    earlier = f"<cac:NoticeDocumentReference><cbc:ID>{ID}-02</cbc:ID></cac:NoticeDocumentReference>"
    return f'{head}<n:{root} xmlns:n="urn:n" xmlns:cac="urn:a" xmlns:cbc="urn:b"><cbc:ID>{ident}</cbc:ID><cbc:VersionID>01</cbc:VersionID><cbc:NoticeTypeCode>cn-standard</cbc:NoticeTypeCode>{earlier}{body}</n:{root}>'


def test_lots_have_deadlines_of_their_own(spark):
    files = [(f"{ID}-01", eforms()), (f"{ID}-01", eforms("")), ("5-01", eforms(root="ContractAwardNotice", ident="5", head="<?xml version='1.0'?><!-- x -->"))]
    rows = nx.eforms(spark.createDataFrame(files, "stem string, xml string")).collect()
    assert [r["fault"] for r in rows] == [None] * 3 and [r["result"] for r in rows] == [False, False, True]
    assert [tuple(x) for x in rows[0]["lots"]] == [("LOT-0001", "Los A", None, "2026-04-01", True), ("LOT-0002", None, None, None, False)]
    assert rows[0]["deadline"] == "2026-04-01" and rows[0]["earlier"] == [ID] and rows[1]["lots"] == [] and rows[1]["deadline"] is None


def test_what_cannot_be_read_is_held_back(spark):
    files = [
        ("x", None), ("x", " "), (f"{ID}-01", eforms()[:-9]), (f"{ID}-01", eforms(head="<!DOCTYPE a>")), (f"{ID}-01", eforms(root="Invoice")), (f"{ID}-02", eforms()), ("x-01", eforms(ident="x")), ("a", "no markup"),
        (f"{ID}-01", eforms(head='<!doctype a [<!ENTITY b "c">]>')),
    ]
    rows = nx.eforms(spark.createDataFrame(files, "stem string, xml string"))
    assert [r["fault"] for r in rows.collect()] == ["empty", "empty", "malformed", "unsafe", "another document", "another notice", "another notice", "another document", "unsafe"]
    assert nx.eforms_lots(rows).count() == 0 and rows.where("notice_id is not null or lots is not null").count() == 0


def test_releases_take_the_facts_of_their_notices(spark):
    releases = spark.createDataFrame([(ID, [("LOT-0001", None), ("LOT-0009", "own")], ["tender"]), ("other", [], ["planning"])], "release_id string, lots array<struct<id: string, title: string>>, tags array<string>")
    notices = nx.eforms(spark.createDataFrame([(f"{ID}-01", eforms(root="ContractAwardNotice"))], "stem string, xml string"))
    rows = {r["release_id"]: r for r in nx.enriched(releases, notices).collect()}
    assert [tuple(x) for x in rows[ID]["lots"]] == [("LOT-0001", "Los A", "2026-04-01"), ("LOT-0009", "own", None)] and rows[ID]["tags"] == ["award"]
    assert rows["other"]["tags"] == ["planning"] and rows["other"]["deadline"] is None


def entry(n, updated, state="PUB", name="Servicio", process="", extra="", host="portal.example"):
    return (
        f'<entry><id>https://feed.example/{n}</id><updated>{updated}</updated><link rel="self" href="https://self.example/"/><link href="https://{host}/{n}"/><x:ContractFolderStatus><c:ContractFolderStatusCode listURI="u">{state}</c:ContractFolderStatusCode>'
        f"<x:ProcurementProject><c:Name>{name}</c:Name></x:ProcurementProject><x:TenderingProcess>{process}</x:TenderingProcess>{extra}</x:ContractFolderStatus></entry>"
    )


def page(*parts, updated="2026-02-01T00:00:00Z"):
    return f'<feed xmlns="urn:atom" xmlns:x="urn:x" xmlns:c="urn:c"><updated>{updated}</updated>{"".join(parts)}</feed>'


def test_entries_of_a_feed(spark):
    result = "<x:TenderResult><c:ResultCode>8</c:ResultCode><x:WinningParty><x:PartyName><c:Name>Acme</c:Name></x:PartyName></x:WinningParty></x:TenderResult>"
    due = "<x:TenderSubmissionDeadlinePeriod><c:EndDate>2026-03-01</c:EndDate><c:EndTime>14:00:00</c:EndTime><c:Description>Hora peninsular</c:Description></x:TenderSubmissionDeadlinePeriod>"
    parts = [
        '<d:deleted-entry xmlns:d="urn:d" ref="https://feed.example/9" when="2026-01-01T00:00:00Z"/>', entry(1, "2026-01-30T10:00:00+01:00", process=due), entry(2, "2026-01-30T09:00:00Z", "ADJ", extra=result),
        entry(3, "2026-01-29T09:00:00Z", "PUB", extra=result), entry(4, "2026-01-28T09:00:00Z", process="<c:ProcedureCode>3</c:ProcedureCode>"), entry(5, "2026-01-27T09:00:00Z", "PRE", process="<c:ContractingSystemCode>1</c:ContractingSystemCode>"),
        entry(6, "2026-01-26T09:00:00Z", process="<c:ContractingSystemCode>2</c:ContractingSystemCode>"),
    ]
    facts = nx.codice_facts(nx.codice_entries(spark.createDataFrame([(page(*parts),)], "xml string"), hosts=("portal.example",)))
    rows = {r["entry"]: r for r in facts.collect()}
    assert {k: (r["status"], r["kind"]) for k, r in rows.items()} == {
        "1": ("active", "LIVE_TENDER"), "2": ("awarded", "AWARD"), "3": ("closed", "LIVE_TENDER"), "4": ("closed", "LIVE_TENDER"), "5": ("published", "PIPELINE"), "6": ("active", "FRAMEWORK"), "9": ("withdrawn", "LIVE_TENDER")}
    assert rows["2"]["suppliers"] == ["Acme"] and rows["1"]["url"] == "https://portal.example/1" and rows["9"]["title"] == "Withdrawn notice 9"
    assert rows["1"]["deadline"] == "2026-03-01" and "2026-03-01 14:00:00. Time zone not supplied" in rows["1"]["description"] and rows["1"]["description"].endswith("Hora peninsular")


def test_pages_that_are_not_whole(spark):
    good = entry(1, "2026-01-30T10:00:00Z")
    pages = {
        "newest": page(good, entry(2, "2026-01-31T10:00:00Z")), "late": page(good, updated="2026-01-01T00:00:00Z"), "none": page(good, updated="soon"), "state": page(entry(1, "2026-01-30T10:00:00Z", "XXX")),
        "name": page(entry(1, "2026-01-30T10:00:00Z", name="")), "host": page(entry(1, "2026-01-30T10:00:00Z", host="evil.example")), "next": page('<link rel="next" href="a"/><link rel="next" href="b"/>', good), "empty": page(),
    }
    rows = nx.codice_entries(spark.createDataFrame(list(pages.items()), "name string, xml string"), hosts=("portal.example",)).select("name", "fault", F.col("entry").isNull().alias("none")).collect()
    assert {r["name"]: r["fault"] for r in rows} == {
        "newest": "not newest first", "late": "newer than its page", "none": "no time", "state": "incomplete entry", "name": "incomplete entry", "host": "incomplete entry", "next": "several next pages", "empty": None}
    assert all(r["none"] for r in rows)


@pytest.mark.parametrize("name", ["codice_facts", "codice_lots", "codice_faults", "eforms_lots", "eforms_faults"])
def test_a_document_is_parsed_once(spark, tmp_path, name):
    from bidstream.plans import catalog

    line = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    spark.createDataFrame([], line).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    plan = catalog.queries()[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_xml(") == 1
