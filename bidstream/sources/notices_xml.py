"""Notices in nested XML, by declared schemas: a row for each notice, or for each of its lots.

Spark parses with the schema, so elements that may repeat are arrays from the start, attributes and values are fields, and prefixes
of namespaces don't matter. What cannot be read, declares entities, or is another kind of document gives its fault and nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidstream.functions.dates import xml_deadline

OPTIONS = {"ignoreNamespace": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "fault_", "ignoreSurroundingSpaces": "true"}
#: Declarations that could make a parser read other files; no notice needs any.
UNSAFE = r"(?i)<!\s*(?:DOCTYPE|ENTITY)\b"
_ROOT = r"(?s)^\s*(?:<\?xml.*?\?>)?\s*(?:<!--.*?-->\s*)*<(?:[\w.-]+:)?([\w.-]+)"

_PERIOD = "array<struct<EndDate: string, EndTime: string>>"
#: Notices in eForms; elements that are not named are passed over.
EFORMS = f"""ID string, VersionID string, NoticeTypeCode string, NoticeDocumentReference array<struct<ID: string>>,
ProcurementProject struct<ID: string, Name: string, Description: string>,
ProcurementProjectLot array<struct<ID: string, ProcurementProject: struct<Name: string, Description: string>, TenderingProcess: struct<
  TenderSubmissionDeadlinePeriod: {_PERIOD}, ParticipationRequestReceptionPeriod: {_PERIOD},
  ContractingSystem: array<struct<ContractingSystemTypeCode: struct<_VALUE: string, _listName: string>>>>>>, fault_ string"""
EFORMS_ROOTS = ("ContractNotice", "ContractAwardNotice", "PriorInformationNotice")
#: Framework techniques of eForms; fixed.
FRAMEWORKS = ("fa-mix", "fa-w-rc", "fa-wo-rc")

_AMOUNT = "struct<_VALUE: string, _currencyID: string>"
_CODES = "array<struct<ItemClassificationCode: string>>"
_PAPERS = "array<struct<ID: string, Attachment: struct<ExternalReference: struct<URI: string>>>>"
#: Pages of an Atom feed whose entries hold a contract folder, and marks of entries that were withdrawn.
CODICE = f"""updated string, link array<struct<_href: string, _rel: string>>, `deleted-entry` array<struct<_ref: string, _when: string>>,
entry array<struct<id: string, updated: string, link: array<struct<_href: string, _rel: string>>, ContractFolderStatus: struct<
  ContractFolderID: string, ContractFolderStatusCode: string,
  LocatedContractingParty: struct<Party: struct<PartyName: struct<Name: string>, PartyIdentification: array<struct<ID: string>>>>,
  ProcurementProject: struct<Name: string, Description: string, RequiredCommodityClassification: {_CODES}, RealizedLocation: array<struct<CountrySubentity: string>>,
    BudgetAmount: struct<EstimatedOverallContractAmount: {_AMOUNT}, TaxExclusiveAmount: {_AMOUNT}, TotalAmount: {_AMOUNT}>>,
  ProcurementProjectLot: array<struct<ID: string, ProcurementProject: struct<Name: string, Description: string, RequiredCommodityClassification: {_CODES}>>>,
  TenderingProcess: struct<ProcedureCode: string, ContractingSystemCode: string, TenderSubmissionDeadlinePeriod: struct<EndDate: string, EndTime: string, Description: string>>,
  TenderResult: array<struct<ResultCode: string, WinningParty: array<struct<PartyName: struct<Name: string>>>>>,
  ValidNoticeInfo: array<struct<AdditionalPublicationStatus: array<struct<AdditionalPublicationDocumentReference: array<struct<IssueDate: string>>>>>>,
  LegalDocumentReference: {_PAPERS}, TechnicalDocumentReference: {_PAPERS}>>>, fault_ string"""


def parsed(df: DataFrame, xml: str, schema: str, roots: tuple[str, ...]) -> DataFrame:
    """`df` with x, the document, root, the name of its outermost element, and fault: empty, unsafe, another document, malformed or null."""
    text = F.coalesce(F.col(xml), F.lit(""))
    root = F.regexp_extract(text, _ROOT, 1)
    early = F.when(F.trim(text) == "", "empty").when(text.rlike(UNSAFE), "unsafe").when(~root.isin(*roots), "another document")
    out = df.withColumn("root", root).withColumn("early_", early)
    # a generator of one row: what filters on x above it isn't pushed under it, where a document would be parsed again for each mention of x
    out = out.withColumn("x", F.explode_outer(F.array(F.from_xml(F.when(F.col("early_").isNull(), F.col(xml)), schema, OPTIONS))))
    fault = F.coalesce("early_", F.when(F.col("x").isNull() | F.col("x.fault_").isNotNull(), "malformed"))
    return out.withColumn("fault", fault).drop("early_")


def some(array: Column, kind: str) -> Column:
    """An array without nulls, empty where there is none."""
    return F.filter(F.coalesce(array, F.array().cast(kind)), lambda x: x.isNotNull())


def earliest(deadlines: Column) -> Column:
    """Of days and times as `xml_deadline` gives them the one that comes first, a day at its start in UTC; null of none."""
    at = lambda d: F.concat(d, F.when(d.contains("T"), F.lit("")).otherwise(F.lit("T00:00:00Z"))).try_cast("timestamp")
    return F.array_min(F.transform(F.filter(deadlines, lambda d: d.isNotNull()), lambda d: F.struct(at(d).alias("at"), d.alias("text"))))["text"]


def _lot(lot: Column) -> Column:
    process = lot["TenderingProcess"]
    periods = F.concat(*[some(process[p], _PERIOD) for p in ("TenderSubmissionDeadlinePeriod", "ParticipationRequestReceptionPeriod")])
    systems = some(process["ContractingSystem"], "array<struct<ContractingSystemTypeCode: struct<_VALUE: string, _listName: string>>>")
    framework = F.exists(systems, lambda s: F.coalesce(
        (s["ContractingSystemTypeCode"]["_listName"] == "framework-agreement") & s["ContractingSystemTypeCode"]["_VALUE"].isin(*FRAMEWORKS), F.lit(False)))
    return F.struct(
        lot["ID"].alias("lot_id"), lot["ProcurementProject"]["Name"].alias("title"), lot["ProcurementProject"]["Description"].alias("description"),
        earliest(F.transform(periods, lambda p: xml_deadline(p["EndDate"], p["EndTime"]))).alias("deadline"), framework.alias("framework"),
    )


def eforms(files: DataFrame, xml: str = "xml", stem: str | None = "stem") -> DataFrame:
    """`files` with notice_id, version, notice_type, reference, earlier (ids of notices it replaces), result, lots and deadline, or a fault.

    A lot (lot_id, title, description, deadline, framework) has the earliest of its own deadlines, the notice that of its lots. stem: the column
    with the file's name, which has to be the notice's id and version.
    """
    rows = parsed(files, xml, EFORMS, EFORMS_ROOTS)
    x = lambda path: F.col(f"x.{path}")
    named = x("ID").rlike(r"^(?:[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|\d{1,16})$")
    if stem:
        named = named & (F.concat_ws("-", x("ID"), x("VersionID")) == F.col(stem))
    rows = rows.withColumn("fault", F.coalesce("fault", F.when(~F.coalesce(named, F.lit(False)), "another notice")))
    lots = F.transform(F.filter(F.coalesce(x("ProcurementProjectLot"), F.array()), lambda lot: lot.isNotNull()), _lot)
    rows = rows.withColumn("lots", F.when(F.col("fault").isNull(), lots))
    good = lambda c: F.when(F.col("fault").isNull(), c)
    earlier = F.array_distinct(F.transform(some(x("NoticeDocumentReference"), "array<struct<ID: string>>"), lambda r: F.regexp_extract(r["ID"], r"^([0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})", 1)))
    return rows.select(
        *files.columns, good(x("ID")).alias("notice_id"), good(x("VersionID")).alias("version"), good(x("NoticeTypeCode")).alias("notice_type"),
        good(x("ProcurementProject.ID")).alias("reference"), good(F.filter(earlier, lambda e: e != "")).alias("earlier"),
        good((F.col("root") == "ContractAwardNotice") | F.coalesce(x("NoticeTypeCode") == "dir-awa-pre", F.lit(False))).alias("result"), "lots",
        earliest(F.transform("lots", lambda lot: lot["deadline"])).alias("deadline"), "fault",
    )


def eforms_lots(notices: DataFrame) -> DataFrame:
    """A row for each lot of what `eforms` gives: notice_id, version, lot_id, title, description, deadline, framework."""
    return notices.where("fault is null").select("notice_id", "version", F.explode("lots").alias("lot")).select("notice_id", "version", "lot.*")


def enriched(releases: DataFrame, notices: DataFrame) -> DataFrame:
    """Releases (release_id, lots: array of (id, title), tags ..) with the facts of their eForms notices; what has no notice is as it was.

    A lot gets its notice's deadline; the release gets the earliest, the notice's reference, the earlier notices, and award as its only
    tag where the notice is one of a result.
    """
    facts = notices.where("fault is null").select(
        F.col("notice_id").alias("release_id"), F.col("lots").alias("lots_"), F.col("deadline").alias("deadline"), "reference", "earlier", "result", "version",
    )
    own = lambda lot: F.get(F.filter("lots_", lambda x: x["lot_id"] == lot["id"]), 0)
    lots = F.transform("lots", lambda lot: F.struct(lot["id"].alias("id"), F.coalesce(lot["title"], own(lot)["title"]).alias("title"), own(lot)["deadline"].alias("deadline")))
    out = releases.join(facts, "release_id", "left").withColumn("lots", lots)
    return out.withColumn("tags", F.when(F.col("result"), F.array(F.lit("award"))).otherwise(F.col("tags"))).drop("lots_", "result")


def codice_entries(pages: DataFrame, xml: str = "xml", hosts: tuple[str, ...] = ()) -> DataFrame:
    """`pages` exploded to their entries: entry, an id of digits, state, updated, url and the folder; withdrawn ones have the state WITHDRAWN. Or a fault of the whole page.

    A page is at fault if it is not newest first, if an entry has no known state, time, title or link to one of `hosts`, or is newer than the page, or
    if it links to more than one next page: its other entries would not be complete either.
    """
    rows = parsed(pages, xml, CODICE, ("feed",))
    entries = F.coalesce(F.col("x.entry"), F.array())
    host = lambda url: F.regexp_extract(url, r"^https://([^/?#:@]+)", 1)

    def link(e: Column) -> Column:
        official = F.filter(F.coalesce(e["link"], F.array()), lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
        urls = F.transform(official, lambda x: x["_href"])
        return F.get(F.filter(urls, lambda u: host(u).isin(*hosts)) if hosts else urls, 0)

    at = lambda e: e["updated"].try_cast("timestamp")
    times = F.transform(entries, at)
    whole = lambda e: (
        at(e).isNotNull() & e["ContractFolderStatus"]["ContractFolderStatusCode"].isin(*[s for s in STATES if s != "WITHDRAWN"])
        & (F.coalesce(e["ContractFolderStatus"]["ProcurementProject"]["Name"], F.lit("")) != "") & link(e).isNotNull() & e["id"].rlike(r"\d+$")
    )
    page_time = F.col("x.updated").try_cast("timestamp")
    fault = (
        F.when(page_time.isNull(), "no time").when(F.size(F.filter(F.coalesce("x.link", F.array()), lambda x: x["_rel"] == "next")) > 1, "several next pages")
        .when(F.exists(entries, lambda e: ~F.coalesce(whole(e), F.lit(False))), "incomplete entry").when(F.reverse(F.array_sort(times)) != times, "not newest first")
        .when(F.coalesce(F.array_max(times) > page_time, F.lit(False)), "newer than its page")
    )
    rows = rows.withColumn("fault", F.coalesce("fault", fault))
    number = lambda c: F.regexp_extract(c, r"(\d{1,20})$", 1)
    some_ = F.transform(entries, lambda e: F.struct(
        number(e["id"]).alias("entry"), e["ContractFolderStatus"]["ContractFolderStatusCode"].alias("state"), e["updated"].alias("updated"), link(e).alias("url"), e["ContractFolderStatus"].alias("folder")))
    gone = F.transform(F.coalesce(F.col("x.`deleted-entry`"), F.array()), lambda d: F.struct(
        number(d["_ref"]).alias("entry"), F.lit("WITHDRAWN").alias("state"), d["_when"].alias("updated"), d["_ref"].alias("url"), F.lit(None).alias("folder")))
    kind = F.when(F.col("fault").isNull(), F.concat(some_, gone))
    return rows.select(*pages.columns, "fault", F.explode_outer(kind).alias("e")).select(*pages.columns, "fault", "e.*")


#: States of a contract folder, and the status that each says; fixed values of the schema.
STATES = {"PRE": "published", "PUB": "active", "EV": "closed", "ADJ": "awarded", "RES": "closed", "ANUL": "cancelled", "WITHDRAWN": "withdrawn"}
#: Procedures without a call for competition, and systems by which a call-off or a framework is let; fixed values of the schema.
DIRECT, CALL_OFFS, FRAMEWORK_SYSTEMS = ("3", "6", "7", "11", "12"), ("3", "4"), ("1", "2")


def codice_facts(entries: DataFrame) -> DataFrame:
    """The facts of entries: title, description, buyer, amount, codes, lots and so on, with the status that may be shown.

    Where results are out, or there is no call for competition, a folder that says it is open counts as closed. A deadline without a zone is told in the
    description, in the publisher's own words.
    """
    f = lambda path: F.col(f"folder.{path}")
    budget = [f(f"ProcurementProject.BudgetAmount.{n}") for n in ("EstimatedOverallContractAmount", "TaxExclusiveAmount", "TotalAmount")]
    amount = F.coalesce(*[F.when(b["_VALUE"].try_cast("double") >= 0, b) for b in budget])
    codes = lambda c: F.transform(some(c, _CODES), lambda x: x["ItemClassificationCode"])
    lots = F.filter(F.coalesce(f("ProcurementProjectLot"), F.array()), lambda x: x.isNotNull())
    results = F.coalesce(f("TenderResult"), F.array())
    winners = F.flatten(F.transform(results, lambda r: F.transform(F.coalesce(r["WinningParty"], F.array()), lambda w: w["PartyName"]["Name"])))
    published = F.flatten(F.flatten(F.transform(F.coalesce(f("ValidNoticeInfo"), F.array()), lambda v: F.transform(
        F.coalesce(v["AdditionalPublicationStatus"], F.array()), lambda s: F.transform(F.coalesce(s["AdditionalPublicationDocumentReference"], F.array()), lambda r: r["IssueDate"])))))
    papers = F.concat(*[some(f(p), _PAPERS) for p in ("LegalDocumentReference", "TechnicalDocumentReference")])
    links = F.filter(F.transform(papers, lambda p: F.struct(p["Attachment"]["ExternalReference"]["URI"].alias("url"), F.coalesce(p["ID"], F.lit("Procurement documents")).alias("title"), F.lit("document").alias("kind"))), lambda d: d["url"].isNotNull())
    day, clock = f("TenderingProcess.TenderSubmissionDeadlinePeriod.EndDate"), f("TenderingProcess.TenderSubmissionDeadlinePeriod.EndTime")
    deadline = xml_deadline(day, clock)
    system, procedure = f("TenderingProcess.ContractingSystemCode"), f("TenderingProcess.ProcedureCode")
    state = F.col("state")
    shut = F.coalesce(procedure.isin(*DIRECT), F.lit(False)) | F.coalesce(system.isin(*CALL_OFFS), F.lit(False)) | F.exists(results, lambda r: r["ResultCode"].isNotNull())
    status = F.when(state.isin("PRE", "PUB") & shut, "closed").otherwise(F.element_at(F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv]), state))
    framework = F.coalesce(system.isin(*FRAMEWORK_SYSTEMS), F.lit(False))
    kind = F.when(state == "ADJ", "AWARD").when(state == "PRE", "PIPELINE").when(framework, "FRAMEWORK").otherwise("LIVE_TENDER")
    vague = F.when(deadline.isNotNull() & ~deadline.contains("T"), F.concat(F.lit("Submission deadline (source local time): "), F.concat_ws(" ", day, clock), F.lit(". Time zone not supplied; check the source notice.")))
    text = F.concat_ws("\n\n", F.coalesce(f("ProcurementProject.Description"), f("ProcurementProject.Name"), F.concat(F.lit("Withdrawn notice "), "entry")), vague, f("TenderingProcess.TenderSubmissionDeadlinePeriod.Description"))
    return entries.where("fault is null and entry is not null").select(
        *[c for c in entries.columns if c not in ("fault", "folder", "xml")],
        F.coalesce(f("ProcurementProject.Name"), F.concat(F.lit("Withdrawn notice "), "entry")).alias("title"), text.alias("description"), status.alias("status"), kind.alias("kind"),
        F.when(state == "ADJ", "award").when(state == "PRE", "planning").otherwise("tender").alias("stage"), framework.alias("framework"),
        f("LocatedContractingParty.Party.PartyName.Name").alias("buyer"), F.transform(some(f("LocatedContractingParty.Party.PartyIdentification"), "array<struct<ID: string>>"), lambda p: p["ID"]).alias("buyer_ids"),
        f("ContractFolderID").alias("reference"), F.array_distinct(F.concat(codes(f("ProcurementProject.RequiredCommodityClassification")), F.flatten(F.transform(lots, lambda x: codes(x["ProcurementProject"]["RequiredCommodityClassification"]))))).alias("codes"),
        F.transform(lots, lambda x: F.struct(x["ID"].alias("lot_id"), x["ProcurementProject"]["Name"].alias("title"), x["ProcurementProject"]["Description"].alias("description"), codes(x["ProcurementProject"]["RequiredCommodityClassification"]).alias("codes"))).alias("lots"),
        F.transform(some(f("ProcurementProject.RealizedLocation"), "array<struct<CountrySubentity: string>>"), lambda p: p["CountrySubentity"]).alias("regions"),
        amount["_VALUE"].try_cast("double").alias("amount"), amount["_currencyID"].alias("currency"), deadline.alias("deadline"),
        F.array_distinct(F.filter(winners, lambda w: w.isNotNull())).alias("suppliers"), F.array_min(F.filter(published, lambda p: p.rlike(r"^\d{4}-\d{2}-\d{2}$"))).alias("published"), links.alias("documents"),
    )


def codice_lots(facts: DataFrame) -> DataFrame:
    """A row for each lot of what `codice_facts` gives."""
    return facts.select("entry", "status", F.explode("lots").alias("lot")).select("entry", "status", "lot.*")
