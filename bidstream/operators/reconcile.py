"""Reconciliation: revisions of notices become records, with their histories, all by grouping and windows.

A component of shared keys is one legal identity. Its revisions, in order of time, are read as offers of facts: a sparse
revision offers only the facts that it has, one of a source that publishes whole snapshots offers all, nulls too. The last
offer of each fact holds. Nothing is folded row by row in Python; a record with very many revisions is sorted and spilled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bidstream.operators import ordered
from bidstream.operators.identity import has_fact, key_components


def _named(ocid: str = "ocid") -> Column:
    return F.when(F.col(ocid) != "", F.col(ocid))


def with_records(rows: DataFrame) -> DataFrame:
    """`rows` (id, at, source, ocid, keys, ..) with `record`: the least id of what is one procedure.

    Rows that share keys are one record, by way of others too. But where one source gives a component several procedure numbers, each
    number is a record of its own there; a row without one goes to the earliest of those that it shares a key with, or, if
    it shares none, to a record of the component's rows without a number.
    """
    keyed = rows.select("id", F.explode("keys").alias("key"))
    linked = rows.join(key_components(keyed, "id", "key"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    numbers = linked.groupBy("component", "source").agg(F.count_distinct(_named()).alias("n")).where("n > 1").select("component").distinct()
    parted = linked.join(numbers.withColumn("parted", F.lit(True)), "component", "left")
    split = parted.where("parted").select("id", "at", "component", _named().alias("number"), F.explode("keys").alias("key"))
    known = split.where("number is not null").groupBy("component", "key").agg(F.min(F.struct("at", "number")).alias("first"))
    lent = split.where("number is null").join(known, ["component", "key"]).groupBy("id").agg(F.min("first").getField("number").alias("lent"))
    numbered = parted.join(lent, "id", "left").withColumn("number", F.when(F.col("parted"), F.coalesce(_named(), "lent", F.lit(""))).otherwise(F.lit("")))
    names = numbered.groupBy("component", "number").agg(F.min("id").alias("record"))
    return numbered.join(names, ["component", "number"]).select(*rows.columns, "record")


def compatible(record: Column, notice: Column, whole_sources: tuple[str, ...] = ()) -> Column:
    """Whether a notice that shares an identifier with a record may be the same one; both are structs (source, ocid, lot_id, lot_ids, signal_type).

    They have to be of one lot, or both of none, and one source's procedure numbers may not differ. An award for one lot of several is the record's only if it
    names a lot and all the record's lots. Sources that publish whole procedures need no more than the number and the lot.
    """
    filled = lambda x: F.coalesce(x, F.lit("")) != ""
    one_lot = record["lot_id"].eqNullSafe(notice["lot_id"])
    same_source = F.coalesce(record["source"] == notice["source"], F.lit(False))
    same_number = filled(record["ocid"]) & F.coalesce(record["ocid"] == notice["ocid"], F.lit(False))
    lots = lambda x: F.array_sort(F.array_distinct(F.coalesce(x["lot_ids"], F.array().cast("array<string>"))))
    kind = lambda x: F.coalesce(x["signal_type"], F.lit(""))
    partial = (kind(record) != "AWARD") & (F.size(F.coalesce(record["lot_ids"], F.array().cast("array<string>"))) > 1) & (kind(notice) == "AWARD")
    part_of = filled(notice["lot_id"]) & (lots(record) == lots(notice))
    other_number = same_source & filled(record["ocid"]) & filled(notice["ocid"]) & (record["ocid"] != notice["ocid"])
    whole = same_source & same_number & F.coalesce(record["source"].isin(*whole_sources), F.lit(False)) if whole_sources else F.lit(False)
    return F.when(whole, one_lot).otherwise((~partial | part_of) & one_lot & ~other_number)


def is_older(incoming: Column, current: Column, observed: tuple[str, ...] = (), by_day: tuple[str, ...] = ()) -> Column:
    """Whether a notice is an earlier revision than the one that holds; structs (source, updated, first_seen, last_seen, alias, aliases).

    By the time of update or, without one, of first sight; null where either has neither. observed: sources whose times of update don't move, so
    that the time of last sight counts. by_day: sources that tell days only, where of two notices of one day the one that the other names is
    earlier.
    """
    same = lambda listed: F.coalesce((incoming["source"] == current["source"]) & incoming["source"].isin(*listed), F.lit(False)) if listed else F.lit(False)
    at = lambda x: F.coalesce(x["updated"], x["first_seen"])
    named = F.coalesce((incoming["alias"] != current["alias"]) & F.array_contains(current["aliases"], incoming["alias"]), F.lit(False))
    by_time = F.when(same(by_day) & (at(incoming) == at(current)) & named, F.lit(True)).otherwise(at(incoming) < at(current))
    return F.when(same(observed), incoming["last_seen"] < current["last_seen"]).otherwise(by_time)


def _offers(facts: list[str], units: list[list[str]], whole: Column) -> dict[str, Column]:
    """For each fact the condition on which a revision offers it; the facts of a unit are offered together."""
    out = {c: whole | has_fact(F.col(c)) for c in facts}
    for unit in units:
        some = whole
        for c in unit:
            some = some | has_fact(F.col(c))
        out |= {c: some for c in unit}
    return out


def revised(rows: DataFrame, record: str, order: list[str], facts: list[str], units: list[list[str]] = (), snapshots: tuple[str, ...] = ()) -> DataFrame:
    """`rows` with, for each fact c, c_now, what holds after the revision, and `changed`, the facts that it changed.

    units: facts that move together, such as an amount's bounds and currency. snapshots: sources whose revisions are whole.
    A record's first revision changes nothing.
    """
    before = W.partitionBy(record).orderBy(*order)
    so_far = before.rowsBetween(W.unboundedPreceding, 0)
    whole = F.coalesce(F.col("source").isin(*snapshots), F.lit(False)) if snapshots else F.lit(False)
    offers = _offers(list(facts), list(units), whole)
    # a fact is held in a struct, so that an offered null is told from no offer
    held = rows.withColumns({f"{c}_at": F.last(F.when(ok, F.struct(F.col(c).alias("v"))), ignorenulls=True).over(so_far) for c, ok in offers.items()})
    held = held.withColumns({"nth_": F.row_number().over(before), **{f"{c}_was": F.lag(f"{c}_at").over(before) for c in offers}})
    news = [F.when((F.col("nth_") > 1) & ~F.col(f"{c}_at.v").eqNullSafe(F.col(f"{c}_was.v")), F.lit(c)) for c in offers]
    return held.select(*rows.columns, *[F.col(f"{c}_at.v").alias(f"{c}_now") for c in offers], F.array_compact(F.array(*news)).alias("changed"))


def records(history: DataFrame, record: str, order: list[str], at: str, facts: list[str], log: int = 30) -> DataFrame:
    """One row of each record from revised(): its facts, first_seen, last_seen, versions, changes and the last `log` changes (at, fields)."""
    last = history.groupBy(record).agg(
        F.max_by(F.struct(*[F.col(f"{c}_now").alias(c) for c in facts]), F.struct(*order)).alias("now"), F.min(at).alias("first_seen"), F.max(at).alias("last_seen"),
        F.count("*").alias("versions"), F.count_if(F.size("changed") > 0).alias("changes"),
    )
    moved = history.where(F.size("changed") > 0).select(record, F.col(at).alias("at"), F.array_join("changed", ",").alias("fields"))
    logged = ordered.last_n(moved, [record], ["at", "fields"], log, "log")
    return last.join(logged, record, "left").select(record, "now.*", "first_seen", "last_seen", "versions", "changes", "log")


def deadline_history(deadlines: DataFrame, record: str, at: str, item: list[str], most: int = 20) -> DataFrame:
    """(record, item.., status): the deadlines of the latest revision that gives any are current, the last `most` others superseded.

    deadlines: a row for each deadline of a revision.
    """
    newest = deadlines.groupBy(record).agg(F.max(at).alias("newest"))
    seen = deadlines.groupBy(record, *item).agg(F.max(at).alias("last_at")).join(newest, record)
    seen = seen.withColumn("status", F.when(F.col("last_at") == F.col("newest"), "current").otherwise("superseded"))
    nth = F.row_number().over(W.partitionBy(record, "status").orderBy(F.desc("last_at"), *item))
    return seen.withColumn("nth_", nth).where((F.col("status") == "current") | (F.col("nth_") <= most)).select(record, *item, "status")


def provenance(versions: DataFrame, record: str, version: list[str], at: str, most: int = 60) -> DataFrame:
    """The last `most` versions of each record: one for each (source, release, url, hash), when it was last seen."""
    newest = versions.groupBy(record, *version).agg(F.max(at).alias(at))
    nth = F.row_number().over(W.partitionBy(record).orderBy(F.desc(at), *version))
    return newest.withColumn("nth_", nth).where(F.col("nth_") <= most).drop("nth_")


def last_by_url(documents: DataFrame, record: str, order: list[str], most: int = 40) -> DataFrame:
    """Of a record's documents with one URL the last, and of those the last `most` by when the URL came first."""
    rest = [c for c in documents.columns if c not in (record, "url")]
    one = documents.groupBy(record, "url").agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("d"), F.min(F.struct(*order)).alias("came_"))
    nth = F.row_number().over(W.partitionBy(record).orderBy(F.desc("came_"), F.desc("url")))
    return one.withColumn("nth_", nth).where(F.col("nth_") <= most).select(record, "url", "d.*")


#: Statuses of awards that settle nothing.
VOID = ("cancelled", "canceled", "withdrawn", "unsuccessful")


def settling(awards: DataFrame) -> DataFrame:
    """Awards (status, award_statuses, ..) that settle lots."""
    active = F.coalesce(F.size("award_statuses") == 0, F.lit(True)) | F.array_contains("award_statuses", "active")
    return awards.where(~F.lower(F.coalesce("status", F.lit(""))).isin(*VOID) & active)


def lot_outcomes(lots: DataFrame, awards: DataFrame) -> DataFrame:
    """Lots (procedure, lot, status) with source_status, the status that awards give, and the procedure's.

    The sources' own statuses are the baseline, kept beside what follows from awards: all is worked out from it on each run, so a
    withdrawn award leaves nothing behind.
    """
    hit = settling(awards).select("procedure", F.explode("lot_ids").alias("lot")).distinct().withColumn("hit_", F.lit(True))
    out = lots.withColumnRenamed("status", "source_status").join(hit, ["procedure", "lot"], "left")
    out = out.withColumn("status", F.when(F.col("hit_"), "awarded").otherwise(F.col("source_status"))).drop("hit_")
    whole = out.groupBy("procedure").agg(F.when(F.bool_and(F.col("status") == "awarded"), "complete").alias("procedure_status"))
    return out.join(whole, "procedure")


def run_counts(before: DataFrame, after: DataFrame, record: str) -> DataFrame:
    """One row: records that are new, that have more changes than before, and revisions that were merged."""
    was = before.select(record, F.col("changes").alias("was_changes"), F.col("versions").alias("was_versions"))
    both = after.join(was, record, "left")
    return both.agg(
        F.count_if(F.col("was_versions").isNull()).alias("new_records"), F.count_if(F.col("changes") > F.coalesce("was_changes", F.lit(0))).alias("material_updates"),
        F.coalesce(F.sum(F.col("versions") - F.coalesce("was_versions", F.lit(1))), F.lit(0)).cast("long").alias("merged"),
    )
