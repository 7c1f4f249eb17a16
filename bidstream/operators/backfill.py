"""What notices lack, from what is known beside them: identities, kinds of amounts, cached facts, translations, places in timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidstream.operators.ordered import round_robin

DEADLINES = "array<struct<kind:string,lot_id:string,value:string>>"


def _filled(column: str) -> Column:
    return F.nullif(F.trim(F.col(column)), F.lit(""))


def completed(notices: DataFrame, amount_kinds: dict[str, str], default: str = "unknown") -> DataFrame:
    """Notices with buyer_id, buyer_basis and procedure_id, and, where these are missing, amount_kind, deadlines and winners.

    A buyer is its least identifier, or else its name and countries (basis name); a procedure its number, or else the notice's URL. amount_kinds: what a source's amounts
    are; an award's amount is of a kind that its source does not tell. A deadline that stands alone is one for applications where funds are offered, and of
    no known kind elsewhere. A supplier that stands alone is the winner; a label that names several is not split.
    """
    identifier = F.array_min(F.filter(F.coalesce("buyer_identifiers", F.array().cast("array<string>")), lambda x: F.trim(x) != ""))
    place = F.array_join(F.array_sort(F.coalesce("countries", F.array().cast("array<string>"))), "+")
    name = F.lower(F.regexp_replace(_filled("buyer_name"), r"\s+", " "))
    kinds = F.create_map(*[F.lit(x) for kv in amount_kinds.items() for x in kv]) if amount_kinds else F.create_map().cast("map<string,string>")
    kind = F.when(F.col("signal_type") == "AWARD", F.lit(default)).otherwise(F.coalesce(F.try_element_at(kinds, F.coalesce("source", F.lit(""))), F.lit(default)))
    some_amount = F.col("value_min").isNotNull() | F.col("value_max").isNotNull()
    due = F.struct(F.when(F.col("signal_type") == "FUNDING", "application").otherwise("unknown").alias("kind"), F.lit(None).cast("string").alias("lot_id"), _filled("deadline_at").alias("value"))
    none = F.size(F.coalesce("deadlines", F.array().cast(DEADLINES))) < 1
    return notices.withColumns({
        "buyer_id": F.coalesce(F.concat(F.lit("id:"), identifier), F.concat(F.lit("name:"), name, F.lit("@"), place)),
        "buyer_basis": F.when(identifier.isNotNull(), "identifier").when(name.isNotNull(), "name"),
        "procedure_id": F.coalesce(F.concat(F.lit("ocid:"), _filled("ocid")), F.concat(F.lit("url:"), F.col("url"))),
        "amount_kind": F.coalesce(_filled("amount_kind"), F.when(some_amount, kind)),
        "deadlines": F.when(none & due["value"].isNotNull(), F.array(due)).otherwise(F.col("deadlines")),
        "winners": F.when((F.size(F.coalesce("winners", F.array().cast("array<string>"))) < 1) & _filled("supplier").isNotNull(), F.array(_filled("supplier"))).otherwise(F.col("winners")),
    })


def backfilled(notices: DataFrame, cache: DataFrame, key: str, facts: list[str], source: str) -> DataFrame:
    """Notices of one source with their facts as a cached original has them, whether it has them or not; documents of both, one for each link, the original's first.

    Without an original a deadline at midnight UTC, that was made up for a day, is the day again; other notices are left as they are. `cache` has a
    row for each key at most, with key, facts and documents.
    """
    original = cache.select(key, F.lit(True).alias("cached_"), *[F.col(c).alias(f"{c}_c") for c in facts], F.col("documents").alias("documents_c"))
    own = F.coalesce(F.col("source") == source, F.lit(False))
    rows = notices.join(original, key, "left").withColumn("cached_", own & F.coalesce("cached_", F.lit(False)))
    links = F.concat(F.coalesce("documents_c", F.array()), F.coalesce("documents", F.array()))
    once = F.filter(links, lambda d, i: ~F.exists(F.slice(links, F.lit(1), i), lambda e: e["url"] == d["url"]))
    day = F.when(own & ~F.col("cached_") & F.col("deadline_at").rlike(r"T00:00:00(?:\+00:00|Z)$"), F.substring("deadline_at", 1, 10)).otherwise(F.col("deadline_at"))
    out = {c: F.when(F.col("cached_"), F.col(f"{c}_c")).otherwise(day if c == "deadline_at" else F.col(c)) for c in facts}
    out["documents"] = F.when(F.col("cached_"), once).otherwise(F.col("documents"))
    return rows.select(*[out[c].alias(c) if c in out else F.col(c) for c in notices.columns])


def overlaid(records: DataFrame, translations: DataFrame, key: str, made_of: str, fields: list[str]) -> DataFrame:
    """Records with field_en for each of `fields`: the translation's, if it was made of the very text that the record has now."""
    current = translations.select(key, made_of, *[F.col(f).alias(f"{f}_en") for f in fields]).dropDuplicates([key, made_of])
    return records.join(current, [key, made_of], "left").select(*records.columns, *[f"{f}_en" for f in fields])


def in_timelines(notices: DataFrame, keys: dict[str, list[str]]) -> DataFrame:
    """Notices with, for each key, its place among the notices that share it and how many there are; keys: {column: the order's columns}.

    A reader slices a timeline by place. It is not copied to each of its notices, which for a buyer with a third of all would be a ninth of all pairs.
    """
    out = notices
    for key, order in keys.items():
        known = out.where(F.col(key).isNotNull())
        counts = known.groupBy(key).agg(F.count("*").alias(f"{key}_of"))
        placed = round_robin(known, key, order).withColumnRenamed("turn", f"{key}_place").join(counts, key)
        out = placed.unionByName(out.where(F.col(key).isNull()), allowMissingColumns=True)
    return out
