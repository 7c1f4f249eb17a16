"""Listings: what choices mean in each view, orders of rows, personal sets, counts for audits and publication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bidstream.operators.ordered import running_total

#: The choices with a list of their own, and what counts where a link has none of the list; fixed, as links are shared.
LISTS = {
    "view": (("all", "live", "early", "closing", "today", "saved", "awards"), "all"),
    "sort": (("relevance", "recent", "updated", "deadline", "value", "value-low", "capability"), "relevance"),
}
#: Names of older links: what each sets, whatever else is chosen, and what it sets where nothing is.
ALIASES = (
    ("sort", "awarded", {"view": "awards", "sort": "recent", "type": "", "deadline": "", "change": ""}, {}),
    ("view", "frameworks", {"view": "all"}, {"type": "FRAMEWORK"}),
    ("view", "pipeline", {"view": "early"}, {}), ("view", "updates", {"view": "today"}, {}),
)
#: The choices that not all views know, and the views that do.
VIEWS_THAT_KNOW = {c: ("awards",) for c in ("supplier", "award_from", "award_to")} | {c: tuple(v for v in LISTS["view"][0] if v != "awards") for c in ("type", "deadline", "change")}


def valid_choices(chosen: dict[str, str]) -> dict[str, str]:
    """Choices with known views and orders; what is unknown takes the default. An old name may choose a type as well."""
    out = {k: v for k, v in chosen.items() if isinstance(v, str)}
    for choice, name, always, otherwise in ALIASES:
        if out.get(choice) == name:
            out |= always | {k: v for k, v in otherwise.items() if not out.get(k)}
    return out | {choice: out[choice] if out.get(choice) in known else default for choice, (known, default) in LISTS.items()}


def applicable(chosen: dict[str, str]) -> dict[str, str]:
    """The choices that count in the chosen view; the others stay known, and are empty here."""
    view = chosen.get("view", LISTS["view"][1])
    return {k: v if view in VIEWS_THAT_KNOW.get(k, (view,)) else "" for k, v in chosen.items()}


TIERS = {"platform": 0, "ai": 1, "other": 2}


def tier(priority: Column) -> Column:
    out = F.lit(max(TIERS.values()))
    for name, n in TIERS.items():
        out = F.when(priority == name, n).otherwise(out)
    return out


def award_order(priority: str, dates: list[str], key: str) -> list[Column]:
    """Awards: tier, then the first known of several dates, latest first, then the key."""
    return [tier(F.col(priority)).asc(), F.coalesce(*[F.col(d) for d in dates]).desc_nulls_last(), F.col(key).asc()]


def queue_order(priority: str, published: str, first_seen: str, key: str) -> list[Column]:
    """What is worked on next: tier, latest publication, key."""
    return [tier(F.col(priority)).asc(), F.coalesce(published, first_seen).desc_nulls_last(), F.col(key).asc()]


def supplier_order(award_date: str, published: str, key: str) -> list[Column]:
    """A supplier's awards: latest first, those without any date last, then the key."""
    return [F.coalesce(F.col(award_date), F.col(published), F.lit("").cast("string")).desc(), F.col(key).asc()]


def personal(df: DataFrame, key: str, saved: DataFrame, hidden: DataFrame, view: str) -> DataFrame:
    """What a reader sees: the saved rows in the view of these, else all but the hidden ones."""
    return df.join(saved.select(key).distinct(), key, "left_semi") if view == "saved" else df.join(hidden.select(key).distinct(), key, "left_anti")


def is_current(status: Column, deadline: Column, seen: Column, now: Column, days: int = 365) -> Column:
    """Whether a record stays in the current set: not over, or seen within so many days."""
    over = F.coalesce(deadline <= now, F.lit(False)) | F.lower(F.coalesce(status, F.lit(""))).isin("closed", "cancelled", "withdrawn", "awarded", "complete")
    return ~over | F.coalesce(F.timestamp_diff("DAY", seen, now) <= days, F.lit(False))


def audit_counts(df: DataFrame, groups: list[str], checks: dict[str, Column]) -> DataFrame:
    """For each group its rows and how many of them hold each check, in one pass; groups are counted before they are shuffled."""
    return df.groupBy(*groups).agg(F.count("*").alias("rows"), *[F.count_if(p).alias(name) for name, p in checks.items()])


def coverage(texts: DataFrame, translations: DataFrame, key: str, digest: str, group: str, target: str = "en") -> DataFrame:
    """For each group the texts that need no translation, have a current one, have one of older text, or have none."""
    made = translations.select(key, F.col(digest).alias("made_of"))
    both = texts.join(made, key, "left")
    own = F.col("lang") == target
    return both.groupBy(group).agg(
        F.count_if(own).alias("original"), F.count_if(~own & (F.col("made_of") == F.col(digest))).alias("translated"),
        F.count_if(~own & (F.col("made_of") != F.col(digest))).alias("outdated"), F.count_if(~own & F.col("made_of").isNull()).alias("missing"),
    )


def translation_queue(texts: DataFrame, translations: DataFrame, key: str, digest: str, size: str, quota: int, order: list[Column]) -> DataFrame:
    """Texts without a current translation, in order, as long as their sizes add up to no more than a quota; a text counts at least one."""
    open_texts = texts.join(translations.select(key, digest), [key, digest], "left_anti")
    return running_total(open_texts, order, F.greatest(F.col(size), F.lit(1)), "spent").where(F.col("spent") <= quota)


def quota_day(at: Column, zone: str = "America/Los_Angeles") -> Column:
    """The day that a use counts for, where quotas start anew at the provider's midnight; `at` is in UTC."""
    return F.to_date(F.from_utc_timestamp(at, zone))


def remaining(models: DataFrame, uses: DataFrame, day: Column) -> DataFrame:
    """Models (model, per_day) with used, what the ledger's uses (model, day, calls, returned) of a day took less what they gave back, and left."""
    taken = uses.where(F.col("day") == day).groupBy("model").agg(F.sum(F.col("calls") - F.coalesce("returned", F.lit(0))).alias("used"))
    out = models.join(taken, "model", "left").withColumn("used", F.coalesce("used", F.lit(0)).cast("long"))
    return out.withColumn("left", F.greatest(F.col("per_day") - F.col("used"), F.lit(0)).cast("long"))


def allowances(left: DataFrame, calls: int, least: int = 1) -> DataFrame:
    """Models (model, left) with limit: how many of a run's calls each gets, as evenly as what they have left allows, earlier names first.

    A model with fewer than `least` calls left takes no part. Worked out by levels, not call by call: with k models at or above a level each
    further level costs k calls. Models are configuration, so one window holds them.
    """
    part = F.col("left") >= least
    by_left = W.partitionBy(F.lit(0)).orderBy("left_", "model")
    rows = left.withColumn("left_", F.when(part, F.col("left")).otherwise(0))
    # what it costs to serve all up to a model's own level: the smaller ones whole, the others as much as this one
    n = F.count("*").over(W.partitionBy(F.lit(0)))
    rows = rows.withColumn("nth_", F.row_number().over(by_left)).withColumn("below_", F.sum("left_").over(by_left) - F.col("left_")).withColumn("n_", n)
    rows = rows.withColumn("cost_", F.col("below_") + F.col("left_") * (F.col("n_") - F.col("nth_") + 1))
    served = F.when(F.col("cost_") <= calls, F.col("left_"))
    # the others share what the served ones leave
    whole = W.partitionBy(F.lit(0))
    rows = rows.withColumn("served_", served)
    rest = F.lit(calls) - F.coalesce(F.sum("served_").over(whole), F.lit(0))
    others = F.count(F.when(F.col("served_").isNull(), 1)).over(whole)
    rows = rows.withColumn("rest_", rest).withColumn("others_", others)
    place = F.count(F.when(F.col("served_").isNull(), 1)).over(whole.orderBy("model").rowsBetween(W.unboundedPreceding, 0))
    each = F.floor(F.col("rest_") / F.greatest(F.col("others_"), F.lit(1)))
    limit = F.coalesce("served_", each + (place <= F.col("rest_") % F.greatest(F.col("others_"), F.lit(1))).cast("long"))
    return rows.select(*left.columns, limit.cast("long").alias("limit"))


def view_manifest(df: DataFrame, key: str, views: dict[str, Column]) -> DataFrame:
    """(view, rows, keys, checksum): what each published view holds; one scan, a row goes to each view that it is in."""
    named = F.array_compact(F.array(*[F.when(p, F.lit(v)) for v, p in views.items()]))
    rows = df.select(key, F.explode(named).alias("view"))
    return rows.groupBy("view").agg(
        F.count("*").alias("rows"), F.count_distinct(key).alias("keys"), F.sum(F.crc32(F.col(key).cast("string"))).cast("long").alias("checksum")
    )
