"""Search over notices: facets that are filters, counts, rankings."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bidstream.functions.text import fold_for_query, folded
from bidstream.operators.tiers import freshness


def conjunction(predicates: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, predicates, F.lit(True))


@dataclass
class Filters:
    """What a reader chose; an empty choice filters nothing. An unknown value fails every bound."""

    source: str | None = None
    currency: str | None = None
    buyer: str | None = None
    region: str | None = None
    code_prefix: str | None = None
    capability: str | None = None
    value_from: float | None = None
    value_to: float | None = None
    date_from: str | None = None
    date_to: str | None = None
    due_within_days: int | None = None
    kind: str | None = None
    sector: str | None = None
    amount_kind: str | None = None
    supplier: str | None = None
    award_from: str | None = None
    award_to: str | None = None
    change: str | None = None  # new or updated
    more: list[Column] = field(default_factory=list)

    def predicates(self, now: Column | None = None) -> list[Column]:
        c, out = F.col, list(self.more)
        if self.source:
            out.append(F.exists("provenance", lambda p: p == self.source))
        if self.currency:
            out.append(c("currency") == self.currency)
        if self.buyer:
            out.append(F.lower("buyer").contains(self.buyer.lower()))
        if self.region:
            out.append(F.exists("regions", lambda r: F.lower(r).contains(self.region.lower())))
        if self.code_prefix:
            out.append(F.exists("codes", lambda r: r.startswith(self.code_prefix)))
        if self.capability:
            out.append(F.array_contains("capabilities", self.capability))
        if self.value_from is not None:
            out.append(c("value_max") >= self.value_from)
        if self.value_to is not None:
            out.append(c("value_max") <= self.value_to)
        if self.date_from:
            out.append(c("published") >= F.lit(self.date_from).cast("date"))
        if self.date_to:
            out.append(c("published") <= F.lit(self.date_to).cast("date"))
        if self.due_within_days is not None:
            left = F.timestamp_diff("SECOND", now, c("deadline"))
            out.append((left > 0) & (F.ceil(left / 86400) <= self.due_within_days))
        for column, chosen in (("signal_type", self.kind), ("amount_kind", self.amount_kind)):
            if chosen:
                out.append(c(column) == chosen)
        if self.sector:
            out.append(F.array_contains("categories", self.sector))
        if self.supplier:
            out.append(folded(F.array_join("suppliers", " ")).contains(fold_for_query(self.supplier)))
        if self.award_from:
            out.append(c("award_date") >= F.lit(self.award_from).cast("date"))
        if self.award_to:
            out.append(c("award_date") <= F.lit(self.award_to).cast("date"))
        if self.change:
            out.append(freshness(c("first_seen"), c("updated"), now)[self.change])
        return out


def facet_counts(df: DataFrame, facets: dict[str, Column], chosen: dict[str, Column]) -> DataFrame:
    """(facet, value, n): values of each facet among rows that pass all choices but the facet's own.

    One scan for all facets: a row goes to each facet that it fails no other choice of.
    """
    ok = {f: chosen.get(f, F.lit(True)) for f in facets}

    def values_of(f: str, values: Column) -> Column:
        named = F.transform(F.array_distinct(values), lambda v: F.struct(F.lit(f).alias("facet"), v.cast("string").alias("value")))
        return F.when(conjunction([p for other, p in ok.items() if other != f]), named).otherwise(F.array().cast("array<struct<facet:string,value:string>>"))

    rows = [values_of(f, values) for f, values in facets.items()]
    return df.select(F.explode(F.concat(*rows)).alias("x")).groupBy("x.facet", "x.value").agg(F.count("*").alias("n"))


def view_counts(df: DataFrame, views: dict[str, Column]) -> DataFrame:
    """One row: how many rows are in each view, in one pass."""
    return df.agg(*[F.count_if(p).alias(v) for v, p in views.items()])


def ranked(df: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The first `most` rows of an order, numbered. Only those rows, which each task has picked, are numbered at once."""
    return df.orderBy(*order).limit(most).withColumn("rank", F.row_number().over(W.orderBy(*order)).cast("long"))


#: Points of a match: explicit in the title, explicit, needs in the title, needs, context, hint.
POINTS = {"explicit_title": 50, "explicit": 36, "needs_title": 18, "needs": 9, "context": 6, "hint": 4}


def evidence_points(evidence: Column) -> Column:
    """The best evidence's points."""
    table = F.create_map(*[F.lit(x) for pair in POINTS.items() for x in pair])
    return F.coalesce(F.array_max(F.transform(evidence, lambda e: F.element_at(table, e))), F.lit(0))


def breadth(capabilities: Column, most: int = 3) -> Column:
    return F.least(F.lit(most), F.size(F.array_distinct(capabilities)))


def market_members(df: DataFrame, area: str, markets: DataFrame) -> DataFrame:
    """Rows with each market that holds one of their areas; markets overlap, and a row is in each once.

    markets: (market, area), configuration of a few rows; Spark picks the join.
    """
    return df.join(markets, area).dropDuplicates([*df.columns, "market"])


def best_order(points: Column, coded: Column, tier: Column, state: Column, breadth: Column, in_title: Column, deadline: Column, published: Column, key: Column, now: Column) -> list[Column]:
    """The best matches first, by criteria of which no later one outweighs an earlier: points of evidence, a code, tier, how open a record is, how
    many capabilities, a phrase in the title, the deadline that is due first and not over, the latest publication, the key."""
    openness = F.when(state == "OPEN", 3).when(state == "EARLY_ENGAGEMENT", 2).when(state == "FUTURE", 1).otherwise(0)
    due = F.when(deadline > now, deadline)
    return [points.desc(), coded.desc(), tier.asc(), openness.desc(), breadth.desc(), in_title.desc(), due.asc_nulls_last(), published.desc_nulls_last(), key.asc()]


def tiered_order(tier: Column, by: str, published: Column, updated: Column, deadline: Column, now: Column, key: Column) -> list[Column]:
    """Tiers first, and in each the latest publication ("recent"), the latest update ("updated") or the deadline that is due first ("deadline"; what is
    over or unknown last); then the key."""
    second = {"recent": published.desc_nulls_last(), "updated": F.coalesce(updated, published).desc_nulls_last(), "deadline": F.when(deadline > now, deadline).asc_nulls_last()}
    return [tier.asc(), second[by], key.asc()]


@dataclass
class RelatedFilters:
    """What a reader chose among related records; an empty choice filters nothing, an unknown value or day fails every bound.

    text, party (array), day, currency and value are columns of the rows; day and value count only where their mode is on.
    """

    words: str = ""
    party: str = ""
    currency: str = ""
    day_from: str | None = None
    day_to: str | None = None
    least: float | None = None
    most: float | None = None

    def predicates(self) -> list[Column]:
        c, out = F.col, []
        text = folded(c("text"))
        out += [text.contains(w) for w in fold_for_query(self.words).split()]
        if self.party:
            out.append(folded(F.array_join("party", " ")).contains(fold_for_query(self.party)))
        if self.currency:
            out.append(c("currency") == self.currency)
        for column, low, high, kind in (("day", self.day_from, self.day_to, "date"), ("value", self.least, self.most, "double")):
            out += [c(column) >= F.lit(low).cast(kind)] if low is not None else []
            out += [c(column) <= F.lit(high).cast(kind)] if high is not None else []
        return out


def related_filter(text: Column, words: str) -> Column:
    return conjunction([F.lower(text).contains(w) for w in words.lower().split()])
