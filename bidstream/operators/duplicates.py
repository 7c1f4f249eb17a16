"""Notices that two publishers have of one procurement, by names that are nearly the same and two anchors that agree.

Both a deadline and an amount have to agree, so pairs are sought in cells of days and of amounts, where few notices meet, and
not among all of a buyer or a nation. Notices that are alike in all that counts are one class first, and a class is compared once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidstream.operators.identity import components
from bidstream.operators.related import indel_ratio
from bidstream.sources.shared import stored

#: Least similarity of names and of titles in hundredths, and how far anchors may lie apart. Fixed.
NAME, TITLE, DEADLINE_SECONDS, SHARE, PUBLISHED_DAYS = 95, 94, 86_400, 0.02, 45
#: Two names of this length together are long enough for two insertions or deletions at that similarity; below it one is the most.
LONG = 100 // (100 - NAME)
#: Days and steps of the amounts' scale in a cell where names agree too. A notice is copied to some 1.6 cells; with half of that it would be 2.3.
CELL = (8, 16)
#: What notices of a class agree in.
SAME = ["source", "buyer", "title", "deadline", "amount", "currency", "lot", "ocid", "published"]


def _may_reach(a: Column, b: Column, percent: int) -> Column:
    """Whether two texts may be as alike as that: no more insertions and deletions are left than edits are needed at least."""
    most = ((F.length(a) + F.length(b)) * (100 - percent) / 100.0 + 1e-9)
    return (F.abs(F.length(a) - F.length(b)) <= most) & (F.levenshtein(a, b) <= most)


def classes(notices: DataFrame) -> DataFrame:
    """`notices` with `class_`, the least id of those with the same source, buyer, title, deadline, amount, currency, lot, procedure and day."""
    return _classed(notices, notices.groupBy(*SAME).agg(F.min("id").alias("class_")))


def _classed(notices: DataFrame, least: DataFrame) -> DataFrame:
    on = [notices[c].eqNullSafe(least[c]) for c in SAME]
    return notices.join(least, on).select(notices["*"], least["class_"])


def _alike_names(names: DataFrame) -> DataFrame:
    """(buyer, other): each name with itself and with those that have one letter more, of names too short for a second edit.

    A name of which one letter is taken away is found by equality, so the work grows with the names and not with their pairs.
    """
    name, longer = F.col("buyer"), F.length("buyer")
    without = F.transform(F.sequence(F.lit(1), longer), lambda i: F.xxhash64(F.concat(F.substring(name, F.lit(1), i - 1), F.substring(name, i + 1, longer))))
    cut = F.when((longer > 1) & (longer <= LONG), F.array_distinct(without)).otherwise(F.array())
    one, more = names.select("buyer", F.xxhash64("buyer").alias("key_")), names.select(name.alias("other"), F.explode(cut).alias("key_"))
    a, b = F.length("buyer"), F.length("other")
    near = one.join(more, "key_").where((b == a + 1) & (F.levenshtein("buyer", "other") == 1) & (200.0 * a / (a + b) >= NAME))
    return names.select("buyer", name.alias("other")).union(near.select("buyer", "other"))


def duplicate_pairs(notices: DataFrame) -> DataFrame:
    """(a, b): classes of notices that are nearly the same, a before b; notices has class_ from classes().

    deadline and published are timestamps. Names and titles are compared as they are given, so fold them first. A missing
    buyer, deadline or amount leaves a notice out; lots have to be equal, and so have the procedure numbers of one source.
    Names of fewer than 2 * LONG letters together may differ by one letter only, so they are matched by equality first; longer ones
    that differ meet in cells of day and amount alone, where the pairs grow with the square of a cell's notices.
    """
    rows = notices.where("id = class_ and buyer <> '' and deadline is not null and amount is not null")
    second = F.unix_seconds("deadline")
    # amounts within 2 % differ by no more than two steps of this scale, small ones by no more than 1
    step = math.log1p(SHARE)
    scale = F.floor(F.log(F.greatest(F.col("amount"), F.lit(1.0)) + 50) / F.lit(step)).cast("long")
    cells = rows.withColumn("day_", F.floor(second / DEADLINE_SECONDS)).withColumn("scale_", scale)
    c = F.col
    # a is the one of the lower id, of which the bound of amounts is taken
    first = F.when(c("a.id") < c("b.id"), c("a.amount")).otherwise(c("b.amount"))
    anchored = (
        (F.abs(F.unix_seconds("a.deadline") - F.unix_seconds("b.deadline")) <= DEADLINE_SECONDS) & c("a.currency").eqNullSafe(c("b.currency"))
        & (F.abs(c("a.amount") - c("b.amount")) <= F.greatest(F.lit(1.0), first * SHARE))
    )
    days = F.abs(F.datediff("a.published", "b.published"))
    vetoes = c("a.lot").eqNullSafe(c("b.lot")) & F.coalesce(days <= PUBLISHED_DAYS, F.lit(True)) & ~F.coalesce(
        (c("a.source") == c("b.source")) & (c("a.ocid") != "") & (c("b.ocid") != "") & (c("a.ocid") != c("b.ocid")), F.lit(False)
    )
    title = (c("a.title") == c("b.title")) | _may_reach(c("a.title"), c("b.title"), TITLE)

    def spread(df: DataFrame, column: str, reach: int, width: int) -> DataFrame:
        """Copies of `df` for each cell of so many steps that holds something within reach."""
        lowest, highest = (F.floor((c(column) + x) / width).cast("long") for x in (-reach, reach))
        return df.withColumn(column, F.explode(F.sequence(lowest, highest)))

    def met(a: DataFrame, b: DataFrame, keys: list[str], width: tuple[int, int], which: Column) -> DataFrame:
        """Pairs of a and b in one cell, with what is left to be compared letter by letter. Only what is compared is copied to the cells."""
        a = spread(spread(a, "day_", 1, width[0]), "scale_", 2, width[1]).alias("a")
        b = b.withColumns({"day_": F.floor(c("day_") / width[0]).cast("long"), "scale_": F.floor(c("scale_") / width[1]).cast("long")}).alias("b")
        on = which & anchored & vetoes & title
        for k in [*keys, "day_", "scale_"]:
            on = (c(f"a.{k}") == c(f"b.{k}")) & on
        met = a.join(b, on)
        names = [c(f"{side}.buyer").alias(f"name_{side}") for side in "ab"] if "buyer" in a.columns else []
        return met.select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b"), *names, c("a.title").alias("title_a"), c("b.title").alias("title_b"))

    # what is left after the bounds is compared letter by letter, unless it is equal
    same = lambda x, y, least: (c(x) == c(y)) | (indel_ratio(F.when(c(x) != c(y), c(x)), c(y)) >= least)
    compared = ["id", "source", "title", "deadline", "amount", "currency", "lot", "ocid", "published", "day_", "scale_"]
    # names that meet here are near enough as it is, so the key alone goes with a notice
    names = _alike_names(cells.select("buyer").distinct())
    one = cells.join(names, "buyer").select(*compared, "other", (c("buyer") == c("other")).alias("own_"))
    pairs = met(one, cells.select(*compared, c("buyer").alias("other")), ["other"], CELL, ~c("a.own_") | (c("a.id") < c("b.id")))
    pairs = pairs.where(same("title_a", "title_b", TITLE)).select("a", "b")
    # the shortest name that may differ by more than a letter from a longer one
    longer = cells.where(F.length("buyer") >= LONG).select(*compared, "buyer")
    if not longer.isEmpty():
        a, b = F.length("a.buyer"), F.length("b.buyer")
        which = (c("a.buyer") != c("b.buyer")) & (a + b >= 2 * LONG) & ((a > b) | ((a == b) & (c("a.id") < c("b.id"))))
        shorter = cells.where(F.length("buyer") >= LONG - 1).select(*compared, "buyer")
        found = met(longer, shorter, [], (1, 1), which & _may_reach(c("a.buyer"), c("b.buyer"), NAME))
        pairs = pairs.union(found.where(same("name_a", "name_b", NAME) & same("title_a", "title_b", TITLE)).select("a", "b"))
    return pairs  # each once: a notice is in one cell, which another's copies meet once, and names are near in one order


def duplicate_groups(notices: DataFrame) -> DataFrame:
    """(id, group): the least id of the notices that are nearly the same as it, by way of others too."""
    firsts = stored(notices.groupBy(*SAME).agg(F.min("id").alias("id"), F.count("*").alias("n_")), "duplicate-classes")
    grouped = components(duplicate_pairs(firsts.withColumn("class_", F.col("id")))).withColumnRenamed("node", "class_")
    known = firsts.select("id", F.col("id").alias("class_"))
    # notices are read again, to be told their class, only where classes have others than the first
    several = firsts.where("n_ > 1").select(*SAME, F.col("id").alias("class_"))
    if not several.isEmpty():
        known = known.union(_classed(notices, several).where("id <> class_").select("id", "class_"))
    return known.join(grouped, "class_", "left").select("id", F.coalesce("component", "class_").alias("group"))
