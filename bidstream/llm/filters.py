"""What filters take together and apart, by the subset-zeta transform.

Each document has a mask of the filters that it fails. A part of the corpus is then no more than how many documents have
each mask, and summing these counts over subsets gives at once how many survive every set of filters. A step of an order
is the difference between two neighbouring sets, whatever came before: so all orders, and a filter's mean share in what
goes, come from one pass over the texts and one row of counts for each part.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bidstream.llm.common import documents, labels, stored, text_of

#: The measures of a mask's documents: all, those that are good, those that are toxic.
MEASURES = ("n", "good", "toxic")


def text_failures(text: Column) -> dict[str, Column]:
    """Filters on a text alone: A few words, B few distinct words, C many capitals, D symbols. Expects a column words_ beside it."""
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": F.size("words_") < 50,
        "B": 100 * F.size(F.array_distinct("words_")) < 65 * F.size("words_"),
        "C": 100 * capitals > 5 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def _mask(fails: Sequence[Column]) -> Column:
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask): which of the filters A to E each row of `docs` fails, one bit for each, A the lowest.

    A null text is empty, a null source the part "". E: another row with a smaller id has the same text; a null id is
    neither smaller than another nor greater. Rows that repeat an id and a text do not fail for one another.
    """
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), text_of().alias("text_"))
    split = F.array_remove(F.split("text_", r"[\x20\x09-\x0D]+"), "")
    own = _mask(list(text_failures(F.col("text_")).values()))
    rows = whole.withColumn("words_", split).select("doc_id", "part", own.alias("own_"), F.unhex(F.sha2(F.col("text_").cast("binary"), 256)).alias("same_"))
    rows = stored(rows, "filter-masks")
    # counted map-side; a text that stands once needs no row
    first = rows.groupBy("same_").agg(F.min("doc_id").alias("first_"), F.count("*").alias("n_")).where("n_ > 1").drop("n_")
    again = F.coalesce(F.col("doc_id") > F.col("first_"), F.lit(False))
    return rows.join(first, "same_", "left").select("doc_id", "part", (F.col("own_") + F.when(again, 16).otherwise(0)).alias("mask"))


def mask_counts(judged: DataFrame, marks: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic) of rows (doc_id, part, mask); marks: doc_id, quality, toxic, by any row of an id."""
    seen = judged.groupBy("part", "mask").agg(F.count("*").alias("n")).select("part", "mask", "n", F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    is_set = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("long")), F.lit(0))
    marked = marks.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(is_set("quality").alias("good"), is_set("toxic").alias("toxic")).where("good + toxic > 0")
    lost = judged.join(marked, "doc_id").groupBy("part", "mask").agg(F.lit(0).cast("long").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    return seen.unionByName(lost).groupBy("part", "mask").agg(*[F.sum(m).alias(m) for m in MEASURES])


def survivors(counts: DataFrame, filters: int) -> DataFrame:
    """A row for each part: for each measure an array, whose entry S says how much survives the set S of filters.

    The zeta transform sums over all submasks, one filter after the other; what survives S are the masks within S's complement.
    """
    full = (1 << filters) - 1
    held = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*MEASURES)))).alias("held_"))  # 2 ** filters entries at most
    bits = F.array(*[F.lit(1 << i) for i in range(filters)])

    def zeta(measure: str) -> Column:
        dense = F.transform(F.sequence(F.lit(0), F.lit(full)), lambda m: F.coalesce(F.col("held_")[m][measure], F.lit(0).cast("long")))
        step = lambda sums, bit: F.transform(sums, lambda x, i: x + F.when(i.bitwiseAND(bit) != 0, F.get(sums, i.bitwiseXOR(bit))).otherwise(F.lit(0).cast("long")))
        return F.reverse(F.aggregate(bits, dense, step))  # entry S of the reverse is that of S's complement

    return held.select("part", *[zeta(m).alias(m) for m in MEASURES])


def order_steps(left: DataFrame, filters: str, orders: Sequence[str] | None = None) -> DataFrame:
    """A row for each part, order and step of what `survivors` gives, with the step's filter and what it does there.

    kept, removed; redundant: fail the filter but went earlier; unique_fails: fail nothing else; good_lost, toxic_lost;
    shapley: what the filter removes, summed over all orders there are. orders: by default all permutations of the filters' letters.
    """
    k, full = len(filters), (1 << len(filters)) - 1
    orders = list(orders) if orders is not None else ["".join(p) for p in permutations(filters)]
    weights = F.array(*[F.lit(math.factorial(s) * math.factorial(k - 1 - s)).cast("long") for s in range(k)])
    all_sets = F.sequence(F.lit(0), F.lit(full))

    def share(bit: int) -> Column:
        """Over all sets without the filter: its difference there, as often as orders have that set before it."""
        without = F.filter(all_sets, lambda s: s.bitwiseAND(F.lit(bit)) == 0)
        gone = lambda s: F.get("n", s) - F.get("n", s.bitwiseOR(F.lit(bit)))
        return F.aggregate(without, F.lit(0).cast("long"), lambda total, s: total + F.get(weights, F.bit_count(s)) * gone(s))

    shares = left.withColumn("shares_", F.array(*[share(1 << i) for i in range(k)]))
    steps = shares.withColumn("filter_order", F.explode(F.array(*[F.lit(o) for o in orders]))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k))))
    place = F.instr(F.lit(filters), F.substring("filter_order", F.col("step"), F.lit(1))) - 1
    before = sum((F.when(F.instr("filter_order", f) < F.col("step"), 1 << i).otherwise(0) for i, f in enumerate(filters)), F.lit(0))
    steps = steps.withColumn("place_", place).withColumn("before_", before).withColumn("bit_", F.element_at(F.array(*[F.lit(1 << i) for i in range(k)]), F.col("place_") + 1))
    after = F.col("before_").bitwiseOR(F.col("bit_"))
    gone = lambda m: F.get(m, F.col("before_")) - F.get(m, after)
    failing = F.get("n", F.lit(0)) - F.get("n", F.col("bit_"))
    only = F.get("n", F.lit(full).bitwiseXOR(F.col("bit_"))) - F.get("n", F.lit(full))
    return steps.select(
        "part", "filter_order", "step", F.get("n", after).alias("kept"), gone("n").alias("removed"), (failing - gone("n")).alias("redundant"),
        only.alias("unique_fails"), gone("good").alias("good_lost"), gone("toxic").alias("toxic_lost"), F.get("shares_", F.col("place_")).alias("shapley"),
    )


def audit(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """What each of the filters A to E does at each step of all 120 orders, a row for each part, order and step.

    Of docs doc_id, text and source are read, of marks doc_id, quality and toxic; other columns do no harm. Null and
    empty texts fail A; very long ones are judged whole. Rows that repeat count as often as they stand. A document has a mark if any
    row of its id in `marks` has it; one without id has none. An empty table has no parts and gives no rows.
    """
    return order_steps(survivors(mask_counts(masks(docs), marks), 5), "ABCDE")


def op11_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir), labels(spark, sf_dir))


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), f AS (
  SELECT doc_id, part, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t),
    regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS fails FROM d
), l AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), m AS (
  SELECT part, fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT filter_order, step::INTEGER AS step, filter_order[step] AS own,
    [strpos('ABCDE', y) FOR y IN string_split(substr(filter_order, 1, step - 1), '') IF y <> ''] AS before
  FROM orders, (SELECT unnest(range(1, 6)) AS step)
), judged AS (
  SELECT part, filter_order, step, own, n, good, toxic, fails[strpos('ABCDE', own)] AS fails_own,
    len(list_filter(before, lambda i: fails[i])) > 0 AS went, len(list_filter(fails, lambda x: x)) AS n_fails FROM m, steps
), counted AS (
  SELECT part, filter_order, step, own, sum(CASE WHEN NOT went AND NOT fails_own THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN NOT went AND fails_own THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN went AND fails_own THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN fails_own AND n_fails = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN NOT went AND fails_own THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN NOT went AND fails_own THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM judged GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM counted
"""
