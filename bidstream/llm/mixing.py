"""Mixing sources to target weights by pivotal dependent rounding.

A document's fractional copies are its source's target over its source's size. The whole part is certain; the
fractions are rounded in pairs. A pair shifts words from one document to the other until one of the two has no
fraction left, in a direction drawn so that each expected count stays. What stays open is paired again, in
buckets of bounded size that form a reduction tree. One document of a source is left at its root and goes to the nearer
side, so a source takes its target but for half a document's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bidstream.llm.common import NOT_SPACE, documents, stored, text_of

#: Fractions nearer to a whole number than this count as whole.
WHOLE = 1e-12

_ITEM = "struct<ord: bigint, doc_id: bigint, key: bigint, size: bigint, p: double>"

#: Folds a bucket's documents, in order: cur is the one that is still open, done has the others with up = 0 or 1.
_FOLD = f"""
aggregate(
  items,
  named_struct('cur', cast(null as {_ITEM}), 'done', cast(array() as array<struct<item: {_ITEM}, up: int>>)),
  (acc, x) -> case when acc.cur is null then named_struct('cur', x, 'done', acc.done) else
    element_at(transform(transform(
      array(named_struct(
        'x', x, 'mass', acc.cur.size * acc.cur.p + x.size * x.p,
        'down', least(acc.cur.size * acc.cur.p, x.size * (1 - x.p)),
        'up', least(acc.cur.size * (1 - acc.cur.p), x.size * x.p),
        'u', pmod(xxhash64(acc.cur.ord, x.ord, {{level}}), 1000003) / 1000003D
      )),
      s -> named_struct('x', s.x, 'mass', s.mass, 'gain', s.u * (s.up + s.down) < s.down)),
      s -> case
        when (s.gain and acc.cur.size * (1 - acc.cur.p) <= x.size * x.p)
          or (not s.gain and acc.cur.size * acc.cur.p <= x.size * (1 - x.p))
        then named_struct(
          'cur', named_struct('ord', x.ord, 'doc_id', x.doc_id, 'key', x.key, 'size', x.size,
            'p', greatest(0D, least(1D, (s.mass - if(s.gain, acc.cur.size, 0)) / x.size))),
          'done', concat(acc.done, array(named_struct('item', acc.cur, 'up', int(s.gain)))))
        else named_struct(
          'cur', named_struct('ord', acc.cur.ord, 'doc_id', acc.cur.doc_id, 'key', acc.cur.key, 'size', acc.cur.size,
            'p', greatest(0D, least(1D, (s.mass - if(s.gain, 0, x.size)) / acc.cur.size))),
          'done', concat(acc.done, array(named_struct('item', x, 'up', int(not s.gain)))))
      end), 1)
  end)
"""


def source_targets(sized: DataFrame, share: float, weights: tuple[float, ...], cap: float) -> DataFrame:
    """One row per source: source, source_size, n, target.

    Targets fill up by weight until each is at most `cap` times its source's size: with the sources in order of
    cap over weight, the common level is the largest of those that each prefix of full sources leaves to the rest.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    by_name, by_cap = W.orderBy(F.col("source").asc_nulls_last()), W.orderBy("at", "rank")
    before, after = by_cap.rowsBetween(W.unboundedPreceding, -1), by_cap.rowsBetween(0, W.unboundedFollowing)
    everyone = W.partitionBy(F.lit(0))
    return (
        sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
        .withColumn("rank", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.element_at(cycle, F.col("rank") % len(weights) + 1))
        .withColumn("full", cap * F.col("source_size"))
        .withColumn("at", F.col("full") / F.col("weight"))
        .withColumn("total", share * F.sum("source_size").over(everyone))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / F.sum("weight").over(after))
        .withColumn("level", F.max("level").over(everyone))
        .select("source", "source_size", "n", F.least("full", F.col("weight") * F.col("level")).alias("target"))
    )


def mix(
    docs: DataFrame, share: float = 1.5, weights: tuple[float, ...] = (5, 2, 1), cap: float = 2.0, fan_in: int = 128, seed: int = 8,
) -> DataFrame:
    """A row for each row of `docs`: doc_id, source, key, size, source_size, target, copies, taken.

    docs: doc_id, text, source; more columns do no harm. A null text has size 0, as has an empty one, and 0 copies
    of it are taken; a null source is a source of its own, the last; null and repeated ids and repeated rows are
    rows like others; an empty table gives no rows. key: a hash of the text, which tells rows of one doc_id apart.
    fan_in: documents, or open rests of buckets, that meet in one fold on average.
    """
    size = F.size(F.filter(F.split(text_of(), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")
    sized = stored(docs.select("doc_id", "source", F.xxhash64("text").alias("key"), size.alias("size")), "mix-sizes")
    targets = source_targets(sized, share, weights, cap)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copy = W.partitionBy("doc_id", "key", "source").orderBy("size")
    rows = (
        sized.withColumn("copy", F.row_number().over(copy))
        .join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
        .withColumn("ratio", ratio)
        .withColumn("base", F.floor(F.col("ratio") + WHOLE))
        .withColumn("p", F.greatest(F.lit(0.0), F.col("ratio") - F.col("base")))
        .withColumn("ord", F.xxhash64("doc_id", "key", "copy", F.lit(seed)))
    )
    open_rows = (F.col("p") > WHOLE) & (F.col("size") > 0)
    keep = ["source", "source_size", "target", "base"]
    settled = rows.where(~open_rows).select(*keep, "doc_id", "key", "size", F.lit(0).alias("up"))
    item = F.struct("ord", "doc_id", "key", "size", "p").alias("item")
    level_rows = rows.where(open_rows).select(
        *keep, F.greatest(F.lit(1), F.ceil(F.col("n") / fan_in)).cast("long").alias("buckets"), item
    ).withColumn("bucket", F.pmod(F.col("item.ord"), F.col("buckets")))
    largest = targets.agg(F.max("n")).first()[0] or 0
    buckets, level, out = -(-largest // fan_in), 0, settled
    while True:
        folded = stored(
            level_rows.groupBy(*keep, "buckets", "bucket").agg(F.sort_array(F.collect_list("item")).alias("items"))
            .select(*keep, "buckets", "bucket", F.expr(_FOLD.format(level=level)).alias("state")),
            f"mix-level{level}",
        )
        done = folded.select(*keep, F.explode("state.done").alias("d"))
        out = out.unionByName(done.select(*keep, "d.item.doc_id", "d.item.key", "d.item.size", "d.up"))
        if buckets <= 1:
            break
        buckets, level = -(-buckets // fan_in), level + 1
        level_rows = folded.select(
            *keep, F.ceil(F.col("buckets") / fan_in).cast("long").alias("buckets"), F.col("state.cur").alias("item"),
            F.floor(F.col("bucket") / fan_in).cast("long").alias("bucket"),
        )
    last = folded.select(*keep, F.col("state.cur").alias("c"))
    # one document of a source is left over; it goes to the nearer side
    out = out.unionByName(last.select(*keep, "c.doc_id", "c.key", "c.size", (F.col("c.p") >= 0.5).cast("int").alias("up")))
    copies = F.when(F.col("size") > 0, F.col("base") + F.col("up")).otherwise(F.lit(0)).cast("long")
    return out.select(
        "doc_id", "source", "key", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: rows of `docs`, each as often as it was taken; rows of one id and text count together."""
    taken = mix(docs, **options).groupBy("doc_id", "key").agg(F.sum("copies").cast("int").alias("copies")).where("copies > 0")
    one = W.partitionBy("id", "key").orderBy("key")
    # the row is kept whole beside the names that are used here, which it may have as well
    whole = F.struct(*[F.col(c) for c in docs.columns]).alias("row")
    rows = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("key"), whole).withColumn("nth", F.row_number().over(one)).where("nth = 1")
    joined = rows.join(
        taken.select(F.col("doc_id").alias("id_"), F.col("key").alias("key_"), "copies"),
        F.col("id").eqNullSafe(F.col("id_")) & F.col("key").eqNullSafe(F.col("key_")),
    )
    return joined.withColumn("again", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")
