"""Document fingerprints: a homomorphic hash of the multiset of a text's paragraphs.

A paragraph hashes to a wide vector, and a text's vector is the sum of its paragraphs' vectors, lane by lane, modulo
a power of two. So the order of paragraphs does not matter, and to insert or delete a paragraph adds or subtracts
its vector. An edited text's vector is worked out in this way: what its unchanged paragraphs sum to is taken over, and only
the paragraphs that the edit reaches are hashed. The vector has two parts. EQUAL_LANES lanes come from a SHA-512 digest of the whole paragraph and decide
equality. LIKE_LANES lanes are sums of +1 and -1 over the paragraph's word triples; as the squared length of a
difference of two such sums estimates how many triples differ, they tell likeness.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bidstream.llm.common import documents, text_of

EQUAL_LANES, EQUAL_BITS = 8, 32
LIKE_LANES, LIKE_BITS = 128, 24
#: Two 32-bit counters in a long.
PAIR = 0x0000000100000001


def equality_lanes(text: Column) -> Column:
    """Sums over the paragraphs, as an array of longs below 2 ** EQUAL_BITS."""
    digits = EQUAL_BITS // 4
    lanes = lambda p: F.transform(
        F.sequence(F.lit(0), F.lit(EQUAL_LANES - 1)),
        lambda i: F.conv(F.substr(F.sha2(p, 512), i * digits + 1, F.lit(digits)), 16, 10).cast("long"),
    )
    zero = F.array_repeat(F.lit(0).cast("long"), EQUAL_LANES)
    paragraphs = F.filter(F.split(text, "\n"), lambda p: p != "")
    return F.aggregate(paragraphs, zero, lambda s, p: F.zip_with(s, lanes(p), lambda a, b: F.pmod(a + b, F.lit(1 << EQUAL_BITS))))


def triple_hashes(text: Column) -> Column:
    """A hash for each three words that stand together in a paragraph; near its end, for the words left."""
    words_of = lambda p: F.filter(F.split(p, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashed = lambda words: F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    return F.flatten(F.transform(F.transform(F.split(text, "\n"), words_of), hashed))


def added(a: Column, b: Column, sign: int = 1) -> Column:
    """The vector (equal, like) of a text with the paragraphs of two vectors; with sign -1, of the first's less the second's."""
    half = 1 << (LIKE_BITS - 1)
    lanes = lambda k, least, width: F.zip_with(a[k], b[k], lambda x, y: F.pmod(x + sign * y - least, F.lit(width)) + least)
    return F.struct(lanes("equal", 0, 1 << EQUAL_BITS).alias("equal"), lanes("like", -half, 2 * half).alias("like"))


def removed(a: Column, b: Column) -> Column:
    """The vector of a text without the paragraphs of another vector."""
    return added(a, b, -1)


def _place_among(column: Column, bounds: list[int], width: int = 64) -> Column:
    """How many of the sorted bounds are at most the column's value, looked up in two steps."""
    if not bounds:
        return F.lit(0)
    chunks = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    at_most = lambda x: F.size(F.filter(x, lambda b: b <= column))
    longs = lambda x: F.array(*[F.lit(v).cast("long") for v in x])
    top = at_most(longs([c[0] for c in chunks]))
    return F.when(top == 0, F.lit(0)).otherwise((top - 1) * width + at_most(F.get(F.array(*map(longs, chunks)), top - 1)))


def with_neighbours(docs: DataFrame, rows_a_block: int = 2048, most_blocks: int = 4096) -> DataFrame:
    """Rows (block, ghost, doc_id, text, th) so that each block holds whole chains, in order of ghost, falling doc_id and th.

    The last document of a block needs the first of the next one; that document is in the block too, as a ghost.
    Blocks lie between quantiles of the ids, so outlying or clustered ids leave none much larger than others; rows of no id
    come last, in order of a hash of their text, th, and lie in blocks by ranges of that. There are at most 2 * most_blocks
    + 1 blocks, so the table of their first documents may be broadcast.
    """
    n, nulls = docs.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    cuts = max(0, min(most_blocks, (n - nulls) // rows_a_block) - 1)
    bounds: list[int] = []
    if cuts:
        shares = [(i + 1) / (cuts + 1) for i in range(cuts)]
        bounds = sorted(set(docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), shares, 10 * most_blocks)).first()[0]))
    parts = max(1, min(most_blocks, nulls // rows_a_block))
    th = F.when(F.col("doc_id").isNull(), F.xxhash64("text"))
    # blocks rise as ids fall
    part = F.least(F.lit(parts - 1), F.floor((F.col("th").cast("double") / 2.0**64 + 0.5) * parts)).cast("int")
    block = F.when(F.col("doc_id").isNull(), len(bounds) + 1 + part).otherwise(len(bounds) - _place_among(F.col("doc_id").cast("long"), bounds))
    rows = (
        docs.select("doc_id", text_of().alias("text")).withColumn("th", th)
        .select(block.alias("block"), F.lit(False).alias("ghost"), "doc_id", "text", "th")
    )
    in_order = W.partitionBy(F.lit(0)).orderBy("block")
    firsts = rows.groupBy("block").agg(F.max("doc_id").alias("id_"), F.min("th").alias("th_"))
    of = lambda c: F.coalesce(F.lag(c).over(in_order), F.last(c).over(in_order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    firsts = firsts.select(F.col("block").alias("in_"), of("block").alias("to_"), "id_", "th_")
    same = (rows["block"] == F.col("in_")) & F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("doc_id").isNotNull() | (F.col("th") == F.col("th_")))
    ghosts = rows.join(F.broadcast(firsts), same).select(F.col("to_").alias("block"), F.lit(True).alias("ghost"), "doc_id", "text", "th")
    return rows.unionByName(ghosts)


def _hex(lanes: Column, digits: int) -> Column:
    return F.array_join(F.transform(lanes, lambda x: F.lpad(F.lower(F.hex(x)), digits, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """2 <a, b> / (|a|² + |b|²) of two arrays of signed lanes, in 0 to 1; 1 for two empty texts."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: (p * q).cast("double")), F.lit(0.0), lambda s, v: s + v)
    both = dot(a, a) + dot(b, b)
    return F.when(both == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * dot(a, b) / both)))


def _parts(rows: DataFrame) -> DataFrame:
    """Three rows for each: the paragraphs that an edit leaves alone (0), the text's others (1) and the edited text's others (2).

    rows: block, pos, ghost, doc_id, text and next, the next document's text; a ghost is not edited.
    """
    third = F.floor(F.length("text") / 3).cast("int")
    stays = F.substr("text", F.lit(1), F.length("text") - third)
    edited = F.concat(stays, F.substr(F.coalesce("next", F.lit("")), F.lit(1), third))
    whole = (F.length(stays) - F.length(F.substring_index(stays, "\n", -1))).alias("whole")
    rows = rows.select("block", "pos", "ghost", "doc_id", "text", edited.alias("edited"), whole)
    rest = lambda t: F.substr(t, F.col("whole") + 1)
    part = lambda i, t: F.struct(F.lit(i).alias("part"), t.alias("t"))
    both = [part(0, F.substr("text", F.lit(1), F.col("whole"))), part(1, rest(F.col("text")))]
    parts = F.when(F.col("ghost"), F.array(*both)).otherwise(F.array(*both, part(2, rest(F.col("edited")))))
    return rows.select(
        "block", "pos", "ghost", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("sha"), parts.alias("parts")
    ).withColumn("x", F.explode("parts")).select("block", "pos", "ghost", "doc_id", "n_chars", "sha", "x.part", F.col("x.t").alias("t"))


def text_vectors(parts: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each of `parts`: its keys, which tell rows apart, and v, the vector (equal, like) of its text t."""
    # in a step of its own: what stands beside an explode is worked out anew for each row that it makes
    hashed = parts.select(*keys, equality_lanes(F.col("t")).alias("equal"), triple_hashes(F.col("t")).alias("hashes"))
    rows = hashed.withColumn("h", F.explode_outer("hashes")).drop("hashes").withColumn("h2", F.when(F.col("h").isNotNull(), F.xxhash64("h")))
    counters = LIKE_LANES // 2
    bits = lambda i: F.shiftrightunsigned(F.col("h") if i < 32 else F.col("h2"), i % 32).bitwiseAND(F.lit(PAIR))
    summed = rows.groupBy(*keys, "equal").agg(
        F.count("h").alias("n"), *[F.coalesce(F.sum(bits(i)), F.lit(0)).cast("long").alias(f"c{i}") for i in range(counters)]
    )
    low = lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF))
    # bits set minus bits clear, of the lower and the upper counters
    lanes = F.flatten(F.transform(F.array(*[f"c{i}" for i in range(counters)]), lambda c: F.array(
        2 * low(c) - F.col("n"), 2 * F.shiftrightunsigned(c, 32) - F.col("n")
    )))
    half = 1 << (LIKE_BITS - 1)
    like = F.transform(lanes, lambda x: F.pmod(x + half, F.lit(2 * half)) - half)
    return summed.select(*keys, F.struct("equal", like.alias("like")).alias("v"))


def _printed(vector: Column) -> Column:
    like = F.transform(vector["like"], lambda x: F.pmod(x, F.lit(1 << LIKE_BITS)))
    return F.concat(_hex(vector["equal"], EQUAL_BITS // 4), _hex(like, LIKE_BITS // 4))


def fingerprints(docs: DataFrame) -> DataFrame:
    """A row for each row of `docs`: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last third replaced by the start of the next document, in falling order of doc_id; after
    the last comes the first. Null texts are empty, null ids come last, in order of a hash of their texts, repeated ids stand
    in order of their texts, other columns are passed over; an empty table gives no rows, and a single row is its own next.
    """
    order = [F.col("ghost"), F.col("doc_id").desc_nulls_last(), F.col("th"), F.col("text")]
    chain = W.partitionBy("block").orderBy(*order)
    rows = with_neighbours(docs).withColumn("pos", F.row_number().over(chain)).withColumn("next", F.lead("text").over(chain))
    keys = ["block", "pos", "ghost", "doc_id", "n_chars", "sha"]
    parts = text_vectors(_parts(rows), [*keys, "part"]).groupBy(*keys).agg(
        *[F.first(F.when(F.col("part") == i, F.col("v")), ignorenulls=True).alias(f"v{i}") for i in range(3)]  # one row each
    )
    vectors = parts.select(*keys, added(F.col("v0"), F.col("v1")).alias("v"), added(F.col("v0"), F.col("v2")).alias("e"))
    steps = W.partitionBy("block").orderBy("pos")
    return vectors.withColumn("next_like", F.lead("v.like").over(steps)).where("not ghost").select(
        "doc_id", "n_chars", F.col("sha").alias("edited_sha256"), _printed(F.col("v")).alias("fingerprint"), _printed(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("v.like"), F.col("e.like")).alias("near_edited"), likeness(F.col("v.like"), F.col("next_like")).alias("near_next"),
    )


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))
