"""MinHash near-duplicates with sequential Bayesian verification.

Texts of one shingle set are one class, and the class's least doc_id stands for it. Signatures of classes are cut into
bands; classes that agree on a band are candidates. To stay linear in a bucket's size, each class is first paired
with its bucket's most central class only, the one with the largest buckets over all bands: of a text and its edited
copies, that is the text. Links found so join classes to components. Then buckets that still hold more than
one component are compared in blocks, across components, and links come out, no more than join a block's components.
A pair's signatures are compared batch by batch; it is dropped once the posterior probability of enough similarity is
below a chosen miss probability, and what survives is confirmed on the full shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bidstream.llm.common import bounded_batches, documents, fits, stored, text_of

SHINGLE = 5
#: Least similarity, in hundredths.
PERCENT = 75
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
#: Signatures are compared so many hashes at a time.
STEP = 16
#: Pairs whose ids number no more than this find their texts by broadcasting the ids: 16 MB at most.
MOST_BROADCAST = 1_000_000
#: Rows of a bucket that are compared with one another in one block.
CHUNK = 1024

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_RNG = np.random.default_rng(10)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_PLACE = _RNG.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)
_LOW = (_RNG.integers(1, 1 << 32, HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_HIGH = (_RNG.integers(1, 1 << 32, HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _BASE and of its inverse modulo 2 ** 64."""
    up, down = np.full(n, _BASE, dtype=np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def word_hashes(text: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words of a text given as bytes, A-Z in lower case."""
    word = ~_SPACE[text]
    edge = np.diff(np.concatenate(([0], word.view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _powers(1 << max(16, len(text).bit_length()))
    sums = np.zeros(len(text) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[text] * up[: len(text)], out=sums[1:])
    return _mix((sums[ends] - sums[starts]) * down[starts])


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the whole text's shingles; the whole sequence is one if it has few words."""
    words = word_hashes(np.frombuffer(text, dtype=np.uint8))
    n = len(words)
    if n == 0:
        return words
    width = min(n, SHINGLE)
    total = np.full(n - width + 1, width, dtype=np.uint64)
    for i in range(width):
        total += words[i : n - width + 1 + i] * _PLACE[i]
    total = np.sort(_mix(total))
    return total[np.append(True, total[1:] != total[:-1])]


def signature(shingles: np.ndarray) -> np.ndarray:
    low, high = shingles.astype(np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(low), 2048):
        values = _LOW[:, None] * low[None, i : i + 2048]
        values += _HIGH[:, None] * high[None, i : i + 2048]
        np.minimum(least, values.min(axis=1), out=least)
    return least


def _buffers(column) -> Iterator[bytes]:
    for x in column:
        yield x.as_buffer() if x.is_valid else b""


_PROFILE = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("sig", pa.binary())])


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, h1, h2, sigs = [], [], [], []
        for text in _buffers(batch.column(1)):
            s = shingle_set(text)
            n.append(len(s))
            h1.append(int(_mix(s * np.uint64(_BASE)).sum(dtype=np.uint64).astype(np.int64)))
            h2.append(int(_mix(s ^ np.uint64(_BASE)).sum(dtype=np.uint64).astype(np.int64)))
            sigs.append(signature(s).tobytes() if len(s) else None)
        columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sigs, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, schema=_PROFILE)


def profiles(docs: DataFrame) -> DataFrame:
    """doc_id, n (size of the shingle set), h1 and h2 (hash of the set), sig (null for an empty set)."""
    bounded_batches(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long"), text_of().cast("binary").alias("text")).mapInArrow(
        _profiles, "doc_id long, n long, h1 long, h2 long, sig binary"
    )


@lru_cache
def fewest_matches(miss: float) -> tuple[int, ...]:
    """For each number of compared hashes, the fewest that must agree.

    With an even prior, a pair with m of n hashes in common is similar enough with probability
    P(similarity >= t) = P(Binomial(n + 1, t) <= m); below `miss` it is dropped.
    """
    t, out = PERCENT / 100, []
    for n in range(HASHES + 1):
        total, m = 0.0, 0
        while True:
            total += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if total >= miss:
                break
            m += 1
        out.append(min(m, n))
    return tuple(out)


def _bayes(batches: Iterator[pa.RecordBatch], miss: float) -> Iterator[pa.RecordBatch]:
    least = fewest_matches(miss)
    for batch in batches:
        sides = [np.array([np.frombuffer(x.as_buffer(), dtype=np.uint32) for x in batch.column(i)]) for i in (4, 5)]
        alive, agreed = np.arange(batch.num_rows), np.zeros(batch.num_rows, dtype=int)
        for i in range(0, HASHES, STEP):
            if len(alive):
                agreed[alive] += (sides[0][alive, i : i + STEP] == sides[1][alive, i : i + STEP]).sum(axis=1)
                alive = alive[agreed[alive] >= least[i + STEP]]
        yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(alive)) for i in range(4)], names=["a", "ha", "b", "hb"])


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of texts whose full sets are similar enough."""
    for batch in batches:
        keep = []
        for i, (x, y) in enumerate(zip(_buffers(batch.column(2)), _buffers(batch.column(3)), strict=True)):
            x, y = shingle_set(x), shingle_set(y)
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * both >= PERCENT * (len(x) + len(y) - both):
                keep.append(i)
        yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(keep, pa.int64())) for i in (0, 1)], names=["a", "b"])


def _with_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h = [int(_mix(shingle_set(t) * np.uint64(_BASE)).sum(dtype=np.uint64).astype(np.int64)) for t in _buffers(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(h, pa.int64()), batch.column(1)], names=["v", "h", "text"])


def confirmed(pairs: DataFrame, reps: DataFrame, docs: DataFrame, miss: float) -> DataFrame:
    """Of pairs (a, b) of classes, those that are linked, in the shared folder."""
    side = lambda s: reps.select(F.col("v").alias(s), F.col("h1").alias(f"h{s}"), F.col("n").alias(f"n{s}"), F.col("sig").alias(f"sig{s}"))
    near = (
        pairs.join(side("a"), "a").join(side("b"), "b")
        .where(f"100 * least(na, nb) >= {PERCENT} * greatest(na, nb)").select("a", "ha", "b", "hb", "siga", "sigb")
        .mapInArrow(lambda batches: _bayes(batches, miss), "a long, ha long, b long, hb long")
    )
    near = stored(near, "near-survivors")
    texts = _texts_of(docs, near.select(F.explode(F.array("a", "b")).alias("doc_id"))).mapInArrow(_with_hash, "v long, h long, text binary")
    of = lambda s: texts.select(F.col("v").alias(s), F.col("h").alias(f"h{s}"), F.col("text").alias(f"text_{s}"))
    both = near.join(of("b"), ["b", "hb"]).join(of("a"), ["a", "ha"]).select("a", "b", "text_a", "text_b")
    return stored(both.mapInArrow(_exact, "a long, b long").distinct(), "near-links")


def components(links: DataFrame) -> DataFrame:
    """(v, c): for each node of the links (a, b), the least node that it is connected with.

    Each round takes the least label among the neighbours, then the label of that label, until nothing changes.
    """
    edges = stored(links.select("a", "b").union(links.select("b", "a")).toDF("v", "w").where("v != w").distinct(), "edges")
    labels = stored(edges.groupBy("v").agg(F.min("w").alias("c")).select("v", F.least("v", "c").alias("c")), "labels")
    while True:
        least = edges.join(labels.select(F.col("v").alias("w"), F.col("c").alias("near")), "w").groupBy("v").agg(F.min("near").alias("near"))
        lower = labels.join(least, "v").select("v", F.least("c", "near").alias("c"), F.col("c").alias("was"))
        jump = lower.select(F.col("v").alias("c"), F.col("c").alias("next"))
        new = stored(lower.join(jump, "c", "left").select("v", F.least("c", "next").alias("c"), "was"), "labels")
        labels = new.select("v", "c")
        if not new.where("c != was").limit(1).count():
            return labels


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[dict], list[dict]]]:
    """The two sides of each block, of rows that come sorted by (key, i, j); one list twice if a part meets itself."""
    held: list[dict] = []

    def sides() -> tuple[list[dict], list[dict]]:
        i, j = held[0]["i"], held[0]["j"]
        left = [r for r in held if r["part"] == i]
        return left, left if i == j else [r for r in held if r["part"] == j]

    for batch in batches:
        for row in batch.to_pylist():
            if held and any(held[0][k] != row[k] for k in ("key", "i", "j")):
                yield sides()
                held = []
            held.append(row)
    if held:
        yield sides()


_ROW = [("key", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("part", pa.int32()), ("v", pa.int64()), ("c", pa.int64()), ("n", pa.int64()), ("h1", pa.int64())]
_ROW_SQL = "key long, i int, j int, part int, v long, c long, n long, h1 long"


def _maybe(left: list[dict], right: list[dict]) -> np.ndarray:
    """Pairs of different components whose set sizes leave enough similarity possible."""
    pick = lambda side, k: np.array([r[k] for r in side])
    nx, ny = pick(left, "n")[:, None], pick(right, "n")[None, :]
    return (pick(left, "c")[:, None] != pick(right, "c")[None, :]) & (100 * np.minimum(nx, ny) >= PERCENT * np.maximum(nx, ny))


def _alive(batches: Iterator[pa.RecordBatch], miss: float) -> Iterator[pa.RecordBatch]:
    """Of blocks of rows with signatures, the rows that have a pair across components that is not given up.

    All pairs compare their first STEP hashes, and only those that go on compare the next.
    """
    least = fewest_matches(miss)
    for left, right in _blocks(batches):
        if not left or not right:
            continue
        x, y = (np.array([np.frombuffer(r["sig"], dtype=np.uint32) for r in side]) for side in (left, right))
        agreed = sum((x[:, h, None] == y[None, :, h]).astype(np.int16) for h in range(STEP))
        a, b = np.nonzero((agreed >= least[STEP]) & _maybe(left, right))
        agreed = agreed[a, b].astype(int)
        for h in range(STEP, HASHES, STEP):
            agreed += (x[a, h : h + STEP] == y[b, h : h + STEP]).sum(axis=1)
            on = agreed >= least[h + STEP]
            a, b, agreed = a[on], b[on], agreed[on]
        rows = {id(r): r for r in [left[k] for k in np.unique(a)] + [right[k] for k in np.unique(b)]}
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows.values()], t) for c, t in _ROW], names=[c for c, _ in _ROW])


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two sets share."""
    _, at = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    sizes = [len(s) for s in [*left, *right]]
    table = np.zeros((len(sizes), at.max(initial=0) + 1), dtype=np.float32)
    table[np.repeat(np.arange(len(sizes)), sizes), at] = 1
    return (table[: len(left)] @ table[len(left) :].T).astype(np.int64)


def _joining(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of blocks of rows with full sets, as many links as join the components that the block's rows link."""
    for left, right in _blocks(batches):
        parent: dict[int, int] = {}
        links = []

        def root(c, parent=parent):
            while parent.get(c, c) != c:
                c = parent[c]
            return c

        for i in range(0, len(left), 32):
            for j in range(0, len(right), 32):
                x, y = left[i : i + 32], right[j : j + 32]
                sets = [[np.frombuffer(r["shingles"], dtype=np.uint64) for r in side] for side in (x, y)]
                nx, ny, both = np.array([len(s) for s in sets[0]])[:, None], np.array([len(s) for s in sets[1]])[None, :], _common(*sets)
                for a, b in zip(*np.nonzero(_maybe(x, y) & (100 * both >= PERCENT * (nx + ny - both))), strict=True):
                    p, q = root(x[a]["c"]), root(y[b]["c"])
                    if p != q:
                        parent[p] = q
                        links.append((x[a]["v"], y[b]["v"]))
        yield pa.RecordBatch.from_arrays([pa.array([link[k] for link in links], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(t) for t in _buffers(batch.column(1))]
        h = [int(_mix(s * np.uint64(_BASE)).sum(dtype=np.uint64).astype(np.int64)) for s in sets]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(h, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["v", "h1", "shingles"])


def links_across(blocks: DataFrame, docs: DataFrame, miss: float) -> DataFrame:
    """Links (a, b) that join the components within blocks: (key, i, j, part, v, c, n, h1, sig).

    Rows without a pair that survives the signatures are left out; the others are compared on their full sets. A block
    gives no more links than it has components, whatever its size.
    """
    order = ("key", "i", "j")
    alive = blocks.repartition(*order).sortWithinPartitions(*order).mapInArrow(lambda x: _alive(x, miss), _ROW_SQL)
    alive = stored(alive, "near-alive")
    sets = _texts_of(docs, alive.select(F.col("v").alias("doc_id"))).mapInArrow(_shingled, "v long, h1 long, shingles binary").dropDuplicates(["v", "h1"])
    full = alive.join(sets, ["v", "h1"]).repartition(*order).sortWithinPartitions(*order)
    return stored(full.mapInArrow(_joining, "a long, b long").distinct(), "near-across")


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text as bytes) of the documents with these ids."""
    ids = ids.distinct()
    if fits(ids, MOST_BROADCAST):
        ids = F.broadcast(ids)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of().cast("binary").alias("text")).join(ids, "doc_id", "left_semi")


def near_duplicates(docs: DataFrame, miss: float = 1e-6) -> DataFrame:
    """A row for each row of `docs`: doc_id, n_shingles, component_id, kept.

    Documents of one doc_id are one node. Null, empty and blank texts have no shingles and are linked with nothing.
    A null doc_id is no node: its component_id is null and it is kept. Other columns are passed over, and an empty
    table gives no rows. miss: the probability at which a pair is given up unread.
    """
    found = stored(profiles(docs), "near-profiles")
    known = found.where("n > 0 and doc_id is not null")
    classes = stored(known.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("v")), "near-classes")
    reps = known.join(classes, ["h1", "h2", "n"]).where("doc_id = v").select("v", "h1", "h2", "n", "sig")
    reps = stored(reps.dropDuplicates(["v", "h1", "h2", "n"]), "near-reps")
    width = 4 * ROWS
    band = F.posexplode(F.array(*[F.substring("sig", i * width + 1, width) for i in range(BANDS)])).alias("band", "part")
    banded = reps.select("v", band).select("v", F.xxhash64("band", "part").alias("key"))
    buckets = banded.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    members = banded.join(buckets, "key")
    central = members.groupBy("v").agg(F.sum("m").alias("weight"))
    members = stored(members.join(central, "v"), "near-members")
    centres = members.groupBy("key").agg(F.max(F.struct("weight", (-F.col("v")).alias("minus"))).alias("top")).select("key", (-F.col("top.minus")).alias("centre"))
    stars = members.join(centres, "key").where("v != centre").select(F.least("centre", "v").alias("a"), F.greatest("centre", "v").alias("b")).distinct()
    links = confirmed(stars, reps, docs, miss)
    same_id = W.partitionBy("doc_id")
    ids = known.select("doc_id", "h1", "h2", "n").join(classes, ["h1", "h2", "n"]).select("doc_id", "v").distinct()
    ids = ids.withColumn("first", F.min("v").over(same_id)).where("v != first").select(F.col("first").alias("a"), F.col("v").alias("b"))
    links = links.union(ids)
    joined = components(links)

    grouped = members.select("key", "v", "m").join(joined, "v", "left").withColumn("c", F.coalesce("c", "v"))
    # rows of a bucket's largest component meet the bucket's other rows only, so a bucket costs its size times what is not joined yet
    counts = grouped.groupBy("key", "c").agg(F.count("*").alias("n_c"))
    mixed = counts.groupBy("key").agg(F.max(F.struct("n_c", "c")).alias("top"), F.sum("n_c").alias("all_c"), F.count("*").alias("cs")).where("cs > 1")
    mixed = mixed.select("key", F.col("top.c").alias("top_c"), *[
        F.ceil(n / CHUNK).cast("int").alias(name) for n, name in ((F.col("top.n_c"), "tops"), (F.col("all_c") - F.col("top.n_c"), "rests"))
    ])
    is_top, deal = F.col("c") == F.col("top_c"), lambda parts: F.pmod(F.xxhash64("v"), parts).cast("int")
    rest_parts, top_parts = F.sequence(F.lit(0), F.col("rests") - 1), F.sequence(F.col("rests"), F.col("rests") + F.col("tops") - 1)
    blocks = (
        grouped.join(stored(mixed, "near-mixed"), "key").join(reps.select("v", "n", "h1", "sig"), "v")
        .withColumn("part", F.when(is_top, F.col("rests") + deal(F.col("tops"))).otherwise(deal(F.col("rests"))))
        .withColumn("other", F.explode(F.when(is_top, rest_parts).otherwise(F.concat(rest_parts, top_parts))))
        .select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "v", "c", "n", "h1", "sig")
    )
    joined = components(links.union(links_across(blocks, docs, miss)))

    named = classes.join(joined, "v", "left").select("h1", "h2", "n", F.coalesce("c", "v").alias("component_id"))
    rows = found.select("doc_id", "n", "h1", "h2")
    linked = rows.where("n > 0 and doc_id is not null").join(named, ["h1", "h2", "n"])
    alone = rows.where("n = 0 or doc_id is null").withColumn("component_id", F.col("doc_id"))
    return linked.unionByName(alone).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def deduplicated_rows(docs: DataFrame, **options) -> DataFrame:
    """`docs` with one row of each group of rows whose texts are linked: of the least doc_id, and there with most shingles.

    A row goes only for a linked text or as a copy of its id and text; other texts of its id stay. Texts without
    shingles are linked with nothing; they go if their id has a text with some, and else one of them stays. All rows of no
    doc_id stay.
    """
    long_id = F.col("doc_id").cast("long")
    node = F.when(long_id.isNotNull(), F.xxhash64(long_id, text_of()))
    found = near_duplicates(docs.select(node.alias("doc_id"), "text"), **options).where("doc_id is not null")
    found = found.groupBy(F.col("doc_id").alias("node")).agg(F.first("n_shingles").alias("n"), F.first("component_id").alias("c"))
    ids = docs.where(long_id.isNotNull()).select(long_id.alias("id"), node.alias("node")).distinct()
    nodes = stored(ids.join(found, "node"), "near-nodes")
    order = F.struct("id", (-F.col("n")).alias("less"), "node")
    best = nodes.where("n > 0").groupBy("c").agg(F.min(order).alias("best"), F.count("*").alias("m")).where("m > 1")
    copies = nodes.where("n > 0").join(best, "c").where("node != best.node").select("node")
    blank = nodes.where("n = 0")
    full = nodes.where("n > 0").select("id").distinct().withColumn("full", F.lit(True))
    first = blank.groupBy("id").agg(F.min("node").alias("first"))
    blanks = blank.join(first, "id").join(full, "id", "left").where("full or node != first").select("node")
    one = W.partitionBy("part").orderBy("part")
    # the row is kept whole beside the names that are used here, which it may have as well
    whole = F.struct(*[F.col(c) for c in docs.columns]).alias("row")
    rows = docs.select(node.alias("node"), F.coalesce(node, F.xxhash64(text_of())).alias("part"), whole)
    rows = rows.join(copies.union(blanks), "node", "left_anti").withColumn("nth", F.row_number().over(one))
    return rows.where("nth = 1 or node is null").select("row.*")


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
