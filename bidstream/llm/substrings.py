"""Exact substring dedup by a logarithmic family of sparse suffix indexes.

A full suffix array has an entry for each byte. This one is sparse: of each string of LENGTH bytes, the ANCHOR-byte
string in it that hashes lowest is its anchor, so equal strings have equal anchors at the same place, and one suffix
in about 160 is indexed, the one that starts at an anchor. Indexes order suffixes by a hash of their first
ANCHOR bytes; for matches that long, neighbours are the same as in lexicographic order. New batches of documents get
an index, are merge-scanned against the indexes of all levels for suffixes that agree so far, and indexes of equal
size are merged. What matches is then compared over the whole strings that the anchor stands for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bidstream.llm.common import bounded_batches, documents, stored, text_of
from bidstream.llm.neardup import _buffers, _mix, _powers

LENGTH, ANCHOR = 400, 80
WINDOW = LENGTH - ANCHOR + 1
#: A place is a position shifted by 2 * PLACE_BITS, then how far before the anchor its strings start, then their number less 1.
PLACE_BITS = 10
#: Bytes that are hashed at once.
SEGMENT = 1 << 19
#: Keys with more contexts than this are compared by a shuffle of hashes of pieces, not in one group, whatever the input's size; the
#: rows that come out are the same, as tests hold with either way for all keys.
MOST_CONTEXTS = 512
#: How many neighbouring strings a piece of a context has, round by round; each number divides the one before, and the last is 1.
PIECES = (36, 6, 1)

_BYTE = np.random.default_rng(4).integers(1, 1 << 63, 256, dtype=np.uint64)


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a polynomial, and the powers that move a piece of it to the front."""
    up, down = _powers(1 << max(16, len(data).bit_length()))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    return sums, down


def _hash(sums: np.ndarray, down: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return _mix((sums[ends] - sums[starts]) * down[starts])


def _anchored(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of strings with one anchor, in texts that lie at starts to ends of data.

    Arrays: the text's number, the anchor, the first and the last string's start, the anchor's key, the context's hash.
    """
    sums, down = _sums(data)
    n = len(data) - ANCHOR + 1
    key = _mix((sums[ANCHOR:] - sums[:n]) * down[:n])
    # high half of the hash, then the position: the least is the lowest, and of these the leftmost
    low = (key & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    width = 1
    while 2 * width <= WINDOW:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if WINDOW > width:
        low = np.minimum(low[: len(low) - (WINDOW - width)], low[WINDOW - width :])
    count = np.maximum(ends - starts - LENGTH + 1, 0)
    number = np.repeat(np.arange(len(starts)), count)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + starts[number]
    anchor = (low[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (number[1:] != number[:-1])))
    last = np.append(first[1:], len(at)) - 1
    anchor, a, b = anchor[first], at[first], at[last]
    shape = ((anchor - a) * LENGTH + (b - a)).astype(np.uint64)
    return number[first], anchor, a, b, key[anchor], _mix(_hash(sums, down, a, b + LENGTH) + shape)


_ENTRY = pa.schema([("doc_id", pa.int64()), ("th", pa.int64())] + [(c, pa.int64()) for c in ("key", "ctx", "place")])
_ENTRY_SQL = "doc_id long, th long, key long, ctx long, place long"


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held: list[tuple[int, int, np.ndarray]] = []

        def flush(batch=batch, held=held):
            ends = np.cumsum([len(d) for _, _, d in held])
            starts = ends - [len(d) for _, _, d in held]
            number, at, first, last, key, ctx = _anchored(np.concatenate([d for _, _, d in held]), starts, ends)
            row, shift = np.array([r for r, _, _ in held])[number], np.array([s for _, s, _ in held])[number] - starts[number]
            held.clear()
            place = (((at + shift) << PLACE_BITS | (at - first)) << PLACE_BITS) | (last - first)
            return pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(key.view(np.int64)), pa.array(ctx.view(np.int64)), pa.array(place),
            ], schema=_ENTRY)

        size = 0
        for row, text in enumerate(_buffers(batch.column(2))):
            data = np.frombuffer(text, dtype=np.uint8)
            for s in range(0, len(data) - LENGTH + 1, SEGMENT):
                held.append((row, s, data[s : s + SEGMENT + LENGTH - 1]))
                size += len(held[-1][2])
                if size >= SEGMENT:
                    yield flush()
                    size = 0
        if held:
            yield flush()


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, th and text as bytes; rows of one id are told apart by th, the text's hash."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("th"), text_of().cast("binary").alias("text"))


def suffix_entries(docs: DataFrame, batches: int) -> DataFrame:
    """The sparse suffixes of all texts: doc_id, th, key, ctx, place, and the batch that the document is in."""
    bounded_batches(docs.sparkSession)
    return _texts(docs).mapInArrow(_entries, _ENTRY_SQL).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int"))


def _at(place: Column) -> Column:
    return F.shiftright(place, 2 * PLACE_BITS)


def _low(place: Column) -> Column:
    """Where a place's strings start, counted from the anchor."""
    return -F.shiftright(place, PLACE_BITS).bitwiseAND(F.lit((1 << PLACE_BITS) - 1))


def _high(place: Column) -> Column:
    return _low(place) + place.bitwiseAND(F.lit((1 << PLACE_BITS) - 1))


def new_index(entries: DataFrame) -> DataFrame:
    """The index of a batch: its suffixes' keys in order, and how many suffixes have each."""
    return stored(entries.groupBy("key").agg(F.count("*").alias("n")).sortWithinPartitions("key"), "suffix-index")


def add_batch(levels: list[tuple[int, DataFrame]], entries: DataFrame, keep: bool = True) -> tuple[list[tuple[int, DataFrame]], DataFrame]:
    """The family with a further batch in it, and the keys that the batch has twice or shares with an earlier one.

    levels: (batches in it, index), the largest first. keep: whether more batches may come, so indexes are merged.
    """
    index = new_index(entries)
    found = index.where("n > 1").select("key")
    for _, level in levels:
        found = found.union(index.join(level, "key").select("key"))
    levels = [*levels, (1, index)]
    while keep and len(levels) > 1 and levels[-1][0] == levels[-2][0]:
        (size, a), (_, b) = levels[-2:]
        merged = a.union(b).groupBy("key").agg(F.sum("n").alias("n")).sortWithinPartitions("key")
        levels = [*levels[:-2], (2 * size, stored(merged, "suffix-index"))]
    return levels, found


_CONTEXT_SQL = "key long, ctx long, at long, text binary, many boolean"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of contexts: of a text and a list of (key, ctx, at, low, high, many)."""
    for batch in batches:
        out = []
        for text, wanted in zip(_buffers(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            text = memoryview(text)
            out += [(w["key"], w["ctx"], -w["low"], bytes(text[w["at"] + w["low"] : w["at"] + w["high"] + LENGTH]), w["many"]) for w in wanted]
        types = pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], names=["key", "ctx", "at", "text", "many"])


def _strings(text: bytes, at: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts, counted from the anchor, and hashes of a context's strings."""
    sums, down = _sums(np.frombuffer(text, dtype=np.uint8))
    starts = np.arange(len(text) - LENGTH + 1)
    return starts - at, _hash(sums, down, starts, starts + LENGTH)


_PIECE_SQL = "key long, ctx long, piece long, core long, whole long, low long, high long"


def _pieces(batches: Iterator[pa.RecordBatch], side: int, before: int) -> Iterator[pa.RecordBatch]:
    """Pieces of `side` strings of contexts, within the wanted ones of `before` strings, or all where none are named.

    core: the hash of the bytes that all strings of the piece have; whole: of all bytes that this context has of the piece.
    """
    for batch in batches:
        out = []
        for key, ctx, at, text, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            sums, down = _sums(np.frombuffer(text, dtype=np.uint8))
            # starts are counted from the first one that any string of this anchor can have
            first = WINDOW - 1 - at
            last = first + len(text) - LENGTH
            piece = np.arange(first // side, last // side + 1)
            if wanted is not None:
                piece = piece[np.isin(piece * side // before, wanted)]
            begin = piece * side
            low, high = np.maximum(begin, first), np.minimum(begin + side - 1, last)
            core = _hash(sums, down, begin + side - 1 - first, begin + LENGTH - first)
            whole = _mix(_hash(sums, down, low - first, high + LENGTH - first) + (low * LENGTH + high).astype(np.uint64))
            out.append((np.full(len(piece), key), np.full(len(piece), ctx), piece, core.view(np.int64), whole.view(np.int64), low - WINDOW + 1, high - WINDOW + 1))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["key", "ctx", "piece", "core", "whole", "low", "high"])


def shared_pieces(contexts: DataFrame) -> DataFrame:
    """(key, ctx, low, high): strings that another context of the key has too; a key may have any number of contexts.

    Contexts whose piece has the same bytes share all its strings. They are settled, and one of them stays for the others. Those that agree
    in the piece's core only may share some of its strings: they go on to smaller pieces. A context that agrees with none has
    no further row. So a context gives rows where what it shares begins and ends, and not one for each string.
    """
    wanted, found = None, []
    for side, before in zip(PIECES, (WINDOW, *PIECES), strict=False):
        held = contexts.withColumn("wanted", F.lit(None).cast("array<long>")) if wanted is None else contexts.join(wanted, ["key", "ctx"])
        pieces = held.select("key", "ctx", "at", "text", "wanted").mapInArrow(lambda b, side=side, before=before: _pieces(b, side, before), _PIECE_SQL)
        # rows of one id and text give the same contexts
        pieces = stored(pieces.dropDuplicates(["key", "ctx", "piece"]), "suffix-pieces")
        core, whole = ["key", "piece", "core"], ["key", "piece", "core", "whole"]
        classes = stored(pieces.groupBy(*whole).agg(F.count("*").alias("n"), F.min("ctx").alias("rep")), "suffix-classes")
        found.append(pieces.join(classes.where("n > 1").select(*whole), whole).select("key", "ctx", "low", "high"))
        open_ = classes.groupBy(*core).agg(F.count("*").alias("classes")).where("classes > 1")
        wanted = classes.join(open_, core).groupBy("key", F.col("rep").alias("ctx")).agg(F.collect_list("piece").alias("wanted"))
    return reduce(DataFrame.unionByName, found)


_RUNS = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; (key, ctx, runs) of the strings that another context of the key has too."""

    def group(rows: dict[int, tuple]) -> list[tuple]:
        each = [_strings(text, at) for _, _, at, text in rows.values()]
        start, h = np.concatenate([s for s, _ in each]), np.concatenate([x for _, x in each])
        of = np.repeat(np.arange(len(rows)), [len(s) for s, _ in each])
        order = np.lexsort((h, start))
        same = (start[order][1:] == start[order][:-1]) & (h[order][1:] == h[order][:-1])
        twice = np.zeros(len(h), dtype=bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        at = np.flatnonzero(twice)
        if not len(at):
            return []
        first = np.flatnonzero(np.append(True, (np.diff(at) > 1) | (np.diff(of[at]) > 0)))
        last = np.append(first[1:], len(at)) - 1
        found: dict[int, list] = {}
        for a, b in zip(at[first].tolist(), at[last].tolist(), strict=True):
            found.setdefault(int(of[a]), []).append({"low": int(start[a]), "high": int(start[b])})
        named = list(rows.values())
        return [(named[i][0], named[i][1], runs) for i, runs in found.items()]

    def made(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), _RUNS))], names=["key", "ctx", "runs"])

    key, held = None, {}
    for batch in batches:
        out: list[tuple] = []
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[0] != key:
                out += group(held) if len(held) > 1 else []
                key, held = row[0], {}
            held[row[1]] = row
        yield made(out)
    if len(held) > 1:
        yield made(group(held))


def repeated_strings(groups: DataFrame, texts: DataFrame) -> DataFrame:
    """(key, ctx, runs) for contexts that share some of their strings with another context of their key.

    groups: a row for each key and ctx of keys with several, with the place of one such context and variants, the
    contexts of the key.
    runs: where these strings start, counted from the anchor, from low to high.
    """
    place = F.col("rep.place")
    one = F.struct("key", "ctx", _at(place).alias("at"), _low(place).alias("low"), _high(place).alias("high"), (F.col("variants") > MOST_CONTEXTS).alias("many"))
    wanted = groups.groupBy("rep.doc_id", "rep.th").agg(F.collect_list(one).alias("wanted"))
    places = wanted.withColumnRenamed("doc_id", "id_").withColumnRenamed("th", "th_")
    # by merging at any size: what a small table would save by a broadcast is lost where it grows
    held = texts.join(places.hint("merge"), texts["doc_id"].eqNullSafe(F.col("id_")) & (texts["th"] == F.col("th_"))).select("text", "wanted")
    # the contexts' bytes are a table at any size, so that texts are read for them once and a key's rows may be split
    contexts = stored(held.mapInArrow(_cut, _CONTEXT_SQL), "suffix-contexts")
    runs = "array<struct<low: bigint, high: bigint>>"
    # dealt by key straight from the table: after a join by key Spark takes this repartition for needless and then may split a key among tasks
    few = contexts.where("not many").select("key", "ctx", "at", "text").repartition("key").sortWithinPartitions("key")
    out = few.mapInArrow(_repeated, f"key long, ctx long, runs {runs}")
    pieces = shared_pieces(contexts.where("many"))
    return out.unionByName(pieces.groupBy("key", "ctx").agg(F.collect_set(F.struct("low", "high")).cast(runs).alias("runs")))


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("spans", pa.string())])


def merged(spans: np.ndarray) -> np.ndarray:
    """Maximal runs of bytes, of spans (start, end) that may overlap or touch."""
    if len(spans) == 0:
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.flatnonzero(np.append(True, spans[1:, 0] > reach[:-1]))
    return np.column_stack([spans[new, 0], reach[np.append(new[1:], len(spans)) - 1]])


def _remove(batches: Iterator[pa.RecordBatch], digest: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, text, spans in zip(batch.column(0).to_pylist(), _buffers(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            text = memoryview(text)
            cuts = merged(np.array([(s["a"], s["b"]) for s in spans or []], dtype=np.int64).reshape(-1, 2))
            at, kept = 0, []
            for a, b in cuts.tolist():
                kept.append(text[at:a])
                at = b
            rest = b"".join([*kept, text[at:]])
            kept_ = hashlib.sha256(rest).hexdigest().encode() if digest else rest
            rows.append((doc_id, len(text), len(text) - len(rest), len(cuts), kept_, ",".join(f"{a}:{b}" for a, b in cuts.tolist())))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_RESULT)], schema=_RESULT)


def remove_repeats(docs: DataFrame, batches: int = 4, digest: bool = False) -> DataFrame:
    """A row for each row of `docs`: doc_id, n_bytes, n_removed, n_spans, kept, spans.

    Texts are UTF-8 bytes, null ones empty. A byte goes if a string of LENGTH bytes around it also starts at another
    place of the text, or anywhere in another row's text; repeated rows are texts of their own, so they go whole. kept
    has the bytes that stay, or their SHA-256 digest; spans has the removed runs of bytes as start:end, by commas. Null and repeated ids and other columns do no harm, and an empty
    table gives no rows. batches: the documents are added to the index family in so many parts.
    """
    entries = stored(suffix_entries(docs, batches), "suffix-entries", "batch")
    levels, keys = [], None
    for b in range(batches):
        levels, found = add_batch(levels, entries.where(F.col("batch") == b), keep=b < batches - 1)
        keys = found if keys is None else keys.union(found)
    # both sides of the joins below come straight from tables, so that Spark can split a hot key's rows
    keys = stored(keys.distinct(), "suffix-keys")
    matched = stored(entries.drop("batch").join(keys, "key", "left_semi"), "suffix-matched")
    groups = matched.groupBy("key", "ctx").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "th", "place")).alias("rep"))
    groups = stored(groups, "suffix-groups")
    # counted map-side; a key with a single context needs no row
    variants = stored(groups.groupBy("key").agg(F.count("*").alias("variants")).where("variants > 1"), "suffix-variants")
    shared = groups.join(variants, "key")
    texts = _texts(docs)
    # all strings of a context that occurs twice are repeated; of others, those that another context shares
    own = F.array(F.struct(_low(F.col("place")).alias("low"), _high(F.col("place")).alias("high")))
    whole = matched.join(groups.where("n > 1").select("key", "ctx"), ["key", "ctx"]).select("doc_id", "th", "place", own.alias("runs"))
    single = shared.where("n = 1").select("key", "ctx", "rep.*")
    partly = single.join(repeated_strings(shared, texts), ["key", "ctx"]).select("doc_id", "th", "place", "runs")
    spans = whole.union(partly).select("doc_id", "th", _at(F.col("place")).alias("at"), F.explode("runs").alias("r"))
    span = F.struct((F.col("at") + F.col("r.low")).alias("a"), (F.col("at") + F.col("r.high") + LENGTH).alias("b"))
    by_row = spans.select("doc_id", "th", span.alias("span")).groupBy("doc_id", "th").agg(F.collect_set("span").alias("spans"))  # repeated rows give the same spans
    by_row = by_row.withColumnRenamed("doc_id", "id_").withColumnRenamed("th", "th_")
    joined = texts.join(by_row.hint("merge"), texts["doc_id"].eqNullSafe(F.col("id_")) & (texts["th"] == F.col("th_")), "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(lambda x: _remove(x, digest), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans string")


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir), digest=True).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.col("kept").cast("string").alias("kept_sha256"), "spans",
        (F.col("n_bytes") - F.col("n_removed")).alias("n_kept"),
    )
