"""Passages that repeat across documents, found by recompression.

A text is a sequence of names, at first one for each word. A round names what stands side by side: a run of equal names
becomes one name, made of the name and the run's length; then names are parted into left and right ones by a bit of
their hash, and each left one with a right one after it becomes one name, made of both. A name is a hash of what it is made
of, so it is global: every task of every run gives the same name to the same words with no exchange of names. After the
rounds a name stands for a few words, and equal passages have equal names inside, whatever stands around them.

How far inside is known exactly: with each name goes the stretch of words that the rounds looked at to make it. A window of
words that holds the stretch has that name at that place, in whatever document it stands. Of the names that a window
holds so, the one that hashes lowest stands for it (a window that holds none, as in a long run, stands for itself). So equal
windows have one name in common, at one place in them, and windows of neighbouring places mostly share theirs: those of one
name at one place are a context, and an index of contexts has an entry for a dozen words. Its key is the name with its whole
stretch, which is as rare as a phrase of that length. Keys of one document only go. Equal contexts are equal window by
window; contexts that differ are compared by all their windows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bidstream.llm.common import bounded_batches, documents, stored, text_of
from bidstream.llm.neardup import _buffers, _mix, _powers
from bidstream.llm.substrings import merged

WORDS = 50
#: Rounds of naming; a name then stands for about (4 / 3) ** ROUNDS words. Windows are found whatever it is.
ROUNDS = 4
#: Words that are named at once, and bytes that are hashed at once.
SEGMENT, PIECE = 1 << 16, 1 << 18
LAST = (1 << 63) - 1
PLACE_BITS = 10

_RNG = np.random.default_rng(13)
_BYTE, _BYTE2 = (_RNG.integers(1, 1 << 63, 256, dtype=np.uint64) for _ in range(2))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_RUN, _PAIR, _WINDOW = (np.uint64(x) for x in _RNG.integers(1, 1 << 63, 3, dtype=np.uint64) | np.uint64(1))


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where a text's words start in its bytes, and two independent hashes of each; read in pieces that end at white space."""
    pieces, at = [], 0
    while at < len(text):
        end = _GAP.search(text, at + PIECE)
        end = end.end() if end else len(text)
        data = np.frombuffer(text, dtype=np.uint8, count=end - at, offset=at)
        edge = np.diff(np.concatenate(([0], (~_SPACE[data]).view(np.int8), [0])))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        up, down = _powers(1 << max(16, len(data).bit_length()))
        sums, hashes = np.zeros(len(data) + 1, dtype=np.uint64), []
        for table in (_BYTE, _BYTE2):
            np.cumsum(table[data] * up[: len(data)], out=sums[1:])
            hashes.append(_mix((sums[ends] - sums[starts]) * down[starts]))
        pieces.append((starts + at, *hashes))
        at = end
    return tuple(np.concatenate([p[i] for p in pieces]) if pieces else np.zeros(0, dtype=t) for i, t in enumerate((np.int64, np.uint64, np.uint64)))


def batch_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of all words of a batch, text after text, and the number of the first word of each text, and of all words."""
    starts, h1, h2 = word_hashes(b" ".join(texts))
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return h1, h2, np.searchsorted(starts, begins)


def compressed(names: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(name, place, left, right): the names after all rounds, the word where each begins, and the stretch that made it.

    A stretch that reaches beyond the first or the last word, where what stands there was looked at, is that of no window.
    """
    n = len(names)
    first, left, right = np.arange(n), np.arange(n), np.arange(n) + 1
    for r in range(rounds):
        # a run of equal names; that it ends is seen at the neighbours
        at = np.flatnonzero(np.append(True, names[1:] != names[:-1]))
        end = np.append(at[1:], len(names))
        left, right = np.append(-1, left)[at], np.append(right, n + 1)[end]
        names, first, length = names[at], first[at], (end - at).astype(np.uint64)
        names = np.where(length > 1, _mix(names * _RUN + length), names)
        # a left name and a right one after it; which side a name is on changes with the round
        is_left = (_mix(names + np.uint64(r)) >> np.uint64(63)).astype(bool)
        pair = np.append(is_left[:-1] & ~is_left[1:], False)
        second = np.append(False, pair[:-1])
        # a left name that stays has seen the name after it, a right one that stays the name before it
        before, after, following = np.append(-1, left)[:-1], np.append(right, n + 1)[1:], np.append(names[1:], names[:1])
        left, right = np.where(pair | is_left, left, before), np.where(pair | is_left, after, right)
        names = np.where(pair, _mix(names * _PAIR + _mix(following)), names)
        names, first, left, right = (x[~second] for x in (names, first, left, right))
    return names, first, left, right


def _lowest(value: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of value[low : high] for each pair, where low < high."""
    levels, width = [value], 1
    most = int((high - low).max(initial=1))
    while 2 * width <= most:
        levels.append(np.minimum(levels[-1][:-width], levels[-1][width:]))
        width *= 2
    level = np.frexp((high - low).astype(np.float64))[1] - 1
    out = np.empty(len(low), dtype=value.dtype)
    for k, table in enumerate(levels):
        here = level == k
        out[here] = np.minimum(table[low[here]], table[high[here] - (1 << k)])
    return out


def _sums(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers(1 << max(16, len(h).bit_length()))
    sums = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * up[: len(h)], out=sums[1:])
    return sums, down


def _stretch(sums: np.ndarray, down: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def contexts(h1: np.ndarray, h2: np.ndarray, start: np.ndarray, width: int, rounds: int = ROUNDS) -> tuple[np.ndarray, ...]:
    """(key, ctx, first, back, more): runs of the windows that begin at `start`, in order, that one name stands for.

    The name with the stretch that made it, a hash of the words from the first window's start to the last one's end, that start, how
    far after it the name begins, and how many windows follow. Names that were made across the ends of texts are in no window of one text.
    """
    name, place, left, right = compressed(h1, rounds)
    # stretches never go back from one name to the next, so a window holds a range of names
    low, high = np.searchsorted(left, start, "left"), np.searchsorted(right, start + width, "right")
    held = np.flatnonzero(low < high)
    value = (_mix(name) & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(name), dtype=np.uint64)
    pick = np.full(len(start), -1)
    if len(held):
        pick[held] = (_lowest(value, low[held], high[held]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    at = np.flatnonzero(np.append(True, (pick[1:] != pick[:-1]) | (pick[1:] < 0) | (np.diff(start) > 1)))
    first, last, pick = start[at], start[np.append(at[1:], len(start)) - 1], pick[at]
    own = pick < 0
    sums, down = _sums(h1)
    # a name is as rare as all that it was made by looking at, which each of its windows holds
    begin, end = np.where(own, first, left[pick]), np.where(own, first + width, right[pick])
    key = _mix(_stretch(sums, down, begin, end) * _WINDOW + np.where(own, 0, name[pick]))
    back, more = np.where(own, 0, place[pick] - first), last - first
    sums, down = _sums(h2)
    return key, _mix(_stretch(sums, down, first, last + width) + (back << PLACE_BITS | more).astype(np.uint64)), first, back, more


_ENTRY_SQL = "ord long, th long, key long, ctx long, place long"


def _entries(batches: Iterator[pa.RecordBatch], width: int, rounds: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h1, h2, begins = batch_hashes(list(_buffers(batch.column(2))))
        whole = np.diff(begins) >= width
        # +1 where a text's windows begin and -1 after its last
        edge = np.zeros(len(h1) + 1, dtype=np.int64)
        np.add.at(edge, begins[:-1][whole], 1)
        np.add.at(edge, begins[1:][whole] - width + 1, -1)
        starts = np.flatnonzero(np.cumsum(edge))
        for s in range(0, len(h1), SEGMENT):
            part = starts[np.searchsorted(starts, s) : np.searchsorted(starts, s + SEGMENT)]
            if not len(part):
                continue
            held = slice(s, s + SEGMENT + width - 1)
            key, ctx, first, back, more = contexts(h1[held], h2[held], part - s, width, rounds)
            row = np.searchsorted(begins, first + s, "right") - 1
            place = ((first + s - begins[row] + back) << PLACE_BITS | back) << PLACE_BITS | more
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(key.view(np.int64)), pa.array(ctx.view(np.int64)), pa.array(place)],
                names=["ord", "th", "key", "ctx", "place"],
            )


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, ord, the id with null last, th, which tells texts of one id apart, and text as bytes."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("ord"), F.xxhash64(text_of()).alias("th"), text_of().cast("binary").alias("text"))


def _start(place: Column) -> Column:
    """The word where a context's first window starts."""
    return F.shiftright(place, 2 * PLACE_BITS) - F.shiftright(place, PLACE_BITS).bitwiseAND(F.lit((1 << PLACE_BITS) - 1))


def _more(place: Column) -> Column:
    return place.bitwiseAND(F.lit((1 << PLACE_BITS) - 1))


def _window_hashes(h: np.ndarray, start: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the windows at `start`, which rises."""
    out = np.empty(len(start), dtype=np.uint64)
    for s in range(0, len(h), SEGMENT):
        at = slice(np.searchsorted(start, s), np.searchsorted(start, s + SEGMENT))
        if at.stop > at.start:
            sums, down = _sums(h[s : s + SEGMENT + width - 1])
            out[at] = _stretch(sums, down, start[at] - s, start[at] - s + width)
    return out.view(np.int64)


def _windows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(key, ctx, ord, shift, h1, h2) of each window of the contexts wanted of a text; shift is its start from the name's place on."""
    for batch in batches:
        h1, h2, begins = batch_hashes(list(_buffers(batch.column(1))))
        wanted = batch.column(2)
        key, ctx, place = (wanted.flatten().field(c).to_numpy() for c in range(3))
        row = np.repeat(np.arange(batch.num_rows), wanted.value_lengths().to_numpy())
        at, back, more = place >> 2 * PLACE_BITS, place >> PLACE_BITS & (1 << PLACE_BITS) - 1, place & (1 << PLACE_BITS) - 1
        of = np.repeat(np.arange(len(key)), more + 1)
        shift = np.arange(len(of)) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1) - back[of]
        start = begins[row[of]] + at[of] + shift
        order = np.argsort(start, kind="stable")
        of, shift, start = of[order], shift[order], start[order]
        one, two = (_window_hashes(h, start, width) for h in (h1, h2))
        for i in range(0, len(of), SEGMENT):
            p = slice(i, i + SEGMENT)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[of[p]]), pa.array(ctx[of[p]]), batch.column(0).take(pa.array(row[of[p]])), pa.array(shift[p]), pa.array(one[p]), pa.array(two[p])],
                names=["key", "ctx", "ord", "shift", "h1", "h2"],
            )


def repeated_windows(entries: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """(ord, th, a, b): stretches of words, some of them more than once, of windows that a smaller ord has too."""
    # keys of one document only go; what is counted is counted map-side
    keys = entries.groupBy("key").agg(F.min("ord").alias("low"), F.max("ord").alias("high")).where("low < high").select("key")
    matched = stored(entries.join(stored(keys, "passage-names"), "key", "left_semi"), "passage-matched")
    groups = matched.groupBy("key", "ctx").agg(F.min(F.struct("ord", "th", "place")).alias("rep"), F.max("ord").alias("high"))
    groups = stored(groups.select("key", "ctx", "rep.*", "high"), "passage-contexts")
    # a context's later documents lose all its windows
    later = groups.where("ord < high").select("key", "ctx", F.col("ord").alias("first"))
    whole = matched.join(later, ["key", "ctx"]).where("ord > first").select("ord", "th", _start(F.col("place")).alias("a"), (_start(F.col("place")) + _more(F.col("place")) + width).alias("b"))
    # its first document loses those that a smaller one has in another context of the name
    variants = groups.groupBy("key").agg(F.min("ord").alias("low"), F.max("ord").alias("top")).where("low < top").select("key")
    wanted = groups.join(variants, "key").groupBy("ord", "th").agg(F.collect_list(F.struct("key", "ctx", "place")).alias("wanted"))
    held = texts.dropDuplicates(["ord", "th"]).join(wanted, ["ord", "th"]).select("ord", "text", "wanted")
    windows = stored(held.mapInArrow(lambda b: _windows(b, width), "key long, ctx long, ord long, shift long, h1 long, h2 long"), "passage-windows")
    same = ["key", "shift", "h1", "h2"]
    least = windows.groupBy(*same).agg(F.min("ord").alias("low"), F.max("ord").alias("top")).where("low < top").drop("top")
    lost = windows.join(stored(least, "passage-windows-first"), same).where("ord > low").select("key", "ctx", F.col("ord").alias("first"), "shift").distinct()
    at = F.shiftright("place", 2 * PLACE_BITS) + F.col("shift")
    partly = matched.join(lost, ["key", "ctx"]).where("ord = first").select("ord", "th", at.alias("a"), (at + width).alias("b"))
    return whole.unionByName(partly)


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
_RESULT_SQL = "doc_id long, n_words long, n_removed long, kept binary, spans array<struct<start: long, stop: long>>"


def _cut(batches: Iterator[pa.RecordBatch], digest: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans in zip(_buffers(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            words = bytes(text).split()  # of bytes, at the same six characters
            cuts = merged(np.array([(s["a"], s["b"]) for s in spans or []], dtype=np.int64).reshape(-1, 2)).tolist()
            at, kept = 0, []
            for a, b in cuts:
                kept += words[at:a]
                at = b
            kept += words[at:]
            rest = b" ".join(kept)
            rest = hashlib.sha256(rest).hexdigest().encode() if digest else rest
            out.append((len(words), len(words) - len(kept), rest, [{"start": a, "stop": b} for a, b in cuts]))
        types = pa.int64(), pa.int64(), pa.binary(), _SPANS
        columns = [batch.column(0), *(pa.array([o[i] for o in out], t) for i, t in enumerate(types))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept", "spans"])


def dedup_passages(docs: DataFrame, words: int = WORDS, rounds: int = ROUNDS, digest: bool = False) -> DataFrame:
    """A row for each row of `docs`: doc_id, n_words, n_removed, kept, spans.

    A word goes if a window of `words` words around it (at most 1,024) also starts in a document with a smaller id. Words are split at ASCII white
    space and compared as they are; a null text has none. kept: the words that stay, joined by a space, as UTF-8 bytes, or the
    SHA-256 digest of that; spans: the maximal runs of words that went. A null id comes after all others. Rows of one
    id lose nothing to one another, whether their texts are equal or not. Of very long texts all windows are compared; ties
    there are none. Other columns do no harm, and an empty table gives no rows. Equality is that of two 64-bit hashes. rounds changes the work, not the result.
    """
    bounded_batches(docs.sparkSession)
    texts = _texts(docs)
    entries = stored(texts.select("ord", "th", "text").mapInArrow(lambda b: _entries(b, words, rounds), _ENTRY_SQL), "passage-entries")
    spans = repeated_windows(entries, texts, words).groupBy("ord", "th").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    rows = texts.join(spans, ["ord", "th"], "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(lambda b: _cut(b, digest), _RESULT_SQL)


def op13_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_passages(documents(spark, sf_dir), digest=True).select("doc_id", "n_words", "n_removed", F.col("kept").cast("string").alias("kept_sha256"))


OP13_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(len(w) - 49)) AS a FROM w WHERE len(w) >= 50),
windows AS (SELECT doc_id, a, array_to_string(w[a + 1 : a + 50], ' ') AS words FROM starts),
lost AS (SELECT doc_id, a FROM (SELECT doc_id, a, min(doc_id) OVER (PARTITION BY words) AS first FROM windows) WHERE doc_id > first),
gone AS (SELECT DISTINCT doc_id, unnest(range(a, a + 50)) AS i FROM lost),
places AS (SELECT doc_id, unnest(range(len(w))) AS i, unnest(w) AS word FROM w),
kept AS (SELECT p.doc_id, count(*) AS n, string_agg(p.word, ' ' ORDER BY p.i) AS text FROM places p ANTI JOIN gone g ON p.doc_id = g.doc_id AND p.i = g.i GROUP BY p.doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""
