"""Packing token streams into sequences by order-preserving dynamic programming.

Documents follow one another as a task reads them. A sequence is a window of that stream; windows may be cut after a
document, after a sentence at a penalty, and inside a long sentence at a high one. The least sum of padding and
penalties is found from left to right: the best start of a window that ends at a cut is the least of
cost(start) + position(start) over the starts within reach, which a queue of rising values keeps at its head.
"""

from __future__ import annotations

import base64
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from bidstream.llm.common import bounded_batches, documents, text_of

#: In tokens of padding: the price of a cut after a sentence, of one elsewhere in a document, of a sequence.
SENTENCE, INSIDE, SEQUENCE = 24, 200, 16
#: Where sentences are longer than this, cuts are allowed at so many tokens from one another.
STRIDE = 128
#: Tokens that are gathered before a block of the stream is cut.
BLOCK = 1 << 19

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([(c.split()[0], pa.int64()) for c in SCHEMA.split(", ")])


@lru_cache(2)
def tokenizer(json_path: str, ranks_path: str):
    """A function from a text to its ids, and the ids after which a sentence ends.

    The ranks hold the same vocabulary and give the same ids several times as fast; they do not know special
    tokens, so a text in which one of these is spelt out goes to the full tokenizer.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(json_path)
    special = [t.content for t in full.get_added_tokens_decoder().values()]
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ends = np.zeros(max(full.get_vocab_size(), max(ranks.values()) + 1), dtype=bool)
    for token, rank in ranks.items():
        ends[rank] = token.rstrip().endswith((b".", b"!", b"?")) or b"\n" in token

    def encode(text: str) -> np.ndarray:
        if any(s in text for s in special):
            return np.array(full.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return fast.encode_to_numpy(text, disallowed_special=())

    return encode, ends


def cut_points(ends: np.ndarray, edges: np.ndarray) -> tuple[list[int], list[int]]:
    """Positions where the stream may be cut, 0 and its end among them, and their penalties.

    ends: whether a sentence ends with each token; edges: where documents end.
    """
    n = len(ends)
    price = np.full(n + 1, -1, dtype=np.int32)
    price[1:][ends] = SENTENCE
    price[edges] = 0
    price[0] = price[n] = 0
    at = np.flatnonzero(price >= 0)
    gaps = np.flatnonzero(np.diff(at) > 2 * STRIDE)
    for a, b in zip(at[gaps], at[gaps + 1], strict=True):
        price[np.arange(a + STRIDE, b, STRIDE)] = INSIDE
    at = np.flatnonzero(price >= 0)
    return at.tolist(), price[at].tolist()


def best_cuts(at: list[int], price: list[int], window: int) -> list[int]:
    """Positions of the cuts, from 0 to the end, with the least sum of padding and prices.

    A window is padded up to `window`, but not if its length is a power of two.
    """
    cost, back, index = [0] * len(at), [0] * len(at), {0: 0}
    held = [0] * len(at)  # cost + position
    queue: deque[int] = deque()
    powers = [1 << k for k in range(5, window.bit_length()) if 1 << k < window]
    for j in range(1, len(at)):
        x = at[j]
        value = held[j - 1] = cost[j - 1] + at[j - 1]
        while queue and held[queue[-1]] >= value:
            queue.pop()
        queue.append(j - 1)
        while at[queue[0]] < x - window:
            queue.popleft()
        i = queue[0]
        least = held[i] + window - x
        for p in powers:
            k = index.get(x - p)
            if k is not None and cost[k] < least:
                least, i = cost[k], k
        cost[j], back[j] = least + price[j] + SEQUENCE, i
        index[x] = j
    out, j = [at[-1]], len(at) - 1
    while j:
        j = back[j]
        out.append(at[j])
    return out[::-1]


def _tail(cuts: list[int], window: int) -> list[int]:
    """The last window, if it needs padding, in windows of powers of two instead."""
    a, b = cuts[-2:]
    out = cuts[:-1]
    while a < b:
        a += window if b - a >= window else 1 << ((b - a).bit_length() - 1)
        out.append(a)
    return out


def _pack_partition(batches: Iterator[pa.RecordBatch], window: int, end_id: int, json_path: str, ranks_path: str) -> Iterator[pa.RecordBatch]:
    encode, sentence_end = tokenizer(json_path, ranks_path)
    first_id, made = TaskContext.get().partitionId() << 40, 0
    # the open part of the stream: ids, and for each document in it: id, tokens before the part, tokens in it, all its tokens
    ids: list[np.ndarray] = []
    docs: list[tuple] = []
    size = 0

    def flush(last: bool) -> pa.RecordBatch | None:
        nonlocal ids, docs, size, made
        stream = np.concatenate(ids)
        edges = np.cumsum([d[2] for d in docs])
        cuts = best_cuts(*cut_points(sentence_end[stream], edges), window)
        # later documents may change what is best for the last windows
        cuts = _tail(cuts, window) if last else cuts[:-2]
        if len(cuts) < 2:
            return None
        bounds = np.union1d(np.append(0, edges), cuts)
        bounds = bounds[bounds <= cuts[-1]]
        starts, stops = bounds[:-1], bounds[1:]
        doc_starts = np.append(0, edges[:-1])
        of, seq = np.searchsorted(doc_starts, starts, "right") - 1, np.searchsorted(cuts, starts, "right") - 1
        before, whole = np.array([d[1] for d in docs]), np.array([d[3] for d in docs])
        crc = [zlib.crc32(stream[a:b].astype("<u4").tobytes()) for a, b in zip(starts, stops, strict=True)]
        out = [
            pa.array([docs[i][0] for i in of], pa.int64()), before[of] + starts - doc_starts[of], stops - starts, crc, whole[of],
            first_id + made + seq, starts - np.array(cuts)[seq],
        ]
        made += len(cuts) - 1
        done = cuts[-1]
        ids, size = [stream[done:]], len(stream) - done
        docs = [
            (d, b + max(0, done - s), n - max(0, done - s), t)
            for (d, b, n, t), s in zip(docs, doc_starts.tolist(), strict=True) if s + n > done
        ]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], schema=_ARROW)

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            tokens = np.append(encode(text.as_py()), np.uint32(end_id))
            ids.append(tokens)
            docs.append((doc_id, 0, len(tokens), len(tokens)))
            size += len(tokens)
            if size >= BLOCK and (out := flush(False)):
                yield out
    if size:
        yield flush(True)


def pack(docs: DataFrame, window: int = 2048, end_id: int = 1, json_path: str = "", ranks_path: str = "") -> DataFrame:
    """Pieces of documents in sequences of at most `window` tokens, as SCHEMA has them.

    Each document is its ids and then `end_id`; a null or empty text is `end_id` alone. Each row of `docs` is a document
    of its own, repeated ones too; a null doc_id stays null; other columns are passed over, and an empty table gives
    no rows. Sequences do not cross Spark's partitions; a partition's last window is cut to powers of two, which need
    no padding. So rereads of the same files in the same splits give the same sequences. The paths name the tokenizer's
    files on each executor; by default, those of public_tokenizers.
    """
    import public_tokenizers

    bounded_batches(docs.sparkSession)
    json_path = json_path or public_tokenizers.path("byte_bpe_50k.json")
    ranks_path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    return docs.select(docs["doc_id"].cast("long"), text_of().alias("text")).mapInArrow(
        lambda batches: _pack_partition(batches, window, end_id, json_path, ranks_path), SCHEMA
    )


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
