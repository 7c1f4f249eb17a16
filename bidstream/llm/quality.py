"""Quality classifier: attention-based multiple-instance learning over a document's passages.

A document is a bag of passages of PASSAGE words. Each passage becomes a vector of plain statistics and of hashed words
and pairs of words, is encoded by a small layer, and gets a gated attention weight; the weighted sum of the encodings is scored. Only documents have
labels; the weights of passages are learned from these. The model is trained in numpy on a bounded sample, and its
few weights go to the executors with the scoring function.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bidstream.llm.common import bounded_batches, documents, labels, text_of
from bidstream.llm.neardup import _mix, _powers

PASSAGE, THRESHOLD = 64, 0.3
#: small letters, capitals, digits, stops, marks, symbols, other ASCII, letters beyond ASCII, the rest
CLASSES, SPACE = 9, 9
#: Buckets of hashed words and of hashed pairs of words.
WORDS, PAIRS = 64, 32
FEATURES = CLASSES + 7 + WORDS + PAIRS


def _class(c: str) -> int:
    if c == " ":
        return SPACE
    if c.isascii():
        return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if c in ".,;:" else 4 if c in "!?" else 5 if c in "#$%&*@^~|<>=/\\_{}[]+" else 6
    return 7 if c.isalpha() and not c.isupper() else 1 if c.isupper() else 8


_CLASS_OF = np.array([_class(chr(i)) for i in range(0x2000)], dtype=np.int64)


def _hashed(h: np.ndarray, at: np.ndarray, bags: int, buckets: int) -> np.ndarray:
    """Signed counts of hashes in buckets, for each passage, of length 1 or less."""
    sign = np.where(h >> np.uint64(63), 1.0, -1.0)
    counts = np.bincount(at * buckets + (h % np.uint64(buckets)).astype(np.int64), weights=sign, minlength=bags * buckets).reshape(bags, buckets)
    return counts / np.maximum(1, np.sqrt((counts**2).sum(axis=1)))[:, None]


def passages(text: str | None) -> np.ndarray:
    """A row of FEATURES numbers for each passage of the whole text; an empty text is one passage of zeros."""
    words = (text or "").split()
    if not words:
        return np.zeros((1, FEATURES), dtype=np.float32)
    n = len(words)
    bags = -(-n // PASSAGE)
    chars = np.frombuffer(" ".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kinds = _CLASS_OF[np.minimum(chars, len(_CLASS_OF) - 1)]
    at = np.cumsum(kinds == SPACE) // PASSAGE
    counts = np.bincount(at * (CLASSES + 1) + kinds, minlength=bags * (CLASSES + 1)).reshape(bags, CLASSES + 1)[:, :CLASSES]
    starts = np.arange(0, n, PASSAGE)
    size = np.diff(np.append(starts, n))
    stops = np.append(np.flatnonzero(kinds == SPACE), len(chars))
    begins = np.append(0, stops[:-1] + 1)
    up, down = _powers(1 << max(16, len(chars).bit_length()))
    sums = np.zeros(len(chars) + 1, dtype=np.uint64)
    np.cumsum(_mix(chars.astype(np.uint64)) * up[: len(chars)], out=sums[1:])
    hashes = _mix((sums[stops] - sums[begins]) * down[begins])
    again = np.append(hashes[1:] == hashes[:-1], False)
    lengths = (stops - begins).astype(np.float64)
    place = np.arange(n) // PASSAGE
    pairs = _mix(hashes + np.append(hashes[1:], np.uint64(0)) * np.uint64(3))
    ordered = np.lexsort((hashes, place))
    new = np.ones(n, dtype=np.int64)
    new[1:] = (hashes[ordered][1:] != hashes[ordered][:-1]) | (np.arange(1, n) % PASSAGE == 0)
    per = lambda x: np.add.reduceat(x, starts) / size
    mean = per(lengths)
    total = counts.sum(axis=1).clip(1)
    return np.column_stack([
        counts / total[:, None], per(new), per(again.astype(np.float64)), mean / 10,
        np.sqrt(np.maximum(per(lengths**2) - mean**2, 0)) / 10, np.log1p(size) / 5, np.full(bags, np.log1p(n) / 10), np.ones(bags),
        _hashed(hashes, place, bags, WORDS), _hashed(pairs, place, bags, PAIRS),
    ]).astype(np.float32)


def _segments(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(sizes)), sizes), np.append(0, np.cumsum(sizes)[:-1])


def forward(m: dict, x: np.ndarray, sizes: np.ndarray) -> dict:
    """Scores of bags; x has their passages one after the other."""
    bag, starts = _segments(sizes)
    h = np.tanh(x @ m["w1"] + m["b1"])
    t, s = np.tanh(h @ m["v"]), 1 / (1 + np.exp(-(h @ m["u"])))
    e = (t * s) @ m["a"]
    raw = np.exp(e - np.maximum.reduceat(e, starts)[bag])
    alpha = raw / np.add.reduceat(raw, starts)[bag]
    z = np.add.reduceat(alpha[:, None] * h, starts, axis=0)
    return {"bag": bag, "starts": starts, "h": h, "t": t, "s": s, "alpha": alpha, "z": z, "p": 1 / (1 + np.exp(-(z @ m["c"] + m["c0"])))}


def gradients(m: dict, x: np.ndarray, sizes: np.ndarray, y: np.ndarray, decay: float = 1e-4) -> dict:
    """Of the mean cross-entropy, and of a small weight decay."""
    f = forward(m, x, sizes)
    bag, h, t, s, alpha = (f[k] for k in ("bag", "h", "t", "s", "alpha"))
    d = (f["p"] - y) / len(y)
    dz = d[:, None] * m["c"]
    d_alpha = (dz[bag] * h).sum(axis=1)
    de = alpha * (d_alpha - np.add.reduceat(alpha * d_alpha, f["starts"])[bag])
    dts = de[:, None] * m["a"]
    dt, ds = dts * s * (1 - t**2), dts * t * s * (1 - s)
    dh = (alpha[:, None] * dz[bag] + dt @ m["v"].T + ds @ m["u"].T) * (1 - h**2)
    g = {"w1": x.T @ dh, "b1": dh.sum(axis=0), "v": h.T @ dt, "u": h.T @ ds, "a": (t * s).T @ de, "c": f["z"].T @ d, "c0": d.sum()}
    return {k: v + decay * m[k] * (k != "c0") for k, v in g.items()}


def fit(bags: list[np.ndarray], y: np.ndarray, width: int = 24, gate: int = 12, steps: int = 1200, batch: int = 256, rate: float = 0.01, seed: int = 6) -> dict:
    """The model after about `steps` steps of Adam, over the bags in orders drawn from `seed` again and again."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    m = {"w1": draw(FEATURES, width), "b1": np.zeros(width), "v": draw(width, gate), "u": draw(width, gate), "a": draw(gate), "c": draw(width), "c0": 0.0}
    first, second, step = {k: 0.0 for k in m}, {k: 0.0 for k in m}, 0
    for _ in range(-(-steps // -(-len(bags) // batch)) if len(bags) else 0):
        order = rng.permutation(len(bags))
        for i in range(0, len(order), batch):
            part = order[i:i + batch]
            x, sizes = np.concatenate([bags[j] for j in part]), np.array([len(bags[j]) for j in part])
            step += 1
            for k, g in gradients(m, x, sizes, y[part]).items():
                first[k], second[k] = 0.9 * first[k] + 0.1 * g, 0.999 * second[k] + 0.001 * g**2
                m[k] = m[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return m


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(5)) == 0, F.lit(False))


def train(docs: DataFrame, marks: DataFrame, most_docs: int = 6000, most_passages: int = 128) -> dict:
    """The model from at most `most_docs` labelled documents that are not held out, those whose ids hash lowest.

    Rows of one id give its least text. Of a document with more than `most_passages` passages, so many at even steps are used for training; scoring uses
    all. Both bounds are of the training sample alone. Ids with more than one label get the more frequent one, 1 at a tie;
    labels that are null or of no document are left out. Without any label every score is about one half.
    """
    bounded_batches(docs.sparkSession)
    known = (
        marks.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_docs)
    )

    def bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [passages(t) for t in b["text"]]
            found = [x[np.linspace(0, len(x) - 1, most_passages).astype(int)] if len(x) > most_passages else x for x in found]
            yield pd.DataFrame({"doc_id": b["doc_id"], "y": b["y"], "x": [x.tobytes() for x in found]})

    sample = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
    # at most most_docs rows
    rows = sorted(sample.mapInPandas(bags, "doc_id long, y double, x binary").collect(), key=lambda r: r["doc_id"])
    model = fit([np.frombuffer(r["x"], dtype=np.float32).reshape(-1, FEATURES) for r in rows], np.array([r["y"] for r in rows]))
    if not rows:
        model["c"] = 0 * model["c"]
    return model


def scorer(model: dict):
    """A function of a text column that gives scores, by whole texts."""

    @F.pandas_udf("double")
    def quality_score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            if len(texts) == 0:
                yield pd.Series([], dtype="float64")
                continue
            bags = [passages(t) for t in texts]
            yield pd.Series(forward(model, np.concatenate(bags), np.array([len(b) for b in bags]))["p"])

    return quality_score


def classify(docs: DataFrame, marks: DataFrame, **options) -> DataFrame:
    """`docs` with quality_score (0 to 1) and quality_predicted (1 if the score is at least THRESHOLD, else 0).

    Null texts are empty; an empty text has a score of its own. Rows come out as they are, repeated ones too, and an
    empty table gives no rows. marks: doc_id, quality.
    """
    model = train(docs, marks, **options)
    return docs.withColumn("quality_score", scorer(model)(text_of())).withColumn(
        "quality_predicted", (F.col("quality_score") >= THRESHOLD).cast("int")
    )


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir).select("doc_id", "text"), labels(spark, sf_dir)).select(
        "doc_id", held_out().alias("held_out"), F.col("quality_score").alias("score"), F.col("quality_predicted").alias("predicted"),
    )
