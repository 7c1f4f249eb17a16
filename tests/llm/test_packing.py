import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from bidstream.llm import packing
from tests.llm.conftest import SCHEMA


def padded(n, window=2048):
    return 0 if n & (n - 1) == 0 else window - n


def verify(out, texts):
    """Each id in one piece, pieces without gaps in sequences, digests of the reference tokenizer's ids."""
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], dtype="<u4") for x in texts]
    by_seq, seen = defaultdict(list), defaultdict(list)
    for r in out:
        by_seq[r["sequence_id"]].append(r)
        seen[r["doc_id"]].append(r)
    assert sum(r["length"] for r in out) == sum(map(len, ids))
    for rows in by_seq.values():
        rows.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in rows] == np.cumsum([0, *(r["length"] for r in rows)])[:-1].tolist()
        assert sum(r["length"] for r in rows) <= 2048
    for i, x in enumerate(ids):
        rows = sorted(seen[i], key=lambda r: r["start"])
        assert [r["start"] for r in rows] == np.cumsum([0, *(r["length"] for r in rows)])[:-1].tolist()
        for r in rows:
            assert r["doc_tokens"] == len(x) and r["ids_crc32"] == zlib.crc32(x[r["start"]:r["start"] + r["length"]].tobytes())
    return sum(padded(sum(r["length"] for r in rows)) for rows in by_seq.values()) / sum(map(len, ids))


def test_pieces(spark, rows):
    texts = [r[1] for r in rows] + ["x <|endoftext|> y", "no stops " * 4000, "a" * 5000, "🙂 数据\r\n\t"]
    df = spark.createDataFrame([(i, t, None, None, 0, None, None, None) for i, t in enumerate(texts)], SCHEMA)
    assert verify(packing.pack(df.repartition(3)).collect(), texts) < 0.05


def test_blocks_do_not_break_documents(spark, rows, monkeypatch):
    """The stream is cut in many small blocks; the function's default is read where it runs, so it runs here."""
    import pyarrow as pa

    monkeypatch.setattr(packing, "BLOCK", 6000)
    monkeypatch.setattr(packing, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": lambda self: 3})())}))
    texts = [r[1] or "" for r in rows]
    path = public_tokenizers.path
    batches = [pa.RecordBatch.from_pydict({"doc_id": pa.array([i], pa.int64()), "text": pa.array([t])}) for i, t in enumerate(texts)]
    out = [r for b in packing._pack_partition(iter(batches), 2048, 1, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken")) for r in b.to_pylist()]
    assert verify(out, texts) < 0.05 and {r["sequence_id"] >> 40 for r in out} == {3}
    order = sorted(out, key=lambda r: (r["sequence_id"], r["offset"]))
    assert [r["doc_id"] for r in order] == sorted(r["doc_id"] for r in order)


def test_best_cuts_against_all_choices():
    rng = random.Random(0)
    for _ in range(200):
        at = sorted({0, *rng.sample(range(1, 400), rng.randint(1, 40))})
        fill = [0]
        for x in at[1:]:  # no gap above the window
            while x - fill[-1] > 64:
                fill.append(fill[-1] + 60)
            fill.append(x)
        price = [0] + [rng.choice([0, 24, 200]) for _ in fill[1:]]
        best = {0: 0}
        for j, x in enumerate(fill[1:], 1):
            best[x] = min(best[a] + (0 if x - a in (32, 64) else 64 - (x - a)) for a in fill[:j] if x - a <= 64) + price[j] + packing.SEQUENCE
        cuts = packing.best_cuts(fill, price, 64)
        cost = sum((0 if b - a in (32, 64) else 64 - (b - a)) + price[fill.index(b)] + packing.SEQUENCE for a, b in zip(cuts, cuts[1:]))
        assert cost == best[fill[-1]]


def test_rapid_tokenizer_gives_the_same_ids(rows):
    path = public_tokenizers.path
    encode, _ = packing.tokenizer(path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"))
    full = Tokenizer.from_file(path("byte_bpe_50k.json"))
    for text in [r[1] or "" for r in rows] + ["<|endoftext|>", "it's 12%  \n\n x", "ﬀ​́ Ⅷ ١٢"]:
        assert encode(text).tolist() == full.encode(text, add_special_tokens=False).ids


def test_ids_of_a_whole_table_and_of_random_text():
    """Both tokenizers give the same ids for all documents of a table and for text of any characters."""
    import os
    import random

    import pyarrow.parquet as pq
    import public_tokenizers
    from tokenizers import Tokenizer

    path = "/root/testdata/sf0.01/documents.parquet"
    rng = random.Random(3)
    pools = [range(32, 127), range(0xA0, 0x250), range(0x370, 0x530), range(0x4E00, 0x4F00), range(0x1F300, 0x1F600), [9, 10, 13, 0x85, 0xA0, 0x200D, 0x2028, 0x301, 0xFEFF]]
    texts = ["".join(chr(rng.choice(rng.choice(pools))) for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    if os.path.exists(path):
        texts += [t or "" for t in pq.read_table(path, columns=["text"])["text"].to_pylist()]
    full = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode, _ = packing.tokenizer(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for e, t in zip(full.encode_batch(texts, add_special_tokens=False), texts, strict=True):
        assert e.ids == encode(t).tolist()


def test_empty_table(no_docs):
    assert packing.pack(no_docs).count() == 0
