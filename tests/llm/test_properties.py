"""Properties of the small functions that run inside tasks."""

import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from bidstream.llm import neardup, packing, quality, substrings, topk

SPANS = st.lists(st.tuples(st.integers(0, 60), st.integers(1, 20)).map(lambda x: (x[0], x[0] + x[1])), max_size=12)
TEXT = st.text(alphabet="aAbZ9é   \t\n\x0b\x0c\r\x1c.🙂", max_size=80)


@given(SPANS)
def test_merged_spans_cover_the_same_bytes(spans):
    mask = np.zeros(90, dtype=bool)
    for a, b in spans:
        mask[a:b] = True
    runs = substrings.merged(np.array(spans, dtype=np.int64).reshape(-1, 2))
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(int), [0])))).reshape(-1, 2)
    assert runs.tolist() == edges.tolist()


@given(TEXT)
def test_shingle_sets_have_the_size_of_the_words_sets(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    want = {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}
    assert len(neardup.shingle_set(text.encode())) == len(want)


@given(st.lists(st.integers(1, 40), min_size=1, max_size=30), st.integers(0, 2**30))
def test_cuts_cover_the_stream(lengths, seed):
    n = sum(lengths)
    ends = np.random.default_rng(seed).random(n) < 0.1
    edges = np.cumsum(lengths)
    at, price = packing.cut_points(ends, edges)
    assert at[0] == 0 and at[-1] == n and set(edges) <= set(at) and all(price[at.index(e)] == 0 for e in edges)
    cuts = packing.best_cuts(at, price, 256)
    assert cuts[0] == 0 and cuts[-1] == n and max(np.diff(cuts)) <= 256 and set(cuts) <= set(at)
    tail = packing._tail(cuts, 256)
    assert tail[0] == 0 and tail[-1] == n and tail[:-1] == sorted(tail[:-1]) and all(x & (x - 1) == 0 for x in np.diff(tail)[len(cuts) - 2:])


@settings(max_examples=30, deadline=None)
@given(st.binary(min_size=400, max_size=700), st.binary(max_size=300), st.binary(max_size=300))
def test_equal_strings_have_equal_anchors(shared, before, after):
    texts = [shared, before + shared + after]
    ends = np.cumsum([len(t) for t in texts])
    starts = ends - [len(t) for t in texts]
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    number, at, first, last, key, ctx = substrings._anchored(data, starts, ends)
    found = {}
    for n, a, f, z, k in zip(number.tolist(), at.tolist(), first.tolist(), last.tolist(), key.tolist(), strict=True):
        for p in range(f, z + 1):
            found[(n, p - int(starts[n]))] = (k, a - p)
    for p in range(len(shared) - substrings.LENGTH + 1):
        assert found[(0, p)] == found[(1, p + len(before))]


@given(TEXT)
def test_passages_are_finite(text):
    x = quality.passages(text)
    assert x.shape[1] == quality.FEATURES and np.isfinite(x).all() and len(x) == max(1, -(-len(text.split()) // quality.PASSAGE))


@given(st.lists(st.integers(-(2**40), 2**40), min_size=2, max_size=6), st.lists(st.integers(-(2**20), 2**20), min_size=2, max_size=6))
def test_products_are_exact(a, b):
    n = min(len(a), len(b))
    got = topk.products(np.array([a[:n]]), np.array([b[:n]]))
    assert got.tolist() == [[sum(x * y for x, y in zip(a[:n], b[:n]))]]
