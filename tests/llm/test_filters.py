import re
from itertools import permutations

import pytest

from bidstream.llm import filters
from tests.llm.conftest import collected

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
LABELS = "doc_id long, quality int, toxic int, part string"


def fails(rows):
    """(id, part, failed letters) of rows (doc_id, text, lang, source ..), judged one by one."""
    out = []
    for i, t, _, source, *_ in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": re.search(r"[#$%&*|]", t) is not None, "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, *_ in rows),
        }
        out.append((i, source or "", {f for f in bad if bad[f]}))
    return out


def by_force(rows, marks):
    judged = fails(rows)
    good, toxic = {i for i, q, _ in marks if q == 1 and i is not None}, {i for i, _, x in marks if x == 1 and i is not None}
    out = []
    for part in {p for _, p, _ in judged}:
        here = [(i, bad) for i, p, bad in judged if p == part]
        share = dict.fromkeys("ABCDE", 0)
        steps = []
        for order in permutations("ABCDE"):
            left = here
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                share[f] += len(gone)
                steps.append(("".join(order), step, f, len(left), len(gone), sum(f in bad for _, bad in here) - len(gone), sum(bad == {f} for _, bad in here),
                              sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)))
        out += [(part, o, s, k, r, d, u, g, t, share[f]) for o, s, f, k, r, d, u, g, t in steps]
    return sorted(out, key=repr)


def marks_of(rows):
    ids = sorted({r[0] for r in rows if r[0] is not None})
    return [(i, i % 3 % 2, int(i % 4 == 0)) for i in ids if i % 5] + [(3, 0, 1), (6, None, 1), (7, 1, None), (None, 1, 1), (10**6, 1, 1)]


def test_against_every_order(spark, docs, rows):
    more = [(200 + i, "A B C D " * 20 + "one | two", "en", s, 0, "s", "b", "k") for i, s in enumerate(["a", "", None, "c", "a"])]
    every, marks = rows + more, marks_of(rows + more)
    out = filters.audit(spark.createDataFrame(every, docs.schema).repartition(3), spark.createDataFrame([(*m, "x") for m in marks], LABELS))
    assert out.columns == COLUMNS
    assert collected(out, *COLUMNS) == by_force(every, marks)


def test_masks(spark, docs, rows):
    got = collected(filters.masks(docs), "doc_id", "part", "mask")
    assert got == sorted(((i, p, sum(1 << "ABCDE".index(f) for f in bad)) for i, p, bad in fails(rows)), key=repr)


def test_any_filters_and_orders(spark):
    """Three filters, two orders; masks that no document has count as none."""
    counts = spark.createDataFrame([("p", 0b101, 7, 2, 1), ("p", 0b000, 3, 1, 0), ("q", 0b010, 4, 0, 4)], "part string, mask int, n long, good long, toxic long")
    out = collected(filters.order_steps(filters.survivors(counts, 3), "XYZ", ["XYZ", "ZYX"]), *COLUMNS)
    assert out == sorted([
        ("p", "XYZ", 1, 3, 7, 0, 0, 2, 1, 21), ("p", "XYZ", 2, 3, 0, 0, 0, 0, 0, 0), ("p", "XYZ", 3, 3, 0, 7, 0, 0, 0, 21),
        ("p", "ZYX", 1, 3, 7, 0, 0, 2, 1, 21), ("p", "ZYX", 2, 3, 0, 0, 0, 0, 0, 0), ("p", "ZYX", 3, 3, 0, 7, 0, 0, 0, 21),
        ("q", "XYZ", 1, 4, 0, 0, 0, 0, 0, 0), ("q", "XYZ", 2, 0, 4, 0, 4, 0, 4, 24), ("q", "XYZ", 3, 0, 0, 0, 0, 0, 0, 0),
        ("q", "ZYX", 1, 4, 0, 0, 0, 0, 0, 0), ("q", "ZYX", 2, 0, 4, 0, 4, 0, 4, 24), ("q", "ZYX", 3, 0, 0, 0, 0, 0, 0, 0),
    ], key=repr)


@pytest.mark.parametrize("some", [True, False])
def test_empty_tables(spark, docs, no_docs, some):
    none = spark.createDataFrame([], LABELS)
    out = filters.audit(docs if some else no_docs, none)
    assert out.agg({"good_lost": "sum"}).first()[0] == (0 if some else None)
