"""Queries that do the whole job, on a fixture whose rows the part queries pass over."""

import datetime

import pytest

from bidstream.plans import catalog
from tests.test_identity import union_find

LINES = [(20, 1), (3, 1), (3, 1), (40, 1), (40, 2), (7, 2), (9, 3)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("whole"))
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{top}/{name}.parquet")
    put("lineitem", [(o, 100 + s, s, 1.0) for o, s in LINES], "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double")
    put("events", [(1, 5, "view"), (2, 5, "buy"), (7, 6, "click")], "event_id long, user_id long, event_type string")
    at = datetime.datetime(2000, 1, 1)
    put("orders", [(i, c, "O", 1.0, at, p) for i, c, p in ((20, 1, "x"), (6, 1, "y"), (2, 2, "x"))],
        "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string")
    put("customer", [(1, "a", 1, "S"), (2, "b", 1, "T")], "c_custkey long, c_name string, c_nationkey long, c_mktsegment string")
    put("nation", [(1, "N", 1)], "n_nationkey long, n_name string, n_regionkey long")
    put("region", [(1, "R")], "r_regionkey long, r_name string")
    return top


def rows_of(spark, name, tables, *columns):
    return sorted(map(tuple, catalog.queries()[name](spark, tables).select(*columns).collect()))


def test_classes_give_the_overlapping_pairs(spark, tables):
    got = rows_of(spark, "supplier_overlap_classes", tables, "supplier", "id", "asked", "asking", "members")
    assert got == [(1, 3, False, 2, 3), (1, 20, True, 2, 3), (1, 40, True, 2, 3), (2, 7, False, 1, 2), (2, 40, True, 1, 2)]
    pairs = {(a, b) for s, a, asked, *_ in got if asked for t, b, *_ in got if s == t}
    assert pairs == {(a, b) for a, s in LINES if a % 20 == 0 for b, t in LINES if s == t}


def test_all_events_and_starts(spark, tables):
    assert rows_of(spark, "label_sequence_whole", tables, "rank", "user_id") == [(1, 5), (2, 6)]
    assert rows_of(spark, "predecessor_walk_whole", tables, "start", "id", "depth") == [(2, 2, 0), (6, 2, 1), (6, 6, 0), (20, 2, 2), (20, 6, 1), (20, 20, 0)]


def test_every_twentieth_notice_asks(spark, tables):
    assert rows_of(spark, "related_tiers_whole", tables, "query", "id", "tier") == [(20, 2, 2), (20, 6, 0)]


def test_components_of_all_line_items(spark, tables):
    first = {}
    want = union_find([(first.setdefault(s, o), o) for o, s in LINES])
    assert rows_of(spark, "identity_components_whole", tables, "id", "component") == sorted(want.items())
