import pytest
from pyspark.sql import functions as F

from bidstream.operators import tiers
from bidstream.sources import queues


def test_windows(spark):
    got = [tuple(map(str, r)) for r in queues.windows(spark, "2026-01-01", "2026-01-08", 3).collect()]
    assert got == [("2026-01-01", "2026-01-03"), ("2026-01-04", "2026-01-06"), ("2026-01-07", "2026-01-08")]


def test_lanes_with_a_reserve(spark):
    q = spark.createDataFrame([(x, i) for x, n in (("new", 5), ("old", 5), ("odd", 1)) for i in range(n)], "lane string, n long")
    got = [(r["lane"], r["n"]) for r in queues.lanes(q, "lane", ["n"], 6, {"old": 2}).collect()]
    assert sorted(got) == [("new", 0), ("new", 1), ("new", 2), ("odd", 0), ("old", 0), ("old", 1)]
    assert len(queues.lanes(q, "lane", ["n"], 3, {}).select("lane").distinct().collect()) == 3


def test_hydration(spark):
    listing = spark.createDataFrame([(1, "t1", "s"), (2, "t2", "s")], "id long, title string, sig string")
    details = spark.createDataFrame([(1, "full", 9.0)], "id long, title string, value double")
    got = sorted(map(tuple, queues.hydrated(listing, details, "id").collect()))
    assert got == [(1, "full", "s", 9.0), (2, "t2", "s", None)]


def test_incomplete_snapshots(spark):
    pages = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b")], "id long, rev string")
    assert queues.completeness(pages, "id", 2, "rev").first()["complete"] is False
    assert queues.completeness(pages.where("rev = 'a'"), "id", 2, "rev").first()["complete"] is True
    other = pages.withColumn("rev", F.when(F.col("id") == 1, "z").otherwise(F.col("rev")))
    assert [r["id"] for r in queues.same_twice(pages.where("id = 1"), other.where("id = 1"), "id", F.col("rev")).collect()] == [1]


def test_those_that_left_are_read_once(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    assert [r["id"] for r in queues.left_active(ids(1, 2, 3), ids(1), ids(2), "id").collect()] == [3]


def test_overlap_and_fallback(spark):
    df = spark.createDataFrame([(1, ["a", "b"], "x"), (2, ["b"], "y"), (3, [], "x"), (4, None, "z")], "id long, ids array<string>, name string")
    got = {tuple(r) for r in tiers.overlapping(df.where("id in (1, 4)"), df, "ids", "id", ["name"]).collect()}
    assert got == {(1, 1), (1, 2), (1, 3), (4, 4)}


def test_terms_and_labels(spark):
    df = spark.sql("select array('a','b','c') as m, array('c','b','x') as t, map('a', 1.0, 'b', 2.0, 'c', 3.0) as idf, cast(array() as array<string>) as none")
    r = df.select(tiers.shared_terms(F.col("m"), F.col("t"), F.col("idf"), 1).alias("s"), tiers.label_order(F.col("m")).alias("l"), tiers.label_order(F.col("none")).alias("n")).first()
    assert r["s"] == ["c"] and r["l"] < r["n"]


@pytest.mark.parametrize("url, want", [
    ("https://a.org/x", True), ("https://www.a.org", True), ("http://a.org", False), ("https://u@a.org", False), ("https://a.org.evil.com/", False), ("https://a.org:8443/", False), ("https://xa.org", False), (None, False),
])
def test_permitted_url(spark, url, want):
    df = spark.createDataFrame([(url,)], "u string")
    assert df.select(tiers.permitted_url(F.col("u"), ["a.org"])).first()[0] is want


def test_added_today_is_of_the_zone(spark):
    df = spark.sql("select timestamp'2026-06-30 23:30:00' as t, timestamp'2026-07-01 10:00:00' as now")
    flags = tiers.freshness(F.col("t"), F.col("t"), F.col("now"))
    assert tuple(df.select(flags["new"], flags["updated"], flags["added_today"]).first()) == (True, False, True)  # summer time in London


def test_links_count_each_overlapping_row_once(spark):
    rows = spark.createDataFrame([(20, [1, 2, 2]), (40, [2, 1]), (3, [2, 1, 9]), (7, [9]), (60, []), (80, None), (100, [None, 5])], "id long, ids array<long>")
    got = {r["id"]: r["links"] for r in tiers.overlap_links(rows.where("id % 20 = 0"), rows, "ids", "id").collect()}
    assert got == {20: 2, 40: 2, 60: 0, 80: 0, 100: 0}


def test_the_overlap_query_forms_all_pairs():
    from bidstream.plans import catalog

    assert catalog.oracle_sql()["supplier_overlap"] != catalog.oracle_sql()["supplier_overlap_classes"]
    assert "links" in catalog.oracle_sql()["supplier_overlap"]


@pytest.mark.parametrize("several", [False, True])
def test_tiers_tell_each_pair_once_and_gather_none(spark, monkeypatch, several):
    """Nulls relate nothing and hide nothing; only keys with several rows have their pairs gathered."""
    monkeypatch.setattr(tiers, "TASK_ROWS", 1)
    held = [(1, 1, 1), (2, 1, 1), (3, None, 1), (4, 2, None), (5, None, None), (6, 2, 1)] + ([(2, 9, 9), (2, 2, None)] if several else [])
    rows = spark.createDataFrame(held, "id int, a int, b int")
    out = tiers.tiered(rows.where("id < 4"), rows, "id", [["a"], ["b"]])
    least = {}
    for tier, place in ((0, 1), (1, 2)):
        for q in held:
            for r in held:
                if q[0] < 4 and q[0] != r[0] and q[place] is not None and q[place] == r[place]:
                    least[q[0], r[0]] = min(tier, least.get((q[0], r[0]), 9))
    assert sorted(map(tuple, out.collect())) == sorted((q, r, t) for (q, r), t in least.items())
    assert several or "HashAggregate" not in out._jdf.queryExecution().toString()
