from pyspark.sql import functions as F

from bidstream.operators import checks

ROWS = "id long, title string, source string, evidence array<struct<quote:string>>, documents array<struct<url:string>>, deadlines array<struct<instant:string,precision:string>>"


def test_publication_rules(spark):
    good = (1, "a road", "s", [("road",)], [("https://x.org/a",)], [(None, "date"), ("2026-01-01T00:00:00Z", "instant")])
    bad = (2, "token = abcdefghijklmnopqrst", None, [("bridge",)], [("http://x.org/a",)], [("2026-01-01T00:00:00Z", "date")])
    df = spark.createDataFrame([good, bad, (3, None, None, [], [], [])], ROWS)
    rules = checks.publication_rules(["x.org"], ["title"])
    got = {(r["check"], r["id"]) for r in checks.faults(df, "id", rules).collect()}
    assert got == {(name, 2) for name in rules}


def test_an_unknown_answer_is_a_fault(spark):
    df = spark.createDataFrame([(1, None), (2, True), (3, False)], "id long, ok boolean")
    assert sorted(r["id"] for r in checks.faults(df, "id", {"ok": F.col("ok")}).collect()) == [1, 3]


def test_ids_and_members(spark):
    a, b = (spark.createDataFrame([(i,) for i in x], "id long") for x in ((1, 1, 2), (2, 3)))
    assert [tuple(r) for r in checks.repeated_ids(a, "id").collect()] == [(1, 2)]
    assert {tuple(r) for r in checks.unlike_members(a, b, "id").collect()} == {(1, "first"), (3, "second")}
