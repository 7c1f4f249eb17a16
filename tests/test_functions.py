from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from bidstream.functions import dates, text as tx


def one(spark, column, value=None, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column).first()[0]


@pytest.mark.parametrize("value, want", [
    ("2026-09-17", "2026-09-17T00:00:00"), ("2026-09-17T10:30:00", "2026-09-17T10:30:00"), ("2026-09-17T10:30:00Z", "2026-09-17T10:30:00"),
    ("2026-09-17T10:30:00+02:00", "2026-09-17T08:30:00"), ("2026-09-17+02:00", "2026-09-16T22:00:00"), ("17/09/2026", "2026-09-17T00:00:00"),
    ("17 September 2026", "2026-09-17T00:00:00"), ("7 Sep 2026", "2026-09-07T00:00:00"), ("20260917", "2026-09-17T00:00:00"),
    ("soon", None), ("", None), (None, None), ("2026-13-01", None), ("31/02/2026", None),
])
def test_parse_date(spark, value, want):
    got = one(spark, F.unix_micros(dates.parse_date(F.col("v"))), value)
    assert got == (want and int(datetime.fromisoformat(want).replace(tzinfo=timezone.utc).timestamp() * 1e6))


@pytest.mark.parametrize("local, zone, want", [
    ("2026-03-08 02:30:00", "America/New_York", None), ("2026-11-01 01:30:00", "America/New_York", None), ("2026-07-01 12:00:00", "America/New_York", "2026-07-01 16:00:00"),
    ("2026-10-25 01:30:00", "Europe/London", None), ("2026-04-05 01:45:00", "Australia/Lord_Howe", None), ("2026-01-01 00:00:00", "Asia/Kathmandu", "2025-12-31 18:15:00"),
])
def test_zoned_instants(spark, local, zone, want):
    got = one(spark, F.date_format(dates.zoned_instant(F.col("v").cast("timestamp_ntz"), F.lit(zone)), "yyyy-MM-dd HH:mm:ss"), local)
    assert got == want


def test_shown_deadline(spark):
    df = spark.sql("select array(timestamp'2026-01-01', timestamp'2026-03-01', timestamp'2026-02-01') as t")
    at = lambda now: df.select(F.date_format(dates.shown_deadline(F.col("t"), F.lit(now).cast("timestamp")), "yyyy-MM-dd")).first()[0]
    assert [at("2026-01-15"), at("2026-12-01")] == ["2026-02-01", "2026-03-01"]


@pytest.mark.parametrize("raw, want", [
    ("<p>Hello&nbsp;<b>wörld</b></p><script>x()</script>", "Hello wörld"), ("a < b", "a < b"), ("ﬁne  ①\n", "fine 1"), (None, ""), ("<style>p{}</style><p>x", "x"),
])
def test_clean(spark, raw, want):
    assert one(spark, tx.clean("v"), raw) == want == tx.clean_text(raw)


def test_foldings_differ():
    assert tx.fold_for_index("ÉcoleStraße_x") == " ecolestrasse_x " and tx.fold_for_query("ÉcoleStraße_x") == "ecolestraße x"


def test_phrase_hits(spark):
    got = one(spark, tx.phrase_hits(F.col("v"), ["data", "data base", "c++"]), "data base, database and data; c++ data")
    assert got == ["data base", "data", "c++"]


@pytest.mark.parametrize("query, mode, want", [
    ("road works", "all", True), ("works road", "phrase", False), ("road works", "phrase", True), ("bridge road", "any", True), ("bridge", "all", False),
    ("ro", "all", False), ("oad", "all", False), ("oads", "all", False), ("roadwork", "all", False), ('"new road" works', "all", True), ('"road new"', "all", False), ("", "all", True), ("Röad", "all", True),
])
def test_compiled_search(spark, query, mode, want):
    assert one(spark, tx.compiled_search(F.col("v"), query, mode), "the new road works ltd") is want


@pytest.mark.parametrize("value, want", [("=1+2", '"\'=1+2"'), ('say "x"', '"say ""x"""'), (None, '""'), (" -3", '"\' -3"'), ("a,b", '"a,b"')])
def test_csv_cell(spark, value, want):
    assert one(spark, tx.csv_cell(F.col("v")), value) == want


@pytest.mark.parametrize("value, want", [
    ("HTTPS://Www.Example.COM/a/b/?b=2&utm_source=x&a=1#f", "https://www.example.com/a/b?a=1&b=2"), ("ftp://x/y", ""), ("https://u:p@x/y", ""), ("https:///y", ""), ("http://x", "http://x"),
])
def test_canonical_url(spark, value, want):
    assert one(spark, tx.canonical_url(F.col("v")), value) == want


@pytest.mark.parametrize("value, want", [("12.5", 12.5), ("-1", None), ("NaN", None), ("Infinity", None), ("x", None), (None, None), ("0", 0.0)])
def test_money(spark, value, want):
    assert one(spark, tx.money(F.col("v")), value) == want


def test_wilson(spark):
    low, high = tx.wilson(F.lit(8), F.lit(10))
    got = spark.range(1).select(F.round(low, 4), F.round(high, 4)).first()
    assert tuple(got) == (0.4902, 0.9433)
