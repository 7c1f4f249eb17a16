"""When deadlines are over, in whatever zone the session is."""

import pytest
from pyspark.sql import functions as F

from bidstream.functions import dates

#: kind, status, lot, date, time, zone, precision, instant; the instants that have to come out stand in ENDS.
DEADLINES = [
    [("questions", "current", "2026-09-17", "23:59", None, "local_time", None)],
    [("invited_submission", "current", "2026-09-17", "23:59", None, "local_time", None)],
    [("tender", "superseded", "2026-09-17", "23:59", None, "local_time", None)],
    [("tender", "conflicting", "2026-09-17", "23:59", None, "local_time", None)],
    [("tender", "superseded", "2026-09-17", "23:59", None, "local_time", None), ("tender", "current", "2026-10-01", "23:59", None, "local_time", None)],
    [("application", "current", "2026-09-17", "23:59", None, "local_time", None), ("tender", "current", "2026-10-01", "23:59", None, "local_time", None)],
    [("expression_of_interest", "current", "2026-09-17", "23:59", None, "local_time", None), ("invited_submission", "current", "2026-10-01", "23:59", None, "local_time", None)],
    [("tender", "current", "2026-09-17", "23:59", None, "local_time", None), ("tender", "current", "2026-10-01", "23:59", None, "local_time", None)],
    [("tender", "current", "2026-09-17", "23:59", None, "instant", "2026-09-17T23:59:00-04:00")],
    [("tender", "current", "2026-09-17", "23:59", "America/New_York", "local_time", None)],
    [("tender", "current", "2026-09-17", None, "Europe/London", "date", None)],
    [("tender", "current", "2026-11-01", "01:30", "America/New_York", "local_time", None)],
    [("tender", "current", "2026-03-08", "02:30", "America/New_York", "local_time", None)],
    [("tender", "current", "2026-09-17", "23:59", "Unpublished/Zone", "local_time", None)],
]
DEADLINE = "struct<kind: string, status: string, date: string, time: string, timezone: string, precision: string, instant: string>"
ENDS = [None] * 4 + ["2026-10-02 11:59:59.999999", "2026-09-18 11:59:59.999999", "2026-09-18 11:59:59.999999", "2026-10-02 11:59:59.999999", "2026-09-18 03:59:00",
                      "2026-09-18 03:59:00", "2026-09-17 22:59:59.999999", "2026-11-02 04:59:59.999999", "2026-03-09 03:59:59.999999", "2026-09-18 11:59:59.999999"]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kathmandu"])
def test_ends_of_deadlines(spark, zone):
    cases = spark.createDataFrame(list(enumerate(DEADLINES)), f"case_id int, deadlines array<{DEADLINE}>")
    spark.conf.set("spark.sql.session.timeZone", zone)
    rows = cases.select("case_id", F.unix_micros(dates.response_deadline(F.col("deadlines"))).alias("us")).orderBy("case_id").collect()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    want = spark.createDataFrame([(e,) for e in ENDS], "t string").select(F.unix_micros(F.col("t").cast("timestamp"))).collect()
    assert [r["us"] for r in rows] == [w[0] for w in want]


def test_prose_is_searched_once_for_each_thing(spark):
    df = spark.createDataFrame([("Closing date: 12 noon on 3 May 2026. Closing date 4 May 2026 at 5pm. Closing date 5 of June 2026 at 99",), ("Closing date to be told",), (None,)], "t string")
    out = df.select(dates.prose_deadlines(F.col("t"), ("closing date",)).alias("d"))
    assert [r["d"] for r in out.collect()] == [["2026-05-03T12:00", "2026-05-04T17:00", "2026-06-05"], [], None]
    # a lambda works out what it names as often as it names it
    assert out._jdf.queryExecution().analyzed().toString().count("regexp_extract(") < 20
