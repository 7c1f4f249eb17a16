"""Streams over events whose ids do not follow their times lose no row."""

import datetime as dt

import duckdb
import pytest

from bidstream.plans import inventories


@pytest.mark.parametrize("name", ["retry_queue"])
def test_ids_need_not_follow_time(spark, tmp_path, name):
    start = dt.datetime(2024, 1, 1)
    kinds = ["error", "error", "purchase", "view", "error", "purchase"]
    events = [(1000 - i, i % 3, start + dt.timedelta(minutes=7 * i), kinds[i % 6], 1.0) for i in range(48)]
    spark.createDataFrame(events, "event_id long, user_id long, ts timestamp_ntz, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = sorted((tuple(r) for r in inventories.QUERIES[name](spark, str(tmp_path)).collect()), key=repr)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert got == sorted(con.execute(inventories.SQL[name]).fetchall(), key=repr) and got
