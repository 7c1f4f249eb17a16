import gzip
import json

import pytest
from pyspark.sql import functions as F

from bidstream.operators import listings
from bidstream.sources import cursors, sinks


def test_choices_of_old_links():
    assert listings.valid_choices({"view": "pipeline", "sort": "fit", "q": "x", "n": 3}) == {"view": "early", "sort": "relevance", "q": "x"}
    assert listings.valid_choices({"sort": "awarded", "type": "RFI"}) == {"view": "awards", "sort": "recent", "type": "", "deadline": "", "change": ""}
    assert listings.valid_choices({"view": "frameworks"})["type"] == "FRAMEWORK"
    assert listings.applicable({"view": "awards", "type": "RFI", "supplier": "S"}) == {"view": "awards", "type": "", "supplier": "S"}
    assert listings.applicable({"view": "live", "type": "RFI", "supplier": "S"}) == {"view": "live", "type": "RFI", "supplier": ""}


def test_cursors_wait_longer_and_never_go_back(spark):
    ts = lambda v: F.lit(v).cast("timestamp")
    state = spark.createDataFrame([("a", "2026-01-05", 0, None, None), ("b", "2026-01-05", 3, "2026-01-05", "2026-01-07"), ("c", None, 0, None, None)], "feed string, cursor string, attempts long, failed_at string, retry_at string")
    state = state.withColumns({x: F.col(x).cast("timestamp") for x in ("cursor", "failed_at", "retry_at")})
    assert [r["feed"] for r in cursors.due(state, ts("2026-01-06")).collect()] == ["a", "c"] and [r["feed"] for r in cursors.due(state, ts("2026-01-07")).collect()] == ["a", "c", "b"]
    outcomes = spark.createDataFrame([("a", "2026-01-04", True), ("b", "2026-01-09", False), ("b", "2026-01-08", True), ("d", "2026-01-02", True), ("c", "2026-01-03", None)], "feed string, through string, complete boolean")
    out = {r["feed"]: r for r in cursors.moved(state, outcomes.withColumn("through", F.col("through").cast("timestamp")), ts("2026-01-10 00:00:00")).collect()}
    assert {k: str(r["cursor"])[:10] for k, r in out.items()} == {"a": "2026-01-05", "b": "2026-01-05", "c": "None", "d": "2026-01-02"}
    assert str(out["b"]["retry_at"]) == "2026-01-10 02:00:00" and out["b"]["attempts"] == 4 and out["c"]["attempts"] == 1 and out["a"]["retry_at"] is None


def test_json_lines_end_at_line_feeds_only(spark, tmp_path):
    rows = [{"t": "a b", "n": 1}, {"t": "c\u0085\rd", "n": 2}]
    with gzip.open(f"{tmp_path}/x.jsonl.gz", "wt", encoding="utf-8", newline="") as f:
        f.write("\n".join(json.dumps(r, ensure_ascii=False) for r in rows))
    got = cursors.json_lines(spark, f"{tmp_path}/x.jsonl.gz", "t string, n long").orderBy("n").collect()
    assert got[0]["t"] == "a b" and got[1]["n"] == 2 and len(got) == 2


def test_archive_is_read_by_month_and_compaction_loses_no_key(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2026-01-02", 1), (2, "2026-02-02", 1), (1, "2026-01-05", 2)], "id long, day string, v long").withColumn("day", F.col("day").cast("date"))
    sinks.archive_months(rows, f"{tmp_path}/a", "day", "id", ["v"])
    wanted = spark.createDataFrame([(1, "2026-01"), (2, "2026-01")], "id long, month string")
    assert [(r["id"], r["v"]) for r in sinks.from_archive(spark, f"{tmp_path}/a", wanted, "id").collect()] == [(1, 2)]
    kept = []
    assert tuple(sinks.compacted(rows, "id", ["v"], lambda df: kept.extend(df.collect())).first()) == (3, 2, 1, 0)
    assert sorted((r["id"], r["v"]) for r in kept) == [(1, 2), (2, 1)]


def test_equal_content_is_not_written_again(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x"), (2, "y")], "id long, part string")
    listed, wrote = sinks.write_if_changed(rows, f"{tmp_path}/s", None, "part", "id")
    assert wrote and sinks.write_if_changed(rows, f"{tmp_path}/s", listed, "part", "id")[1] is False
    assert sinks.write_if_changed(rows.union(spark.createDataFrame([(3, "x")], rows.schema)), f"{tmp_path}/s", listed, "part", "id")[1] is True
