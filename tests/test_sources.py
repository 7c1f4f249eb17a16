import io
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidstream.operators import history, ordered, snapshots
from bidstream.sources import archives, feeds, sinks
from bidstream.streaming import incremental

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("title", T.StringType()), T.StructField("value", T.DoubleType())])


def written(tmp_path, text, encoding="utf-8"):
    (tmp_path / "feed.csv").write_bytes(text.encode(encoding))
    return str(tmp_path / "feed.csv")


def test_csv_snapshot(spark, tmp_path):
    path = written(tmp_path, 'title,id,value,more\n"a ""b""\nc",1,2.5,x\nd,2,,y\n')
    rows = feeds.csv_snapshot(spark, path, SCHEMA, "id", rows_before=2).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, 'a "b"\nc', 2.5), (2, "d", None)]


@pytest.mark.parametrize("text, before", [
    ("id,title\n1,a\n", 0), ("id,title,value\n1,a,2\n1,b,3\n", 0), ("id,title,value\n1,a,zwei\n", 0), ("id,title,value\n1,a,2\n", 2), ("id,title,title,value\n1,a,b,2\n", 0),
])
def test_csv_faults(spark, tmp_path, text, before):
    with pytest.raises(feeds.SchemaFault):
        feeds.csv_snapshot(spark, written(tmp_path, text), SCHEMA, "id", rows_before=before)


def test_csv_encoding(spark, tmp_path):
    path = written(tmp_path, "id,title,value\n1,é,2\n", "latin-1")
    assert feeds.csv_snapshot(spark, path, SCHEMA, "id", encoding="ISO-8859-1").first()["title"] == "é"


def test_zip_members_and_bounds(spark, tmp_path):
    def zipped(name, members):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for n, content in members.items():
                z.writestr(n, content)

    zipped("a.zip", {"x/one.json": "{}", "two.xml": "<a><b>3</b></a>"})
    zipped("evil.zip", {"../out": "x"})
    zipped("large.zip", {"big": "x" * 2000})
    (tmp_path / "bad.zip").write_bytes(b"no zip")
    rows = archives.zip_members(spark, str(tmp_path), most_bytes=1000).collect()
    assert {(r["name"], r["stem"]) for r in rows if r["fault"] is None} == {("x/one.json", "one"), ("two.xml", "two")}
    assert sorted(r["fault"] for r in rows if r["fault"]) == ["not a zip", "path", "too large"]
    assert io.BytesIO is not None


def test_xml_fields(spark):
    df = spark.createDataFrame([("<n><lot id='1'><end> 2026-01-01 </end></lot></n>",)], "x string")
    got = df.select(*archives.xml_fields(F.col("x"), {"end": "/n/lot[@id='1']/end", "none": "/n/none"})).first()
    assert tuple(got) == ("2026-01-01", None)


def test_cycles_are_found(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (5, 5)], "id long, predecessor long")
    assert sorted(r["id"] for r in feeds.cyclic(links).collect()) == [1, 2, 3, 5]
    walk = feeds.predecessors(links, links.where("id = 4").select("id")).collect()
    assert sorted((r["id"], r["depth"]) for r in walk) == [(1, 1), (2, 2), (3, 3), (4, 0)]


def test_work_queue_and_anchor(spark):
    q = spark.createDataFrame([("a", 3), ("b", None), ("c", 1)], "partition string, failed_at long")
    assert [r["partition"] for r in feeds.work_queue(q, 2).collect()] == ["b", "c"]
    assert feeds.anchored(q, "partition", "a").first()[0] is True and feeds.anchored(q.limit(0), "partition", "a").first()[0] is False


def test_changed_rows_leave_a_backlog(spark):
    state = spark.createDataFrame([(1, "x"), (2, "y")], "id long, h string")
    snap = spark.createDataFrame([(1, "x"), (2, "z"), (3, "n"), (4, "m")], "id long, h string")
    out, rest = snapshots.changed_rows(state, snap, "id", "h", 2, ["id"])
    assert [r["id"] for r in out.orderBy("id").collect()] == [2, 3] and [r["id"] for r in rest.collect()] == [4]


def test_absence_policy(spark):
    notices = spark.createDataFrame([(1, "sam", "open"), (2, "cdb", "open"), (3, "sam", "open")], "id long, source string, status string")
    absent = spark.createDataFrame([(1, 5), (2, 5)], "id long, last_listed long")
    out = snapshots.tombstones(absent, notices, "id", {"sam": "close", "cdb": "re_read"}).collect()
    assert {(r["id"], r["status"]) for r in out} == {(1, "not_listed"), (2, "re_read")}


def test_shards_and_tampering(spark, tmp_path):
    df = spark.createDataFrame([(i, f"m{i % 3}", i * 1.0) for i in range(50)], "id long, market string, value double")
    schema = T.StructType([df.schema["id"], df.schema["market"], df.schema["value"]])
    listed = sinks.write_shards(df, f"{tmp_path}/s", "market", "id")
    assert sinks.verified(spark, f"{tmp_path}/s", listed, "market", "id", schema).count() == 50
    sinks.write_shards(df.withColumn("value", F.col("value") + (F.col("id") == 7).cast("int")), f"{tmp_path}/s", "market", "id")
    with pytest.raises(ValueError, match="m1"):
        sinks.verified(spark, f"{tmp_path}/s", listed, "market", "id", schema)


def test_month_archive(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(list(x), "id long, day string, v long").withColumn("day", F.to_date("day"))
    sinks.archive_months(rows((1, "2026-01-02", 1), (2, "2026-02-02", 1)), f"{tmp_path}/a", "day", "id", ["v"])
    sinks.archive_months(rows((1, "2026-01-05", 2), (3, "2026-01-09", 1)), f"{tmp_path}/a", "day", "id", ["v"])
    got = spark.read.parquet(f"{tmp_path}/a").collect()
    assert sorted((r["id"], r["v"], str(r["month"])) for r in got) == [(1, 2, "2026-01"), (2, 1, "2026-02"), (3, 1, "2026-01")]


def test_stream_gives_what_a_batch_gives(spark, tmp_path):
    rows = [(i % 7, (i * 37) % 50, f"v{i}" if i % 3 else "", float(i) if i % 4 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "k long, at long, title string, value double").withColumn("seq", F.monotonically_increasing_id())
    df.repartition(5).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    keys, order, columns = ["k"], ["at", "seq"], ["title", "value"]
    incremental.stream_into(spark, source, f"{tmp_path}/t", f"{tmp_path}/c", keys, order, columns).trigger(availableNow=True).start().awaitTermination()
    versions = sorted(int(p.name.split("=")[1]) for p in (tmp_path / "t").iterdir())
    state = incremental.current_state(spark, f"{tmp_path}/t")
    want = sorted(map(tuple, incremental.once(spark.read.parquet(f"{tmp_path}/in"), keys, order, columns).collect()))
    assert len(versions) > 1 and sorted(map(tuple, incremental.facts(state, keys, columns).collect())) == want
    again = incremental.merge_batch(state, spark.read.parquet(f"{tmp_path}/in"), keys, order, columns)
    assert sorted(map(tuple, incremental.facts(again, keys, columns).collect())) == want


def test_versions_come_back(spark):
    rows = [(k, v, {"a": str(v % 3), **({"b": "x"} if v % 2 else {}), **({"c": None} if v == 3 else {})}) for k in range(4) for v in range(6)]
    versions = spark.createDataFrame(rows, "k long, v long, facts map<string,string>")
    pack = history.packed(versions, "k", ["v"], "facts")
    assert pack.where("current").count() == 4 and pack.where("not current and facts is not null").count() == 0
    back = history.unpacked(pack, "k", ["v"], "facts").collect()
    assert sorted((r["k"], r["v"], sorted(r["facts"].items())) for r in back) == sorted((k, v, sorted(f.items())) for k, v, f in rows)


def test_latest_keeps_nulls(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, None), (2, 1, "b")], "k long, at long, x string")
    assert sorted(map(tuple, ordered.latest(df, ["k"], ["at"]).collect()), key=repr) == [(1, 2, None), (2, 1, "b")]
