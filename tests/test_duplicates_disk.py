"""What duplicates shuffle and write: notices a few times in all, and no further labels for components that are settled."""

from pyspark.sql import functions as F

from bidstream.operators import duplicates, identity


def _shuffled(spark):
    return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()


def _notices(spark, n):
    """Notices with titles that do not compress, of two feeds that are alike in pairs."""
    i = F.col("id")
    half = F.floor(i / 2)
    return spark.range(n).select(
        "id", F.concat(F.lit("feed"), i % 2).alias("source"), F.concat(F.lit("Buyer"), half % 50).alias("buyer"), F.concat(*[F.sha2((half + k).cast("string"), 512) for k in range(4)]).alias("title"),
        F.timestamp_seconds(half * 3600).alias("deadline"), (100.0 * (1 + half % 90)).alias("amount"), F.lit("EUR").alias("currency"), F.lit(None).cast("string").alias("lot"), F.lit("").alias("ocid"),
        F.lit("2026-01-01").cast("date").alias("published"),
    )


def test_notices_are_shuffled_few_times(spark):
    notices = _notices(spark, 4000)
    before = _shuffled(spark)
    notices.repartition(4, "id").write.format("noop").mode("overwrite").save()
    whole = _shuffled(spark) - before
    sizes = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    for name in sizes:  # as for tables that are too large for it
        spark.conf.set(name, "-1")
    try:
        rows = {r["id"]: r["group"] for r in duplicates.duplicate_groups(notices).collect()}
    finally:
        for name in sizes:
            spark.conf.unset(name)
    assert rows == {i: i - i % 2 for i in range(4000)}
    # once for the classes, once to meet names, once to cells as what is found, and in some copies as what finds; it was ten times
    assert _shuffled(spark) - before - whole < 7.5 * whole


def test_settled_components_write_no_further_labels(spark, monkeypatch):
    written = []
    monkeypatch.setattr(identity, "stored", lambda df, name, keep=identity.stored: written.append(name) or keep(df, name))
    got = identity.components(spark.createDataFrame([(1, 2), (3, 4), (5, 6)], "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 5}
    assert len(written) <= 3


def test_copies_and_nulls_keep_their_class(spark):
    notices = _notices(spark, 40).withColumn("amount", F.when(F.col("id") % 8 < 6, F.col("amount")))
    doubled = notices.union(notices.withColumn("id", F.col("id") + 1000))
    rows = {r["id"]: r["group"] for r in duplicates.duplicate_groups(doubled).collect()}
    assert len(rows) == 80 and all(rows[i] == rows[i + 1000] for i in range(40))
    assert rows[0] == rows[1] == 0 and rows[6] == 6 and rows[7] == 7
