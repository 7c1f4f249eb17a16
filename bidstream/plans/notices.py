"""Test tables seen as notices: orders are notices of customers as buyers, line items lots, suppliers winners."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidstream.sources.tables import table

#: Fixed for the queries that need a now.
NOW = "2001-06-01 12:00:00"
EVENTS_NOW = "2024-01-31 00:00:00"

#: Markets and the regions in them; they overlap.
MARKETS = [("AFRICA", "AFRICA"), ("AMERICA", "AMERICA"), ("ASIA", "ASIA"), ("EUROPE", "EUROPE"), ("MIDDLE EAST", "MIDDLE EAST"),
           ("ATLANTIC", "AMERICA"), ("ATLANTIC", "EUROPE"), ("EAST", "ASIA"), ("EAST", "MIDDLE EAST")]
MARKETS_SQL = "(VALUES " + ", ".join(f"('{m}', '{a}')" for m, a in MARKETS) + ") AS markets(market, r_name)"


def markets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MARKETS, "market string, r_name string")


def now(value: str = NOW):
    return F.lit(value).cast("timestamp_ntz")


def areas(spark: SparkSession, d: str) -> DataFrame:
    """Nations with their regions' names."""
    return table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")


def notices(spark: SparkSession, d: str) -> DataFrame:
    """id, buyer, segment, region, nation, status, value, day, priority."""
    orders, buyers = table(spark, d, "orders"), table(spark, d, "customer")
    return (
        orders.join(buyers, F.col("o_custkey") == F.col("c_custkey")).join(areas(spark, d), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(F.col("o_orderkey").alias("id"), F.col("c_custkey").alias("buyer_id"), F.col("c_name").alias("buyer"), F.col("c_mktsegment").alias("segment"),
                F.col("r_name").alias("region"), F.col("n_name").alias("nation"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("value"),
                F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("priority"))
    )


NOTICES_SQL = """notices AS (
  SELECT o_orderkey AS id, c_custkey AS buyer_id, c_name AS buyer, c_mktsegment AS segment, r_name AS region, n_name AS nation,
    o_orderstatus AS status, o_totalprice AS value, o_orderdate::DATE AS day, o_orderpriority AS priority
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""
