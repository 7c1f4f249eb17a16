"""Readers of the Parquet tables that the queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The whole table `name` under `sf_dir`; Spark resolves the path, so any file system it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
