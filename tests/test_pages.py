"""Cleaning of whole pages, against patterns in place of a parser."""

import html
import os
import re
import unicodedata

import pytest

DATA = "/root/testdata/sf0.001"


def visible(page):
    page = re.sub(r"(?is)<!--.*?-->|<!doctype[^>]*>", " ", page)
    page = re.sub(r"(?is)<(script|style|noscript)\b[^>]*>.*?</\1\s*>", " ", page)
    return re.sub(r"\s+", "", unicodedata.normalize("NFKC", html.unescape(re.sub(r"(?s)<[^>]*>", " ", page))))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_visible_text_of_all_pages(spark):
    from bidstream.plans import texts

    pages = {r["page_id"]: visible(r["html"]) for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    got = {r["page_id"]: r["text"] for r in texts.html_clean(spark, DATA).collect()}
    assert {k: re.sub(r"\s", "", t) for k, t in got.items()} == pages
    assert all(t == " ".join(t.split()) for t in got.values())


def test_few_bytes_of_pages_are_held_at_once(spark):
    """Cleaning gets as many bytes at once of long pages as of short ones, and not as many rows."""
    from collections.abc import Iterator

    import pyarrow as pa
    from pyspark.sql import functions as F

    from bidstream.functions import text as tx

    for name in ("maxBytesPerBatch", "maxRecordsPerBatch"):
        spark.conf.unset(f"spark.sql.execution.arrow.{name}")

    def told(batches):
        for b in batches:
            yield pa.array([b.nbytes] * len(b), pa.int64())

    told.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    pages = spark.range(1000, numPartitions=1).select(F.concat(F.col("id").cast("string"), F.repeat(F.lit("<p>x</p> "), 1200)).alias("html"))
    row = pages.select(tx.clean("html").alias("text"), F.arrow_udf(told, "long")("html").alias("held")).agg(F.max("held"), F.max(F.length("text")), F.count("text")).first()
    assert row[0] < 5_000_000 and row[1:] == (3 + 2 * 1200, 1000)
