"""Zip and XML payloads of notices."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def zip_members(spark: SparkSession, path: str, most_members: int = 10_000, most_bytes: int = 45_000_000) -> DataFrame:
    """(path, name, stem, content, fault) of zips under a path; a zip that breaks a bound, or names a path outside, gives a fault only."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for where, content in zip(batch["path"], batch["content"], strict=True):
                rows, fault = [], None
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        members = [m for m in z.infolist() if not m.is_dir()]
                        if len(members) > most_members or sum(m.file_size for m in members) > most_bytes:
                            fault = "too large"
                        elif any(m.filename.startswith("/") or ".." in m.filename.split("/") for m in members):
                            fault = "path"
                        else:
                            rows = [(where, m.filename, m.filename.rsplit("/", 1)[-1].rsplit(".", 1)[0], z.read(m), None) for m in members]
                except zipfile.BadZipFile:
                    fault = "not a zip"
                yield pd.DataFrame(rows or ([(where, None, None, None, fault)] if fault else []), columns=["path", "name", "stem", "content", "fault"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")
    return files.mapInPandas(read, "path string, name string, stem string, content binary, fault string")


def xml_fields(xml: Column, fields: dict[str, str]) -> list[Column]:
    """A column for each name and XPath; empty texts are null."""
    return [F.nullif(F.trim(F.xpath_string(xml, F.lit(p))), F.lit("")).alias(name) for name, p in fields.items()]
