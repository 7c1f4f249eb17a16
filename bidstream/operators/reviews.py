"""Reviewed decisions, renewals and retention: what people decided holds for the text that they saw."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reviewed(notices: DataFrame, ledger: DataFrame) -> DataFrame:
    """Notices by a ledger (id, source_hash, decision, note): exclude takes out, include and guide attach the note.

    A decision about a text that has changed since is void.
    """
    current = ledger.select("id", "source_hash", "decision", "note")
    out = notices.join(current, ["id", "source_hash"], "left")
    return out.where("decision is null or decision <> 'exclude'").withColumn("included", F.col("decision") == "include").withColumnRenamed("note", "guidance").drop("decision")


def stale_reviews(notices: DataFrame, ledger: DataFrame) -> DataFrame:
    """Ledger rows whose notice has another text now, or is gone."""
    return ledger.join(notices.select("id", "source_hash"), ["id", "source_hash"], "left_anti")


def renewals(notices: DataFrame, now: Column, days: int = 365) -> DataFrame:
    """Contracts that end within so many days, as inferred future notices."""
    left = F.date_diff(F.to_date("contract_end"), F.to_date(now))
    return notices.where(left.between(0, days)).select(
        F.concat("id", F.lit(":renewal")).alias("id"), F.col("id").alias("related_id"), "title", "buyer_name", F.lit("RENEWAL_SIGNAL").alias("signal_type"), left.alias("days_left")
    )


def partition_cover(wanted: list[str], partitions: dict[str, set[str]]) -> list[str]:
    """Partitions that together hold the wanted areas, each area once where that is possible: largest first.

    A choice among configured markets, made before any table is read.
    """
    left, out = set(wanted), []
    for name, areas in sorted(partitions.items(), key=lambda p: (-len(p[1]), p[0])):
        if areas <= left and areas:
            out.append(name)
            left -= areas
    return out + [name for name, areas in sorted(partitions.items()) if areas & left and name not in out]


def disposable(notices: DataFrame, conditions: list[Column], protected: DataFrame, component: str) -> DataFrame:
    """Rows that meet all conditions and share no component with a protected row."""
    ok = F.lit(True)
    for c in conditions:
        ok = ok & F.coalesce(c, F.lit(False))
    return notices.where(ok).join(protected.select(component).distinct(), component, "left_anti")
