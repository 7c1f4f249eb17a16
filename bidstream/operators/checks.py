"""What must hold of published notices, as queries that give the rows that break it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidstream.operators.tiers import permitted_url

#: Shapes of credentials that no published text may hold.
CREDENTIAL = r"AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|-----BEGIN [A-Z ]*PRIVATE KEY-----|(?i:api_?key|secret|token|password)\s*[:=]\s*[\"']?[A-Za-z0-9+/_=-]{16,}"


def faults(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(check, key) of rows that break a rule; a rule holds if it is true, and an unknown answer breaks it. One scan."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return df.select(F.explode(broken).alias("check"), F.col(key))


def publication_rules(hosts: list[str], texts: list[str]) -> dict[str, Column]:
    """Rules of notices with evidence, documents, deadlines, a source and texts."""
    evidence_stands = F.forall("evidence", lambda e: reduce(lambda a, b: a | b, [F.coalesce(F.col(t).contains(e["quote"]), F.lit(False)) for t in texts]))
    return {
        "evidence is in its text": evidence_stands,
        "evidence has a source": (F.size("evidence") == 0) | F.col("source").isNotNull(),
        "links are permitted": F.forall("documents", lambda d: permitted_url(d["url"], hosts)),
        "no instant without a clock": F.forall("deadlines", lambda d: d["instant"].isNull() | (d["precision"] == "instant")),
        "no credentials": reduce(lambda a, b: a & b, [~F.coalesce(F.col(t).rlike(CREDENTIAL), F.lit(False)) for t in texts]),
    }


def repeated_ids(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("rows")).where("rows > 1")


def unlike_members(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that only one of two tables has: none if they are of the same notices."""
    one = lambda x, y, side: x.select(key).distinct().join(y.select(key), key, "left_anti").withColumn("only_in", F.lit(side))
    return one(a, b, "first").union(one(b, a, "second"))
