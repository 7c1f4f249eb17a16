"""The corpus pipeline: quality, line dedup, near-duplicates, mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. In all stages a null text
counts as an empty one, a text is read whole however long it is, further columns of docs stay as they are whatever they are called, and an
empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidstream.llm import lines, mixing, neardup, packing, quality
from bidstream.llm.common import documents, labels, stored

#: The classifier, the mix and the packing are not for SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Each row is judged by its text alone, so rows that repeat, share an id or have none fare alike; an empty text has a score as well. A score at the
    threshold stays.
    """
    return quality.classify(docs, labels(spark, sf_dir)).where("quality_predicted = 1").select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated lines go from the texts; the documents stay, an emptied one too, and a null text stays null.

    Copies come in order of ids, those of no id last; of rows with one id and text the first keeps its lines, and the others are emptied.
    """
    rest = lines.dedup_lines(docs).select(*docs.columns)
    return rest.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays, of the least id, and of its texts the one with most shingles; other texts of its id do too.

    Texts without words are linked with nothing; they go if their id has a text with words, and else one of them stays. Rows of no id all stay.
    """
    return neardup.deduplicated_rows(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix takes them: not at all, or up to twice.

    Null sources are one source, the last. Documents without words are taken by no mix. Rows that repeat are rows of their own; ties are
    settled by hashes, alike on every run.
    """
    return mixing.mixed_documents(docs)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences, a row for each piece; a document without text is one piece, its end.

    Rows that repeat, share an id or have none are packed each by itself, in the order in which their partition has them.
    """
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("near dedup", near_stage),
    ("mixing", mix_stage),
    ("packing", pack_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table documents, each written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
