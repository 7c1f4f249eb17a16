"""Line dedup by a suffix array over sequences of line ids.

Prefix doubling ranks the runs of 1, 2, 4 ... lines that start at each place: a run of 2k lines is the pair of the ranks
of the runs of k lines there and k lines on, and its rank is its number in a range-partitioned sort of the pairs. So
ranks follow the order of the suffixes, line by line, lines being ordered by their ids (a hash). The array is sparse: a place
whose run stands nowhere else has no common prefix that long with any other, and goes to no further round. The places of
one rank are an interval of the suffix array with a common prefix of that many lines.

The intervals between the powers of two are found from the longest down: the places of an interval are split by the rank
of what follows the common prefix, in ever shorter steps. An interval's first place, by document and line, keeps its
copy. So each place gets the longest prefix of its suffix that an earlier place has too. Those that are not part of one
that starts further left are the maximal repeated runs, and go if they are not too short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bidstream.llm.common import documents, stored, text_of

#: A maximal repeated run goes if its lines have so many characters in all, white space not counted.
MIN_CHARS = 40
LAST = (1 << 63) - 1
PLACE = ["ord_", "th_", "pos"]
BLANK = " \t\n\x0b\x0c\r"


def _keyed(docs: DataFrame) -> DataFrame:
    """The whole row, which may have these names as well, ord_, its id with null last, th_, which tells texts of one id apart, and text."""
    whole = F.struct(*[F.col(c) for c in docs.columns]).alias("row_")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("ord_"), F.xxhash64(text_of()).alias("th_"), "text", whole)


def line_ids(docs: DataFrame) -> DataFrame:
    """(ord_, th_, pos, n1, n2): the id of each line, 128 bits. Rows of one id and text count once."""
    rows = _keyed(docs).select("ord_", "th_", F.posexplode(F.split(text_of(), "\n")).alias("pos", "line"))
    return rows.select(*PLACE, F.xxhash64("line").alias("n1"), F.xxhash64(F.lit(1), "line").alias("n2")).dropDuplicates(PLACE)


def ranked(named: DataFrame, name: list[str]) -> DataFrame:
    """(ord_, th_, pos, rank, first) of places whose name another place has too; rank follows the order of the names.

    A name is counted map-side, and the names' table is sorted by ranges, so a hot name is one row of it. The table is
    read from the shared folder, so that Spark can split the join's hot side. first: the name's first place.
    """
    groups = named.groupBy(*name).agg(F.count("*").alias("n"), F.min(F.struct(*PLACE)).alias("first")).where("n > 1")
    groups = groups.drop("n").orderBy(*name).withColumn("rank", F.monotonically_increasing_id())
    return stored(named.join(stored(groups, "line-ranks"), name).select(*PLACE, "rank", "first"), "line-places")


def doubled(level: DataFrame, lines: int) -> DataFrame:
    """Of places ranked by runs of `lines` lines, those whose run of twice as many is repeated, ranked by that."""
    after = level.select("ord_", "th_", (F.col("pos") - lines).alias("pos"), F.col("rank").alias("then"))
    return ranked(level.select(*PLACE, "rank").join(after, PLACE).withColumnRenamed("rank", "now"), ["now", "then"])


def suffix_levels(docs: DataFrame) -> list[DataFrame]:
    """Places ranked by runs of 1, 2, 4 ... lines, as long as any run is repeated; the last is empty."""
    levels, lines = [ranked(stored(line_ids(docs), "line-ids"), ["n1", "n2"])], 1
    while levels[-1].limit(1).count():
        levels.append(doubled(levels[-1], lines))
        lines *= 2
    return levels


def repeated_suffixes(levels: list[DataFrame]) -> DataFrame:
    """(ord_, th_, pos, lines): how many lines from a place on stand at an earlier place too, the most; only where any do.

    A row of `state` is a place in an interval, that is named by its first place and the length of its prefix. A place
    that shares more with others goes on to their interval; its first place is there too, and stays where it was.
    """
    here, later = F.struct(*PLACE), F.struct(*PLACE) != F.col("first")
    state, out = None, None
    for k in range(len(levels) - 1, -1, -1):
        step = 1 << k
        if state is not None:
            then = levels[k].select("ord_", "th_", F.col("pos").alias("at"), F.col("rank").alias("then"))
            parted = state.withColumn("at", F.col("pos") + F.col("lines")).join(then, ["ord_", "th_", "at"], "left").drop("at")
            inner = (
                parted.where("then is not null").groupBy("first", "lines", "then")
                .agg(F.min(here).alias("inner"), F.count("*").alias("n")).where("n > 1").drop("n")
            )
            stays = F.struct("first", "lines")
            goes = F.struct(F.col("inner").alias("first"), (F.col("lines") + step).cast("int").alias("lines"))
            both = F.when(F.col("inner").isNull(), F.array(stays)).when(here == F.col("inner"), F.array(stays, goes)).otherwise(F.array(goes))
            state = parted.join(inner, ["first", "lines", "then"], "left").select(*PLACE, F.explode(both).alias("in")).select(*PLACE, "in.*")
        # places that share this many lines with an earlier one, but not twice as many, and their intervals' first places
        new = levels[k].where(later)
        if k + 1 < len(levels):
            new = new.join(levels[k + 1].where(later).select(*PLACE), PLACE, "left_anti")
        new = new.select(*PLACE, "first", F.lit(step).alias("lines"))
        if k == 0:
            ones = new.select(*PLACE, "lines")
            return ones if state is None else ones.unionByName(state.where(later).select(*PLACE, "lines"))
        new = new.unionByName(new.select("first.*", "first", "lines").distinct())
        state = stored(new if state is None else state.unionByName(new), "line-intervals")
    return out


def maximal_runs(suffixes: DataFrame) -> DataFrame:
    """(ord_, th_, runs): a text's repeated runs (start, stop) that are part of none that starts further left, in order."""
    stops = suffixes.groupBy("ord_", "th_", (F.col("pos") + F.col("lines")).alias("stop")).agg(F.min("pos").alias("start"))
    return stops.groupBy("ord_", "th_").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("runs"))


def _gaps(runs: str, n: Column) -> Column:
    """(start, length) of what lies between runs, whose starts and stops rise, and after the last of `n` lines."""
    ends = F.concat(F.transform(runs, lambda r: r["start"]), F.array(n))
    gap = lambda end, i: F.struct(
        F.coalesce(F.get(runs, i - 1)["stop"], F.lit(0)).alias("start"),
        F.greatest(F.lit(0), end - F.coalesce(F.get(runs, i - 1)["stop"], F.lit(0))).alias("length"),
    )
    return F.transform(ends, gap)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """`docs` with its text less later copies of lines, and lines_n, lines_removed, lines_runs and lines_longest.

    Lines end at line feeds; a null text is one empty line, and stays null. A maximal repeated run goes, but for the first copy
    of each of its parts, if it has `min_chars` characters besides white space. The order of copies is that of ids, null ids
    last, then of a hash of the text, so texts of one id come in an order of no meaning, then of lines. Rows of one id
    and text are copies of one another, and one of them stays. An empty table gives no rows. lines_runs: the runs
    (start, stop) that went, which may overlap; lines_longest: how many lines the longest repeated run has that an
    earlier place has too, gone or not.
    """
    found = maximal_runs(repeated_suffixes(suffix_levels(docs)))
    nth = F.row_number().over(W.partitionBy("ord_", "th_").orderBy("ord_"))
    runs_type = "array<struct<start: int, stop: int>>"
    rows = _keyed(docs).join(found, ["ord_", "th_"], "left").withColumn("nth_", nth).withColumn("lines_", F.split(text_of(), "\n"))
    n = F.size("lines_")
    whole = F.array(F.struct(F.lit(0).alias("start"), n.alias("stop"))).cast(runs_type)
    rows = rows.withColumn("all_", F.when(F.col("nth_") > 1, whole).otherwise(F.coalesce(F.col("runs").cast(runs_type), F.array().cast(runs_type))))
    text_in = lambda r: F.array_join(F.slice("lines_", r["start"] + 1, r["stop"] - r["start"]), "")
    rows = rows.withColumn("runs_", F.filter("all_", lambda r: F.length(F.translate(text_in(r), BLANK, "")) >= min_chars))
    rows = rows.withColumn("gaps_", _gaps("runs_", n))
    left = F.aggregate("gaps_", F.lit(0), lambda s, g: s + g["length"])
    kept = F.array_join(F.flatten(F.transform("gaps_", lambda g: F.slice("lines_", g["start"] + 1, g["length"]))), "\n")
    text = F.when(F.col("text").isNull() | (F.size("runs_") == 0), F.col("text")).otherwise(kept)
    longest = F.coalesce(F.array_max(F.transform("all_", lambda r: r["stop"] - r["start"])), F.lit(0))
    return rows.select(
        *[text.alias(c) if c == "text" else F.col(f"row_.{c}") for c in docs.columns], n.cast("long").alias("lines_n"),
        (n - left).cast("long").alias("lines_removed"), F.col("runs_").alias("lines_runs"), longest.cast("long").alias("lines_longest"),
    )


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir)).select(
        "doc_id", F.col("lines_n").alias("n_lines"), F.col("lines_removed").alias("n_removed"), F.size("lines_runs").cast("long").alias("n_runs"),
        F.col("lines_longest").alias("longest_run"), F.sha2(text_of().cast("binary"), 256).alias("kept_sha256"),
    )


OP2_SQL = r"""
WITH lines AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents
), places AS (
  SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS line FROM lines
), pairs AS (
  SELECT a.doc_id, a.pos, b.doc_id AS of_doc, a.pos - b.pos AS shift
  FROM places a JOIN places b ON a.line = b.line AND (b.doc_id < a.doc_id OR (b.doc_id = a.doc_id AND b.pos < a.pos))
), islands AS (
  SELECT doc_id, pos, of_doc, shift, pos - row_number() OVER (PARTITION BY doc_id, of_doc, shift ORDER BY pos) AS island FROM pairs
), ends AS (
  SELECT doc_id, pos, max(pos) OVER (PARTITION BY doc_id, of_doc, shift, island) + 1 AS stop FROM islands
), reach AS (
  SELECT doc_id, pos, max(stop) AS stop FROM ends GROUP BY doc_id, pos
), runs AS (
  SELECT doc_id, min(pos) AS start, stop FROM reach GROUP BY doc_id, stop
), sized AS (
  SELECT doc_id, start, stop, length(regexp_replace(array_to_string(l[start + 1 : stop], ''), '[\x09-\x0D\x20]', '', 'g')) AS chars
  FROM runs JOIN lines USING (doc_id)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(start, stop)) AS pos FROM sized WHERE chars >= 40
), per_doc AS (
  SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id
), per_run AS (
  SELECT doc_id, count(*) FILTER (chars >= 40) AS n_runs, max(stop - start) AS longest_run FROM sized GROUP BY doc_id
), kept AS (
  SELECT p.doc_id, string_agg(p.line, chr(10) ORDER BY p.pos) AS text
  FROM places p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.pos = g.pos WHERE g.pos IS NULL GROUP BY p.doc_id
)
SELECT d.doc_id, len(d.l)::BIGINT AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_runs, 0) AS n_runs,
  coalesce(longest_run, 0) AS longest_run, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM lines d LEFT JOIN per_doc USING (doc_id) LEFT JOIN per_run USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
