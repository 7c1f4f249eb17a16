"""Secret scans: patterns, and two character Markov models that tell random strings from identifiers.

Both models are tables of bigram probabilities; a token's score is the sum of the logarithms of their ratios. The
labelled samples that they are trained from are random strings made by rule and, from a bounded sample of the
documents, words and the identifiers that people make of words.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bidstream.llm.common import documents, lowest_hashes, text_of

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run that is too short fails wherever in it a match begins, so the least length can stand in the pattern.
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
#: Whole runs of token characters, with a digit or a capital after a small letter in them.
TOKEN = r"(?<![\p{L}\p{N}+/_=-])(?=[A-Za-z+/_=-]*[0-9]|[A-Za-z0-9+/_=-]*[a-z][A-Z])[A-Za-z0-9+/_=-]{16,}+(?![\p{L}\p{N}])"

#: Labelled ordinary: words that names in programs and settings are made of, whatever language the documents have.
ORDINARY = """
some other identifier name first last value index count total result error message request response client server user
group account address email phone number date time start end begin finish open close read write create update delete
insert select order customer supplier product price amount currency payment invoice contract notice buyer seller file
path folder directory document page section header footer title text image version release build test debug config
setting option parameter argument function method class object module package library import export default current
previous next parent child node tree list array string integer float boolean table column row record query filter
search match sort limit offset cache queue thread process service manager handler factory builder controller view
model event listener action state status context session connection network database storage memory ordinary public
private static final abstract internal external global local window button label field input output source target
""".split()

#: Characters of the models: + to z by code.
LOW, CHARS = ord("+"), ord("z") - ord("+") + 1


def places(text: Column, pattern: str, order: int, kind: str, group: int = 0, least: int = 0) -> Column:
    """Spans (start, ord, end, kind, token) of a pattern's matches, in code points.

    Spark finds matches but not where they are; the pieces between them give that, as lengths add up.
    """
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    held = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    empty = "array<struct<start:int,ord:int,end:int,kind:string,token:string>>"
    spans = F.aggregate(
        F.arrays_zip(gaps.alias("gap"), found.alias("hit"), held.alias("held")),
        F.struct(F.lit(0).alias("at"), F.array().cast(empty).alias("spans")),
        lambda a, x: F.struct(
            (a["at"] + F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0))).alias("at"),
            F.when(
                F.length(x["held"]) >= least,
                F.concat(a["spans"], F.array(F.struct(
                    (a["at"] + F.length(x["gap"])).alias("start"), F.lit(order).alias("ord"),
                    (a["at"] + F.length(x["gap"]) + F.length(x["hit"])).alias("end"), F.lit(kind).alias("kind"), x["held"].alias("token"),
                ))),
            ).otherwise(a["spans"]).alias("spans"),
        ),
        lambda a: a["spans"],
    )
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(empty))


def labelled_samples(docs: DataFrame, most: int) -> DataFrame:
    """Tokens (token, secret): random strings made by rule, and identifiers of ORDINARY and of all words of `most` documents.

    These documents are those whose ids and texts hash lowest, rows that repeat counted once, so the sample is the same whatever
    the partitions are.
    """
    spark = docs.sparkSession
    digest = F.sha2(F.col("id").cast("string"), 256)
    random = spark.range(0, 4000, 1, 4).select(F.explode(F.array(
        digest, F.substring(F.upper(F.translate(F.base64(F.unhex(digest)), "+/=", "")), 1, 40),
        F.translate(F.base64(F.unhex(digest)), "=", ""), F.substring(F.translate(F.base64(F.unhex(digest)), "+/=", "_-"), 1, 32),
    )).alias("token"), F.lit(1).alias("secret"))
    shuffled = F.transform(F.sequence(F.lit(0), F.lit(len(ORDINARY) - 1)), lambda i: F.struct(F.xxhash64(i, F.col("id")).alias("h"), i.alias("i")))
    listed = spark.range(0, 20, 1, 1).select(F.transform(F.sort_array(shuffled), lambda x: F.get(F.array(*map(F.lit, ORDINARY)), x["i"])).alias("w"))
    words = F.filter(F.regexp_extract_all("text", F.lit("[A-Za-z]{3,}"), F.lit(0)), lambda w: ~w.rlike("[a-z][A-Z]"))
    names = F.array("a", "b", F.concat_ws("_", "a", "b"), F.concat("a", F.initcap("b")), F.concat_ws("-", F.lower("a"), F.col("n").cast("string")), F.upper(F.concat_ws("_", "a", "b")))
    ordinary = (
        lowest_hashes(docs.select("doc_id", "text"), F.xxhash64("doc_id", "text"), most, docs.count())
        .select(words.alias("w")).unionByName(listed)
        .select(F.explode(F.transform("w", lambda w, i: F.struct(w.alias("a"), F.coalesce(F.get("w", i + 1), w).alias("b"), i.alias("n")))).alias("p"))
        .select("p.*").select(F.explode(names).alias("token"), F.lit(0).alias("secret"))
    )
    return random.unionByName(ordinary)


def train(samples: DataFrame, prior: float = 0.5) -> list[float]:
    """The logarithm of the ratio of both models' probabilities, for each pair of characters, row by row."""
    pairs = F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda i: F.substr("token", i, F.lit(2)))
    counts = (
        samples.where(F.length("token") > 1).select("secret", F.explode(pairs).alias("pair"))
        .groupBy("secret", "pair").count().collect()  # at most CHARS * CHARS for each label
    )
    table = [[[prior] * CHARS for _ in range(CHARS)] for _ in range(2)]
    for row in counts:
        a, b = (ord(c) - LOW for c in row["pair"])
        table[row["secret"]][a][b] += row["count"]
    return [
        math.log(table[1][a][b] / sum(table[1][a])) - math.log(table[0][a][b] / sum(table[0][a]))
        for a in range(CHARS) for b in range(CHARS)
    ]


def score(token: Column, ratios: list[float]) -> Column:
    """The token's log-likelihood ratio: above 0, more like a random string than an identifier."""
    table = F.array(*[F.lit(round(x, 3)) for x in ratios])
    at = lambda i: F.ascii(F.substr(token, i, F.lit(1))) - LOW
    return F.aggregate(
        F.sequence(F.lit(1), F.length(token) - 1), F.lit(0.0),
        lambda total, i: total + F.get(table, at(i) * CHARS + at(i + 1)),
    )


def find_secrets(docs: DataFrame, sample_docs: int = 2000, margin: float = 8.0) -> DataFrame:
    """A row for each row of `docs`: doc_id, base and spans, arrays of (start, ord, end, kind, token) by start, then kind.

    base holds the patterns' spans (assign, access, hex); spans holds these and the models' (markov), which overlap
    no base span. Null and empty texts have none, and very long ones are searched whole. Spans that tie in start come by kind, as listed. Repeated rows and ids, null ids and other columns are passed
    over as they are; an empty table gives no rows. sample_docs: at most so many documents give the ordinary words that
    the model is trained from, whole texts of each. margin: the least log-likelihood ratio of a secret.
    """
    ratios = train(labelled_samples(docs, sample_docs))
    text = text_of()
    base = F.concat(places(text, ASSIGN, 0, "assign", 2, 6), places(text, ACCESS, 1, "access"), places(text, HEX, 2, "hex"))
    found = docs.select("doc_id", F.sort_array(base).alias("base"), places(text, TOKEN, 3, "markov").alias("tokens"))
    more = F.filter("tokens", lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])) & (score(t["token"], ratios) > margin))
    return found.select("doc_id", "base", F.sort_array(F.concat("base", more)).alias("spans"))


def _listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return find_secrets(documents(spark, sf_dir)).select(
        "doc_id", n("assign"), n("access"), n("hex"), F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"),
    )
