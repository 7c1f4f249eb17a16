"""Queries of the phrase automaton over documents, with vocabularies of thousands of phrases by rule."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from bidstream.operators import families, lexicon
from bidstream.operators.lexicon import AFTER, BEFORE, STILL, Lexicon, Phrase
from bidstream.sources.tables import table

QUERIES, SQL = {}, {}

#: What a phrase of the vocabulary is, by a digit of its digest.
ROLES = ["explicit", "needs", "needs", "contextual", "contextual", "context", "bar", BEFORE, AFTER, STILL]
_ROLES_SQL = ", ".join(f"'{r}'" for r in ROLES)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def use(phrase: str) -> Phrase:
    digest = hashlib.sha256(phrase.encode()).hexdigest()
    return Phrase(phrase, ROLES[int(digest[:6], 16) % len(ROLES)], f"c{int(digest[6:12], 16) % 40}")


def benchmark_lexicon(spark, d, uses) -> Lexicon:
    """All pairs of words next to each other, and all single words, in the items of the benchmark, a table of fixed size; in four languages."""
    rows = table(spark, d, "benchmark").select("text").collect()
    words = [lexicon.folded_words(r["text"]).split() for r in rows]
    return Lexicon(uses(" ".join(w[i : i + n])) for w in words for n in (1, 2) for i in range(len(w) - n + 1))


_FOLD = lambda x: f"trim(regexp_replace(replace(strip_accents(lower({x})), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"
_PLACES_SQL = f"""
b AS (SELECT string_split({_FOLD("text")}, ' ') AS w FROM benchmark),
vocabulary AS (
  SELECT DISTINCT phrase, [{_ROLES_SQL}][('0x' || substr(sha256(phrase), 1, 6))::BIGINT % {len(ROLES)} + 1] AS role, 'c' || ('0x' || substr(sha256(phrase), 7, 6))::BIGINT % 40 AS name FROM (
    SELECT unnest(w) AS phrase FROM b UNION SELECT w[i] || ' ' || w[i + 1] FROM (SELECT w, unnest(range(1, len(w))) AS i FROM b))),
parts AS (SELECT doc_id, unnest(string_split_regex(text, '(?i)[.;:!?\\n]+|,? (?:but|however|aber|mais|pero) ')) AS part, generate_subscripts(string_split_regex(text, '(?i)[.;:!?\\n]+|,? (?:but|however|aber|mais|pero) '), 1) - 1 AS clause FROM documents),
clauses AS (SELECT doc_id, clause, string_split({_FOLD("part")}, ' ') AS w FROM parts),
grams AS (SELECT doc_id, clause, i - 1 AS word, 1 AS words, w[i] AS phrase FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM clauses)
  UNION ALL SELECT doc_id, clause, i - 1, 2, w[i] || ' ' || w[i + 1] FROM (SELECT *, unnest(range(1, len(w))) AS i FROM clauses)),
h AS (SELECT * FROM grams JOIN vocabulary USING (phrase) WHERE phrase <> '')"""


@query(f"WITH {_PLACES_SQL} SELECT phrase, count(*) AS places, count(DISTINCT doc_id) AS docs, count(DISTINCT (doc_id, clause)) AS clauses FROM h GROUP BY phrase")
def phrase_places(spark, d):
    """Where some thousands of phrases stand in all documents, counted by phrase."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    found = docs.select("doc_id", lexicon.places(F.col("text"), benchmark_lexicon(spark, d, use)).alias("p")).select("doc_id", F.explode(F.flatten("p")).alias("h")).select("doc_id", "h.*")
    each = found.groupBy("phrase", "doc_id", "clause").agg(F.count("*").alias("n")).groupBy("phrase", "doc_id").agg(F.sum("n").alias("n"), F.count("*").alias("c"))
    return each.groupBy("phrase").agg(F.sum("n").alias("places"), F.count("*").alias("docs"), F.sum("c").alias("clauses"))


_EVIDENCE_SQL = f"""
{_PLACES_SQL},
proofs AS (SELECT h.* FROM h WHERE role IN ('explicit', 'needs', 'contextual') AND NOT EXISTS (SELECT 1 FROM h a
  WHERE a.doc_id = h.doc_id AND a.clause = h.clause AND a.role = h.role AND a.name = h.name AND a.words > h.words AND a.word <= h.word AND h.word + h.words <= a.word + a.words)),
negations AS (SELECT n.* FROM h n WHERE role IN ('{BEFORE}', '{AFTER}') AND NOT EXISTS (SELECT 1 FROM h s
  WHERE s.role = '{STILL}' AND s.doc_id = n.doc_id AND s.clause = n.clause AND s.word <= n.word AND n.word + n.words <= s.word + s.words)),
negated AS (SELECT DISTINCT p.doc_id, p.clause, p.word, p.phrase FROM proofs p JOIN negations n ON p.doc_id = n.doc_id AND p.clause = n.clause
  AND ((n.role = '{BEFORE}' AND n.word + n.words <= p.word AND p.word - n.word - n.words <= {lexicon.REACH_BEFORE}) OR (n.role = '{AFTER}' AND p.word + p.words <= n.word AND n.word - p.word - p.words <= {lexicon.REACH_AFTER}))),
around AS (SELECT doc_id, clause, name, max((role = 'context')::INT) AS ctx, max((role = 'bar')::INT) AS barred FROM h GROUP BY ALL),
kept AS (SELECT p.*, CASE WHEN p.role = 'contextual' AND a.ctx = 0 THEN 'hint' ELSE p.role END AS strength
  FROM (SELECT * FROM proofs ANTI JOIN negated USING (doc_id, clause, word, phrase)) p JOIN around a USING (doc_id, clause, name) WHERE a.barred = 0)"""


@query(f"""
WITH {_EVIDENCE_SQL}
SELECT doc_id, count(*) AS proofs, count(DISTINCT name) FILTER (strength <> 'hint') AS names, count(*) FILTER (strength = 'hint') AS hints,
  max(CASE strength WHEN 'explicit' THEN 46 WHEN 'needs' THEN 32 WHEN 'contextual' THEN 16 ELSE 0 END) AS points,
  md5(string_agg(name || ':' || strength || ':' || phrase || ':' || clause, ',' ORDER BY clause, word, words DESC, role, name)) AS digest FROM kept GROUP BY doc_id
""")
def capability_evidence(spark, d):
    """Evidence of forty capabilities by thousands of phrases, with contexts, bars and negations, over all documents."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    rows = docs.select("doc_id", lexicon.evidence_of(F.col("text"), benchmark_lexicon(spark, d, use)).alias("e")).where(F.size("e") > 0)
    firm = F.filter("e", lambda e: e["strength"] != "hint")
    text = F.array_join(F.transform("e", lambda e: F.concat_ws(":", e["name"], e["strength"], e["phrase"], e["clause"].cast("string"))), ",")
    return rows.select(
        "doc_id", F.size("e").cast("long").alias("proofs"), F.size(F.array_distinct(F.transform(firm, lambda e: e["name"]))).cast("long").alias("names"),
        (F.size("e") - F.size(firm)).cast("long").alias("hints"), lexicon.points(F.col("e")).alias("points"), F.md5(text.cast("binary")).alias("digest"),
    )


#: The vocabulary of scope with words of the documents for its roles, so that its rules meet in them.
STAND_IN = {
    "delivery": "the, der, le, el, and, und", "software": "of, in, le, la, license, token", "system": "license by, apache license", "digital": "is, das, un, los", "channel": "by, with, par, von, con",
    "joining": "on, mit, pour", "physical": "for, zu, qui", "past": "it, den, en", "paper": "as, ist, est", "form": "he, sie, il", "goods": "was, des, que", "vacancy": "that, dem, du", "care": "are, auf, ou",
    "grant": "or, im, au", "works": "to, ein, une", "existing": "this, als, sur", "uncertain": "at, aus, dans", BEFORE: "her, nicht, ne", AFTER: "his, nach, pas", STILL: "her the",
}


@query()
def scope_rules(spark, d):
    """Kind of scope, exclusion and contexts of all documents, by rules over a small vocabulary that stands in them; tests hold them against plain loops."""
    docs = table(spark, d, "documents").select("doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.regexp_replace("text", r"^[^\n]*\n?", "").alias("description"))
    out = families.scoped(docs, families.vocabulary(STAND_IN))
    return out.select("doc_id", "scope", "excluded", F.array_join(F.transform("contexts", lambda c: F.concat_ws(":", c["clause"].cast("string"), c["context"])), ",").alias("contexts"))
