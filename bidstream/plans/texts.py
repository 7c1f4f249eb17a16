"""Queries of text: evidence, rules, relatedness, measures, pages, deadlines."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidstream.functions import text as tx
from bidstream.operators import backfill, checks, classify, history, identity, quality, related, states
from bidstream.operators.capabilities import prefiltered
from bidstream.plans.notices import NOTICES_SQL, notices, now
from bidstream.sources import config
from bidstream.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


STOP = ["the", "and", "that", "with", "for", "this", "from", "der", "die", "und", "les", "des", "que", "los", "las"]
_WORDS_SQL = "list_filter(string_split(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' '), lambda w: length(w) >= 3 AND length(w) <= 44 AND w NOT IN (" + ", ".join(f"'{w}'" for w in STOP) + "))"
_INDEX_SQL = f"""
tok AS (SELECT doc_id, unnest({_WORDS_SQL}) AS term FROM documents),
tf AS (SELECT doc_id, term, 1 + ln(least(count(*), 3)::DOUBLE) AS weight FROM tok GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
idx AS (SELECT doc_id, term, weight, df, ln(1 + (SELECT count(*) FROM documents)::DOUBLE / (1 + df)) AS idf FROM tf JOIN df USING (term)),
norms AS (SELECT doc_id, sqrt(sum(pow(idf * weight, 2))) AS norm FROM idx GROUP BY doc_id)"""


def _index(spark, d):
    return related.indexed(table(spark, d, "documents").select("doc_id", "text"), "doc_id", tx.tokens(F.col("text"), STOP))


@query(f"WITH {_INDEX_SQL} SELECT doc_id, round(norm, 6) AS norm FROM norms")
def tfidf_norms(spark, d):
    return related.norms(_index(spark, d), "doc_id").select("doc_id", F.round("norm", 6).alias("norm"))


@query(f"""
WITH {_INDEX_SQL}, pairs AS (
  SELECT q.doc_id AS query, x.doc_id, sum(q.idf * q.idf * q.weight * x.weight) AS dot, count(*) AS shared
  FROM idx q JOIN idx x ON q.term = x.term AND q.doc_id <> x.doc_id
  WHERE q.doc_id % 20 = 0 AND q.df::DOUBLE / (SELECT count(*) FROM documents) <= 0.45 GROUP BY ALL HAVING count(*) >= 2
), scored AS (
  SELECT query, p.doc_id, shared, round(dot / (n.norm * m.norm), 6) AS text FROM pairs p JOIN norms n ON n.doc_id = p.doc_id JOIN norms m ON m.doc_id = p.query
)
SELECT query, doc_id, shared, text, row_number() OVER (PARTITION BY query ORDER BY text DESC, doc_id)::INTEGER AS rank FROM scored WHERE text >= 0.035 QUALIFY rank <= 10
""")
def related_topk(spark, d):
    """The ten most alike others of each document whose id is a multiple of 20."""
    return related.most_alike(table(spark, d, "documents").select("doc_id", "text"), F.col("doc_id") % 20 == 0, "doc_id", tx.tokens(F.col("text"), STOP))


#: Documents as records: some have a procedure or a buyer, the language is the country, and capabilities go by the id.
_RECORDS_SQL = """
rec AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'p' || doc_id // 15 END AS procedure, CASE WHEN doc_id % 4 < 2 THEN 'b' || doc_id % 61 END AS buyer,
  'n' || doc_id % 17 AS name, CASE WHEN doc_id % 3 = 0 THEN source END AS source, [lang] AS countries, list_filter(['a', 'b', 'c', 'd', 'e'], lambda c: (doc_id * 7 + ord(c)) % 11 < 3) AS capabilities,
  CASE WHEN doc_id % 9 > 0 THEN DATE '2024-01-01' + (doc_id * 37 % 400)::INTEGER END AS date FROM documents)"""
_TITLE_WORDS_SQL = _WORDS_SQL.replace("lower(text)", "lower(split_part(text, chr(10), 1))")


@query(f"""
WITH tok AS (SELECT doc_id, unnest({_WORDS_SQL}) AS term FROM documents), titles AS (SELECT DISTINCT doc_id, unnest({_TITLE_WORDS_SQL}) AS term FROM documents),
tf AS (SELECT doc_id, term, 1 + ln(least(count(*), 3)::DOUBLE) + CASE WHEN t.term IS NULL THEN 0 ELSE 2 END AS weight, t.term IS NOT NULL AS titled FROM tok LEFT JOIN titles t USING (doc_id, term) GROUP BY doc_id, term, t.term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
idx AS (SELECT doc_id, term, weight, titled, df, ln(1 + (SELECT count(*) FROM documents)::DOUBLE / (1 + df)) AS idf FROM tf JOIN df USING (term)),
norms AS (SELECT doc_id, sqrt(sum(pow(idf * weight, 2))) AS norm FROM idx GROUP BY doc_id),
pairs AS (SELECT q.doc_id AS query, x.doc_id, sum(q.idf * q.idf * q.weight * x.weight) AS dot, count(*) AS shared, bool_or(q.titled OR x.titled) AS connected, list(q.term ORDER BY q.df, q.term)[1:3] AS terms
  FROM idx q JOIN idx x ON q.term = x.term AND q.doc_id <> x.doc_id WHERE q.doc_id % 20 = 0 AND q.df::DOUBLE / (SELECT count(*) FROM documents) <= 0.45 GROUP BY ALL),
texts AS (SELECT query, p.doc_id, shared, connected, terms, round(dot / (n.norm * m.norm), 6) AS text FROM pairs p JOIN norms n ON n.doc_id = p.doc_id JOIN norms m ON m.doc_id = p.query),
{_RECORDS_SQL},
ties AS (SELECT q.doc_id AS query, r.doc_id, r.date, coalesce(q.procedure = r.procedure, false) AS procedure, list_has_any(q.countries, r.countries) AS country,
  coalesce(q.buyer = r.buyer, coalesce(q.name = r.name AND q.source = r.source AND list_has_any(q.countries, r.countries), false)) AS buyer,
  list_filter(q.capabilities, lambda c: list_contains(r.capabilities, c)) AS caps, coalesce(text, 0.0) AS text, coalesce(shared, 0) AS shared, coalesce(connected, false) AS connected, terms
  FROM rec q JOIN rec r ON q.doc_id <> r.doc_id LEFT JOIN texts t ON t.query = q.doc_id AND t.doc_id = r.doc_id WHERE q.doc_id % 20 = 0),
scored AS (SELECT query, doc_id, date, text, array_to_string(caps, ',') AS capabilities, array_to_string(coalesce(terms, []), ',') AS terms,
  CASE WHEN procedure THEN 'same_procedure' WHEN buyer THEN 'same_buyer' WHEN country AND len(caps) > 0 THEN 'shared_capability'
    WHEN shared >= 2 AND text >= CASE WHEN connected THEN 0.035 ELSE 0.12 END THEN 'similar_text' END AS relationship,
  round(CASE WHEN procedure THEN 8 WHEN buyer THEN 4 ELSE 0 END + least(2, len(caps) * 0.5) + text * 3 + CASE WHEN country THEN 0.1 ELSE 0 END, 6)::DOUBLE AS score FROM ties)
SELECT query, doc_id, relationship, score, text, capabilities, terms, row_number() OVER (PARTITION BY query ORDER BY score DESC, date DESC NULLS LAST, doc_id)::INTEGER AS rank
FROM scored WHERE relationship IS NOT NULL QUALIFY rank <= 12
""")
def related_whole(spark, d):
    """The twelve records most related to each whose id is a multiple of 20, by procedure, buyer, capability and country, and text."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    i = F.col("doc_id")
    records = docs.select(
        "doc_id", "text", F.when(i % 5 == 0, F.concat(F.lit("p"), F.floor(i / 15))).alias("procedure"), F.when(i % 4 < 2, F.concat(F.lit("b"), i % 61)).alias("buyer"),
        F.concat(F.lit("n"), i % 17).alias("name"), F.when(i % 3 == 0, F.col("source")).alias("source"), F.array("lang").alias("countries"),
        F.filter(F.array(*map(F.lit, "abcde")), lambda c: (i * 7 + F.ascii(c)) % 11 < 3).alias("capabilities"),
        F.when(i % 9 > 0, F.date_add(F.lit("2024-01-01").cast("date"), (i * 37 % 400).cast("int"))).alias("date"),
    )
    title = tx.tokens(F.split_part("text", F.lit("\n"), F.lit(1)), STOP)
    out = related.related_records(records, i % 20 == 0, "doc_id", tx.tokens(F.col("text"), STOP), title)
    return out.withColumn("capabilities", F.array_join("capabilities", ",")).withColumn("terms", F.array_join("terms", ","))


PHRASES = {"licensing": ["apache license", "gnu general public license", "cc by"], "credentials": ["password", "token"]}
_SENTENCES_SQL = "unnest(list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+'), lambda s: trim(s)), lambda s: s <> ''))"


@query(f"""
WITH s AS (SELECT doc_id, {_SENTENCES_SQL} AS quote FROM documents),
h AS (SELECT doc_id, quote, 'licensing' AS capability, p FROM s, (SELECT unnest(['apache license', 'gnu general public license', 'cc by']) AS p)
  UNION ALL SELECT doc_id, quote, 'credentials', p FROM s, (SELECT unnest(['password', 'token']) AS p))
SELECT doc_id, capability, count(DISTINCT p) AS phrases, count(*) AS quotes FROM h
WHERE contains(lower(quote), p) AND regexp_matches(' ' || lower(quote) || ' ', '[^\\p{{L}}\\p{{N}}_]' || p || '[^\\p{{L}}\\p{{N}}_]') GROUP BY doc_id, capability
""")
def phrase_evidence(spark, d):
    docs = table(spark, d, "documents")
    hits = classify.phrase_evidence(classify.segments(docs, "doc_id", "text", F.col("text")), PHRASES).withColumn("phrase", F.explode("phrases"))
    return hits.groupBy("doc_id", "capability").agg(F.count_distinct("phrase").alias("phrases"), F.count("*").alias("quotes"))


RULES = [
    classify.Rule("shouting", detail="!! .*!! "), classify.Rule("table", detail=r" \| .* \| "), classify.Rule("symbols", detail="[$#%&*]{3} "),
    classify.Rule("licensed", detail="(?i)licensed under"), classify.Rule("german", title="(?i)^(der|die|das) ", code_prefix="de"),
]


@query("""
SELECT doc_id, CASE WHEN regexp_matches(text, '!! .*!! ') THEN 'shouting' WHEN regexp_matches(text, ' \\| .* \\| ') THEN 'table'
  WHEN regexp_matches(text, '[$#%&*]{3} ') THEN 'symbols' WHEN regexp_matches(text, '(?i)licensed under') THEN 'licensed'
  WHEN regexp_matches(split_part(text, chr(10), 1), '(?i)^(der|die|das) ') AND starts_with(lang, 'de') THEN 'german' ELSE 'none' END AS label FROM documents
""")
def rule_first_match(spark, d):
    docs = table(spark, d, "documents")
    label = classify.first_rule(RULES, F.split_part("text", F.lit("\n"), F.lit(1)), F.col("text"), F.array("lang"))
    return docs.select("doc_id", F.coalesce(label, F.lit("none")).alias("label"))


@query("""
SELECT doc_id, array_to_string(list_filter([CASE WHEN n_chars < 100 THEN 'short' END, CASE WHEN n_chars > 5000 THEN 'long' END,
  CASE WHEN contains(text, '!! ') THEN 'shouting' END, CASE WHEN coalesce(toxic, 0) = 1 THEN 'toxic' END], lambda x: x IS NOT NULL), ',') AS reasons
FROM documents LEFT JOIN labels USING (doc_id)
""")
def exclusion_reasons(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id", "left")
    found = classify.reasons({
        "short": F.col("n_chars") < 100, "long": F.col("n_chars") > 5000, "shouting": F.col("text").contains("!! "), "toxic": F.col("toxic") == 1,
    })
    return docs.select("doc_id", F.array_join(found, ",").alias("reasons"))


VOCABULARY = {"capabilities": {
    "licensing": {"family": "platform", "explicit": ["gnu general public license", "apache license"], "needs": ["licensed under"]},
    "credentials": {"family": "ai", "needs": ["password", "token"], "contextual": ["secret"], "context": ["key"]},
}}


@query()
def capability_scores(spark, d):
    """Documents as notices: the first line is the title, and the language the code."""
    docs = table(spark, d, "documents").select(
        "doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.regexp_replace("text", r"^[^\n]*\n?", "").alias("description"), F.array("lang").alias("codes")
    )
    out = prefiltered(docs, config.capabilities(VOCABULARY), ("de",))
    return out.select("doc_id", "score", "candidate", "priority", F.array_join("capabilities", ",").alias("capabilities"), F.size("evidence").alias("quotes"))


@query("""
WITH c AS (SELECT text, doc_id, n_chars FROM documents), once AS (SELECT DISTINCT text FROM c)
SELECT doc_id, length(regexp_replace(text, '[^.]', '', 'g')) AS stops FROM c JOIN once USING (text)
""")
def classified_once(spark, d):
    """Equal texts are classified once; a table of results by input is joined back."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    out = classify.classified_once(docs, ["text"], lambda x: x.withColumn("stops", F.length(F.regexp_replace("text", "[^.]", "")).cast("long")))
    return out.select("doc_id", "stops")


@query("""
WITH r AS (SELECT lang, quality = 1 AS truth, NOT (contains(text, '!! ') OR contains(text, ' | ')) AS said FROM documents JOIN labels USING (doc_id)),
c AS (SELECT coalesce(lang, 'all') AS stratum, count(*) FILTER (truth AND said) AS tp, count(*) FILTER (NOT truth AND said) AS fp,
  count(*) FILTER (truth AND NOT said) AS fn, count(*) FILTER (NOT truth AND NOT said) AS tn FROM r GROUP BY GROUPING SETS ((lang), ())),
p AS (SELECT *, tp::DOUBLE / nullif(tp + fp, 0) AS p, nullif(tp + fp, 0)::DOUBLE AS n, tp::DOUBLE / nullif(tp + fn, 0) AS r, nullif(tp + fn, 0)::DOUBLE AS m FROM c)
SELECT stratum, tp, fp, fn, tn, round(p, 6) AS precision,
  round((p + 3.8416 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS precision_low,
  round((p + 3.8416 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS precision_high,
  round(r, 6) AS recall,
  round((r + 3.8416 / (2 * m) - 1.96 * sqrt(r * (1 - r) / m + 3.8416 / (4 * m * m))) / (1 + 3.8416 / m), 6) AS recall_low,
  round((r + 3.8416 / (2 * m) + 1.96 * sqrt(r * (1 - r) / m + 3.8416 / (4 * m * m))) / (1 + 3.8416 / m), 6) AS recall_high FROM p
""")
def confusion_wilson(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang", "text").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    said = ~(F.col("text").contains("!! ") | F.col("text").contains(" | "))
    out = quality.confusion(rows, "lang", F.col("quality") == 1, said)
    return out.withColumn("stratum", F.coalesce("lang", F.lit("all"))).drop("lang")


@query("""
WITH a AS (SELECT doc_id, quality::VARCHAR AS s FROM labels WHERE doc_id % 11 <> 0), b AS (SELECT doc_id, CASE WHEN toxic = 1 THEN '0' ELSE quality::VARCHAR END AS s FROM labels WHERE doc_id % 13 <> 0)
SELECT coalesce(a.s, 'absent') AS was, coalesce(b.s, 'absent') AS "is", count(*) AS n FROM a FULL JOIN b USING (doc_id) GROUP BY ALL
""")
def transition_matrix(spark, d):
    marks = table(spark, d, "labels")
    state = F.when(F.col("toxic") == 1, "0").otherwise(F.col("quality").cast("string"))
    before = marks.where("doc_id % 11 <> 0").select("doc_id", F.col("quality").cast("string").alias("state"))
    return quality.transitions(before, marks.where("doc_id % 13 <> 0").select("doc_id", state.alias("state")), "doc_id", "state")


@query("""
SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('round1|' || doc_id::VARCHAR)) AS turn FROM documents QUALIFY turn <= 5
""")
def blind_sample(spark, d):
    """Five documents of each source, by hash: a sampling operator."""
    return quality.stable_sample(table(spark, d, "documents").select("doc_id", "source"), "doc_id", "source", 5, "round1").select("doc_id", "source", "turn")


@query("""
WITH g AS (SELECT text, ('0x' || substr(sha256('split|' || sha256(text)), 1, 8))::BIGINT % 100 AS bucket, max((doc_id % 50 = 0)::INT) AS tainted FROM documents GROUP BY text)
SELECT doc_id, CASE WHEN tainted = 1 OR bucket >= 20 THEN 'train' ELSE 'test' END AS part FROM documents JOIN g USING (text)
""")
def contamination_split(spark, d):
    """Copies of one text are in one part; a group that was seen is in train."""
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("grp"))
    return quality.split(docs, "grp", F.col("doc_id") % 50 == 0, "split").select("doc_id", "part")


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_id, count(*) OVER (PARTITION BY text) AS copies FROM documents")
def exact_dupes(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    groups = docs.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
    return docs.join(groups, "digest").select("doc_id", "first_id", "copies")


@query("""
WITH w AS (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem WHERE l_returnflag = 'R')
SELECT s_suppkey, n_name, count(l_orderkey) AS awards FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN w ON l_suppkey = s_suppkey GROUP BY ALL
""")
def supplier_identity(spark, d):
    """Awards of each supplier, by identifier."""
    won = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("s_suppkey"), "l_orderkey").distinct().groupBy("s_suppkey").agg(F.count("*").alias("n"))
    named = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return named.join(won, "s_suppkey", "left").select("s_suppkey", "n_name", F.coalesce("n", F.lit(0)).cast("long").alias("awards"))


@query()
def html_clean(spark, d):
    return table(spark, d, "pages").select("page_id", tx.clean("html").alias("text"))


@query("""
WITH p AS (SELECT page_id, regexp_extract(url, '^([A-Za-z]+)://([^/?#]*)([^?#]*)\\??([^#]*)', ['scheme', 'host', 'path', 'query']) AS u FROM pages),
q AS (SELECT page_id, lower(u.scheme) || '://' || lower(u.host) || regexp_replace(u.path, '/+$', '') AS base, lower(u.scheme) IN ('http', 'https') AND u.host <> '' AND NOT contains(u.host, '@') AS good,
  array_to_string(list_sort(list_filter(string_split(u.query, '&'), lambda x: x <> '' AND contains(x, '=') AND NOT regexp_matches(x, '^utm_|^(gclid|fbclid)=|=$'))), '&') AS query FROM p)
SELECT page_id, CASE WHEN NOT good THEN '' WHEN query <> '' THEN base || '?' || query ELSE base END AS url FROM q
""")
def url_canonical(spark, d):
    return table(spark, d, "pages").select("page_id", tx.canonical_url(F.col("url")).alias("url"))


_STATE_SQL = """
SELECT id, CASE rule WHEN 1 THEN 'CANCELLED' WHEN 2 THEN 'AWARDED' WHEN 3 THEN 'EXPIRED' WHEN 4 THEN 'FUTURE' ELSE 'OPEN' END AS state,
  CASE rule WHEN 1 THEN 'the source reports a cancellation' WHEN 2 THEN 'an award notice, not a competition' WHEN 3 THEN 'the response window is over'
    WHEN 4 THEN 'an intention is published, and no competition yet' ELSE 'the source reports an active procedure' END AS reason,
  rule > 3 AND id % 11 > 0 AS opportunity, rule = 2 AND id % 11 > 0 AS award
FROM (SELECT id, CASE WHEN status = 'P' AND priority = '1-URGENT' THEN 1 WHEN status = 'F' THEN 2 WHEN day + 300 <= DATE '2001-06-01' THEN 3 WHEN status = 'P' THEN 4 ELSE 5 END AS rule FROM notices)
"""


@query(f"WITH {NOTICES_SQL} {_STATE_SQL}")
def lifecycle_state(spark, d):
    """Pending urgent notices as cancelled, finished ones as awards, a response window of 300 days; every eleventh is excluded."""
    rows = notices(spark, d)
    status = F.when((F.col("status") == "P") & (F.col("priority") == "1-URGENT"), "cancelled").when(F.col("status") == "O", "active").otherwise("")
    kind = F.when(F.col("status") == "F", "AWARD").when(F.col("status") == "P", "PIPELINE").otherwise("TENDER")
    due, none = F.date_add("day", 300).cast("timestamp_ntz"), F.lit(None).cast("string")
    state = states.state_of(status, kind, F.lit("notice"), none, due, F.col("day").cast("timestamp_ntz"), now("2001-06-01 00:00:00"))
    rows = rows.select("id", state.alias("s"), kind.alias("kind"), status.alias("named"))
    shown = states.audiences(F.col("s.state"), F.col("kind"), F.col("named"), F.col("id") % 11 == 0, F.array().cast("array<string>"), none, none)
    return rows.select("id", "s.state", "s.reason", shown.alias("a")).select("id", "state", "reason", "a.opportunity", "a.award")


@query("SELECT text_id, rows, contents FROM (SELECT doc_id % 100 AS text_id, count(*) AS rows, count(DISTINCT text) AS contents FROM documents GROUP BY 1) WHERE contents > 1")
def page_union_conflict(spark, d):
    """Pages that carry one id for different texts: ids folded to a hundred make some."""
    docs = table(spark, d, "documents").select((F.col("doc_id") % 100).alias("text_id"), "text")
    return history.conflicts(docs, "text_id", F.sha2("text", 256)).select("text_id", "rows", "contents")


@query("SELECT o_orderstatus FROM orders WHERE o_orderstatus = 'F' LIMIT 1")
def manifest_check(spark, d):
    """Partitions that are not as a manifest lists them; one was tampered with."""
    orders = table(spark, d, "orders")
    listed = history.manifest(orders, "o_orderstatus", "o_orderkey")
    first = orders.where("o_orderstatus = 'F'").agg(F.min("o_orderkey").alias("k"))
    tampered = orders.join(F.broadcast(first), F.col("o_orderkey") == F.col("k"), "left").withColumn("o_totalprice", F.when(F.col("k").isNotNull(), F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))).drop("k")
    return history.manifest_faults(tampered, listed, "o_orderstatus", "o_orderkey")


@query("""
SELECT o_orderkey, '"' || o_orderkey || '","' || CASE WHEN o_orderkey % 9 = 0 THEN '''=' || o_orderpriority ELSE replace(o_orderpriority, '-', '"') END || '"' AS line
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN o_orderpriority ELSE replace(o_orderpriority, '-', '""') END AS o_orderpriority FROM orders)
""".replace("replace(o_orderpriority, '-', '\"') END || '\"' AS", "o_orderpriority END || '\"' AS"))
def csv_rows(spark, d):
    """Cells with quotes, and every ninth as a formula would start."""
    text = F.when(F.col("o_orderkey") % 9 == 0, F.concat(F.lit("="), "o_orderpriority")).otherwise(F.replace("o_orderpriority", F.lit("-"), F.lit('"')))
    return table(spark, d, "orders").select("o_orderkey", F.concat_ws(",", tx.csv_cell(F.col("o_orderkey")), tx.csv_cell(text)).alias("line"))


@query("""
SELECT source, count(*) AS files, sum(n_chars)::BIGINT AS bytes, max(n_chars) AS largest,
  CASE WHEN sum(n_chars) >= 150000 THEN 'stop' WHEN sum(n_chars) >= 110000 THEN 'warn' ELSE 'ok' END AS state FROM documents GROUP BY source
""")
def storage_health(spark, d):
    return quality.storage_health(table(spark, d, "documents"), "source", F.col("n_chars"), 110000, 150000)


@query("""
SELECT 'no credentials' AS "check", doc_id FROM documents WHERE regexp_matches(text, 'AKIA[A-Z0-9]{16}|(?i:token|password)\\s*[:=]\\s*["'']?[A-Za-z0-9+/_=-]{16,}')
UNION ALL SELECT 'is prose', doc_id FROM documents WHERE n_chars < 20
""")
def publication_checks(spark, d):
    """Documents that must not be published as they are."""
    rules = {"no credentials": ~F.col("text").rlike(checks.CREDENTIAL), "is prose": F.col("n_chars") >= 20}
    return checks.faults(table(spark, d, "documents"), "doc_id", rules)


@query("""
WITH t AS (SELECT doc_id, sha256(text) AS h, 'en:' || lang AS english FROM documents WHERE lang <> 'en' AND doc_id % 3 > 0)
SELECT d.doc_id, coalesce(t.english, d.lang) AS shown FROM documents d LEFT JOIN t ON t.doc_id = d.doc_id AND t.h = CASE WHEN d.doc_id % 7 = 0 THEN 'changed' ELSE sha256(d.text) END
""")
def translation_overlay(spark, d):
    """A translation counts only for the text that it was made of."""
    docs = table(spark, d, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("made_of"))
    made = docs.where("lang <> 'en' and doc_id % 3 > 0").select("doc_id", "made_of", F.concat(F.lit("en:"), "lang").alias("english"))
    current = docs.withColumn("made_of", F.when(F.col("doc_id") % 7 == 0, "changed").otherwise(F.col("made_of")))
    return backfill.overlaid(current, made, "doc_id", "made_of", ["english"]).select("doc_id", F.coalesce("english_en", "lang").alias("shown"))


@query("""
WITH k AS (SELECT text, min(doc_id) AS g FROM documents GROUP BY text), r AS (SELECT doc_id, text, doc_id % 4 = 0 AS protected FROM documents)
SELECT doc_id FROM r WHERE text NOT IN (SELECT text FROM r WHERE protected)
""")
def protected_pruning(spark, d):
    """What may be pruned: rows that no chain of shared texts ties to a protected one."""
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("key"))
    linked = identity.key_components(docs, "doc_id", "key")
    safe = linked.join(docs.where("doc_id % 4 = 0").select("doc_id"), "doc_id", "left_semi").select("component").distinct()
    return linked.join(safe, "component", "left_anti").select("doc_id")
