"""The phrase automaton and rules over its places, against plain searches and loops."""

import random

import pytest
from pyspark.sql import functions as F

from bidstream.functions.text import fold_for_index
from bidstream.operators import families, lexicon
from bidstream.operators.lexicon import AFTER, BEFORE, STILL, ClauseRule, Lexicon, Phrase


def read(spark, texts, words, name="places"):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").repartition(3)
    return df.select("id", "text", lexicon.places(F.col("text"), words).alias(name)).cache()


@pytest.mark.parametrize("text", ["Straße ÉTÉ, naïve_x", "ΑΘΉΝΑ ﬁn № 5", "İstanbul  ß", "", "áb", "数据 x\xa0y"])
def test_folds_as_the_index_does(text):
    assert lexicon.folded_words(text).strip() == fold_for_index(text).strip()


def test_places_against_a_plain_search(spark):
    rng = random.Random(3)
    words = ["straße", "Über", "data", "base", "été", "x", "the", "of", "niño"]
    phrases = [Phrase(" ".join(rng.choice(words) for _ in range(rng.randint(1, 3))), rng.choice("rs"), rng.choice("mn")) for _ in range(120)]
    texts = [" ".join(rng.choice([*words, *words, "-", ". ", "; ", "\n"]) for _ in range(rng.randint(0, 60))).upper() for _ in range(60)] + [None, "", " . ! "]
    found = read(spark, texts, Lexicon(phrases))
    got = {(r["id"], h["clause"], h["word"], h["phrase"], h["role"], h["name"]) for r in found.collect() for c in r["places"] for h in c}
    want = set()
    for i, t in enumerate(texts):
        import re
        for c, clause in enumerate(re.split(lexicon.CLAUSE, t or "")):
            w = fold_for_index(clause).split()
            for p in phrases:
                own = fold_for_index(p.text).split()
                want |= {(i, c, a, " ".join(own), p.role, p.name) for a in range(len(w) - len(own) + 1) if w[a : a + len(own)] == own}
    assert got == want


def test_plan_does_not_grow_with_the_vocabulary(spark):
    """Thousands of phrases are found by the same plan as a few."""
    few, many = (Lexicon(Phrase(f"word{i} thing{i}", "explicit", f"c{i % 50}") for i in range(n)) for n in (3, 20_000))
    sizes = [len(read(spark, ["a word1 thing1 b"], v).select(lexicon.evidence(F.col("places"))).explain(True) or "") for v in (few, many)]
    plans = [read(spark, ["x"], v).select("id", lexicon.evidence(F.col("places")).alias("e"))._jdf.queryExecution().toString() for v in (few, many)]
    assert sizes == [0, 0] and abs(len(plans[0]) - len(plans[1])) < 200
    text = " ".join(f"word{i} thing{i};" for i in range(0, 20_000, 7))
    row = read(spark, [text], many).select(F.size(lexicon.evidence(F.col("places"))).alias("n")).first()
    assert row["n"] == len(range(0, 20_000, 7))


def test_evidence_and_negation(spark):
    words = Lexicon([
        Phrase("crm", "explicit", "crm"), Phrase("crm platform", "explicit", "crm"), Phrase("customer database", "needs", "crm"), Phrase("contacts", "contextual", "crm"),
        Phrase("software", "context"), Phrase("telescope", "bar", "crm"), Phrase("payroll", "explicit", "hr"), Phrase("no", BEFORE), Phrase("not", BEFORE), Phrase("not only", STILL),
        Phrase("is excluded", AFTER),
    ])
    cases = {
        "We need a CRM platform": [("crm", "explicit", "crm platform")],
        "No CRM is needed. A customer database is": [("crm", "needs", "customer database")],
        "not only a CRM but payroll": [("crm", "explicit", "crm"), ("hr", "explicit", "payroll")],
        "the CRM is excluded; payroll is not": [("hr", "explicit", "payroll")],
        "not one two three four five CRM": [("crm", "explicit", "crm")],
        "contacts": [("crm", "hint", "contacts")],
        "software for contacts": [("crm", "contextual", "contacts")],
        "software; contacts": [("crm", "hint", "contacts")],
        "a telescope with CRM and payroll": [("hr", "explicit", "payroll")],
        "microcrm crms": [],
    }
    rows = read(spark, list(cases), words).select("id", lexicon.evidence(F.col("places")).alias("e"), lexicon.points(lexicon.evidence(F.col("places")), title=True).alias("p")).orderBy("id").collect()
    assert [[(e["name"], e["strength"], e["phrase"]) for e in r["e"]] for r in rows] == list(cases.values())
    assert [r["p"] for r in rows] == [58, 44, 58, 58, 58, 0, 16, 0, 58, 0]


def by_loops(rule, clause):
    """The places of a rule's subject in a clause's places, by plain loops."""
    end = lambda h: h["word"] + h["words"]

    def close(n, h):
        gap = max(h["word"] - end(n), n["word"] - end(h))
        if rule.reach is not None and gap > rule.reach:
            return False
        return {"before": end(n) <= h["word"], "after": end(h) <= n["word"], None: True}[rule.order]

    return [
        h for h in clause if h["role"] == rule.subject and not h["negated"] and all(any(n["role"] == r and close(n, h) for n in clause) for r in rule.near)
        and not any(b["role"] in rule.bars for b in clause)
    ]


RULES = [
    ClauseRule("a", "software", near=("delivery",), reach=2), ClauseRule("b", "software", near=("channel",), bars=("delivery",), reach=1, order="before"),
    ClauseRule("c", "goods"), ClauseRule("d", "system", near=("digital", "past"), order="after"), ClauseRule("e", "software", bars=("goods", "works")),
]


def test_rules_against_loops(spark):
    rng = random.Random(8)
    roles = ["software", "delivery", "channel", "goods", "system", "digital", "past", "works", BEFORE, AFTER, STILL]
    words = Lexicon([Phrase(f"w{i}", r) for i, r in enumerate(roles)] + [Phrase(f"w{i} w{j}", roles[(i * 5 + j) % len(roles)]) for i in range(11) for j in range(11) if (i + j) % 4 == 0])
    texts = [" ".join(rng.choice([f"w{i}" for i in range(11)] + ["x", "y", ";"]) for _ in range(40)) for _ in range(80)]
    found = read(spark, texts, words)
    rows = found.select("places", *[lexicon.by_clause(F.col("places"), r.where).alias(r.label) for r in RULES], lexicon.first_holding(F.col("places"), RULES[1:4]).alias("first")).collect()
    for r in rows:
        want = {rule.label: [h for c in r["places"] for h in by_loops(rule, c)] for rule in RULES}
        assert {k: r[k] for k in want} == want
        assert r["first"] == next((k for k in "bcd" if want[k]), None)
        for c in r["places"]:
            still = [s for s in c if s["role"] == STILL]
            for h in c:
                live = [n for n in c if n["role"] in (BEFORE, AFTER) and not any(s["word"] <= n["word"] and n["word"] + n["words"] <= s["word"] + s["words"] for s in still)]
                gaps = [h["word"] - n["word"] - n["words"] if n["role"] == BEFORE else n["word"] - h["word"] - h["words"] for n in live]
                limits = [lexicon.REACH_BEFORE if n["role"] == BEFORE else lexicon.REACH_AFTER for n in live]
                assert h["negated"] == any(0 <= g <= most for g, most in zip(gaps, limits))


NOTICES = [
    ("Customer portal", "Design and build of a customer portal for residents.", "delivery", None, ["delivery"]),
    ("Office furniture", "Supply of desks. Bids are submitted through the e-tender portal.", "none", "goods", ["operational use"]),
    ("Office furniture", "Supply of desks and development of an asset database.", "delivery", None, ["delivery"]),
    ("Wartungsvertrag", "Entwicklung einer Fachanwendung für das Bürgeramt", "delivery", None, ["delivery"]),
    ("Gebäudereinigung", "Die Reinigung wird nach Bedarf beauftragt", "none", "goods", []),
    ("Étude", "Développement d'une plateforme de gestion", "delivery", None, ["delivery"]),
    ("Obras", "Desarrollo de una aplicación móvil para el ayuntamiento", "delivery", None, ["delivery"]),
    ("ERP for the region", "Licences", "business_system", None, []),
    ("Digital transformation advice", "Reports", "generic_digital", None, []),
    ("Framework", "No development of software is included.", "none", None, []),
    ("Pumps", "Integration of pumps and pipework", "none", None, []),
    ("Heritage", "History of the database", "none", None, ["past"]),
    ("Something", "The existing platform stays. It may be replaced by an app.", "none", None, ["existing_system", "uncertain"]),
    ("Lot 4", "Catering for schools. Software is not included", "none", "goods", []),
    ("Vacancy: nurse", None, "none", "vacancy", []),
    (None, None, "none", None, []),
]


def test_scope_of_notices(spark):
    df = spark.createDataFrame([(i, t, d) for i, (t, d, *_) in enumerate(NOTICES)], "id int, title string, description string")
    rows = families.scoped(df).orderBy("id").collect()
    assert [(r["title"], r["scope"], r["excluded"], [c["context"] for c in r["contexts"]]) for r in rows] == [(t, s, e, c) for t, _, s, e, c in NOTICES]


def test_scope_query_by_loops(spark):
    """Scope and exclusion of documents as the registered query has them, from their places by loops."""
    from bidstream.plans import lexicons

    d = "/root/testdata/sf0.001"
    words = families.vocabulary(lexicons.STAND_IN)
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("t"), F.regexp_replace("text", r"^[^\n]*\n?", "").alias("d"))
    read_ = docs.select("doc_id", lexicon.places(F.col("t"), words).alias("t"), lexicon.places(F.col("d"), words).alias("d")).collect()
    got = {r["doc_id"]: r for r in lexicons.scope_rules(spark, d).collect()}
    holds = lambda rule, found: any(by_loops(rule, c) for c in found)
    has = lambda role, found: any(h["role"] == role and not h["negated"] for c in found for h in c)
    for r in read_:
        both = r["t"] + r["d"]
        scope = "business_system" if has("system", both) else "delivery" if holds(families.DELIVERS, both) else "generic_digital" if has("digital", both) else "none"
        first = lambda found: next((x.label for x in families.UNRELATED if holds(x, found)), None)
        out = None if holds(families.DELIVERS, both) or has("system", r["t"]) else first(r["t"])
        if out is None and not holds(families.DELIVERS, r["d"]) and not any(h["role"] not in (BEFORE, AFTER, STILL) for c in r["t"] for h in c):
            out = next((x for x in (first([c]) for c in r["d"]) if x), None)
        contexts = []
        for c in r["d"]:
            if not (has("software", [c]) or has("system", [c])):
                continue
            roles = {h["role"] for h in c}
            rule = next((x.label for x in families.NOT_MEANT if by_loops(x, c)), "mention")
            contexts.append(f"{c[0]['clause']}:" + ("uncertain" if "uncertain" in roles else "delivery" if by_loops(families.DELIVERS, c) else "existing_system" if "existing" in roles else rule))
        assert (got[r["doc_id"]]["scope"], got[r["doc_id"]]["excluded"], got[r["doc_id"]]["contexts"]) == (scope, out, ",".join(contexts))


def test_places_of_a_batch_come_in_arrays_of_few_texts():
    import pyarrow as pa

    from bidstream.operators import lexicon as lx

    texts = ["cloud data. " * 3000, None, "", "no", "data"] * 40
    lex = lx.Lexicon([lx.Phrase("cloud", "explicit", "a"), lx.Phrase("data", "needs", "b")])
    got = list(lx._read_batches([pa.array(texts), pa.array(["data"])], lex))
    automaton = lex.automaton()
    assert [x for a in got for x in a.to_pylist()] == [lx._read(t, automaton) if t else [] for t in [*texts, "data"]]
    assert len(got) > 5 and max(len(a) for a in got) < len(texts) / 4
