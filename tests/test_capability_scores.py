"""Capability scores of documents against plain loops over sentences and clauses."""

import os
import re

import pytest
from pyspark.sql import functions as F

from bidstream.operators import scope
from bidstream.operators.capabilities import Capability, prefiltered
from bidstream.plans import texts

DATA = "/root/testdata/sf0.001"
POINTS = {"explicit": 46, "needs": 32, "contextual": 16}


def stands(phrase, text):
    return re.search(rf"(?<!\w){re.escape(phrase)}(?!\w)", text.lower()) is not None


def affirmed(phrase, sentence):
    own = rf"(?<!\w)(?:{re.escape(phrase)})(?!\w)"
    for clause in re.split(scope.CLAUSE, sentence):
        low = clause.strip().lower()
        if re.search(own, low) and not re.search(rf"{scope.NEGATED_BEFORE}[^,]*{own}", low) and not re.search(rf"{own}.*{scope.NEGATED_AFTER}", low):
            return True
    return False


def judged(title, description, lang):
    found = []
    for field, text in (("title", title), ("description", description)):
        for sentence in (s.strip(" ") for s in re.split(r"(?<=[.!?])\s+|\n+", text)):
            for name, c in texts.VOCABULARY["capabilities"].items():
                for basis in POINTS:
                    near = basis != "contextual" or any(w in sentence.lower() for w in c.get("context", ()))
                    found += [(POINTS[basis] + (12 if field == "title" and basis != "contextual" else 0), name, c["family"], basis, p, field, sentence)
                              for p in c.get(basis, ()) if near and stands(p, sentence) and affirmed(p, sentence)]
    families, coded = {x[2] for x in found}, lang.startswith("de")
    score = min(100, max([x[0] for x in found], default=0) + min(24, 6 * max(len(families) - 1, 0)) + (12 if coded else 0))
    strong = {x[2] for x in found if x[3] != "contextual"}
    priority = "platform" if "platform" in strong else "ai" if "ai" in strong else "other"
    names = sorted({x[1] for x in found})
    return score, score >= 12, priority, ",".join(names), sum(min(2, len([x for x in found if x[1] == n])) for n in names)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_scores_of_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang").collect()
    want = {r["doc_id"]: judged(r["text"].split("\n")[0], re.sub(r"^[^\n]*\n?", "", r["text"], count=1), r["lang"]) for r in docs}
    got = {r["doc_id"]: (r["score"], r["candidate"], r["priority"], r["capabilities"], r["quotes"]) for r in texts.capability_scores(spark, DATA).collect()}
    assert got == want and len({w[0] for w in want.values()}) > 3


@pytest.mark.parametrize("clause, want", [("not only a crm", True), ("not a crm", False), ("nicht nur ein crm", True), ("nicht ein crm", False), ("no sólo un crm", True), ("not just a crm but more", True), ("no crm", False)])
def test_not_only_is_no_negation(spark, clause, want):
    assert spark.createDataFrame([(clause,)], "c string").select(scope.says(F.col("c"), scope.words(("crm",)))).first()[0] is want


def test_texts_without_a_phrase_are_not_cut(spark):
    some = [Capability("crm", "platform", ("c.r.m", "crm"), contextual=("cases",), context=("desk",)), Capability("none", "ai")]
    rows = [(1, "A C.R.M", "No crm. Cases at the desk!\nThe CRM"), (2, "cxrym", "cases"), (3, None, None), (4, "", "CRM? crm")]
    out = prefiltered(spark.createDataFrame(rows, "id int, title string, description string").withColumn("codes", F.array().cast("array<string>")), some)
    got = {r["id"]: (r["score"], r["capabilities"], [e["phrase"] for e in r["evidence"]]) for r in out.collect()}
    assert got == {1: (46, ["crm"], ["crm", "cases"]), 2: (0, [], []), 3: (0, [], []), 4: (46, ["crm"], ["crm", "crm"])}
    plan = out._jdf.queryExecution().analyzed().toString()
    asked = [m.start() for m in re.finditer(r"CASE WHEN \(*false OR Contains\(lower\((?:title|description)#", plan, re.I)]
    assert len(asked) == 2 and asked[0] < plan.index("split(")
