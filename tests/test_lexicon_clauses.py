"""Marks of places and evidence in long clauses: against plain loops over all pairs, and in time that grows with the places."""

import random
import time

from pyspark.sql import functions as F

from bidstream.operators import lexicon as lx
from bidstream.operators.lexicon import AFTER, BEFORE, STILL
from bidstream.plans import lexicons

ROLES = ["explicit", "needs", "contextual", "context", "bar", BEFORE, AFTER, STILL]


def _plain(found):
    """(negated, inner) of each place, by every pair of places."""
    end = lambda h: h["word"] + h["words"]
    still = [h for h in found if h["role"] == STILL]
    negations = [n for n in found if n["role"] in (BEFORE, AFTER) and not any(s["word"] <= n["word"] and end(n) <= end(s) for s in still)]
    out = {}
    for h in found:
        negated = any(0 <= (h["word"] - end(n) if n["role"] == BEFORE else n["word"] - end(h)) <= (lx.REACH_BEFORE if n["role"] == BEFORE else lx.REACH_AFTER) for n in negations)
        inner = any(a["role"] == h["role"] and a["name"] == h["name"] and a["words"] > h["words"] and a["word"] <= h["word"] and end(h) <= end(a) for a in found)
        out[h["word"], h["words"], h["role"], h["name"]] = negated, inner
    return out


def test_marks_are_those_of_all_pairs():
    r = random.Random(5)
    for _ in range(300):
        spans = {(r.randrange(30), r.randrange(1, 5), r.choice(ROLES), r.choice(["", "a", "b"])) for _ in range(r.randrange(25))}
        found = [{"clause": 0, "word": w, "words": n, "role": role, "name": name, "phrase": "p"} for w, n, role, name in spans]
        want = _plain(found)
        got = lx._marked([dict(h) for h in found])
        assert {(h["word"], h["words"], h["role"], h["name"]): (h["negated"], h["inner"]) for h in got} == want
        assert got == sorted(got, key=lambda x: (x["word"], -x["words"], x["role"], x["name"]))


def test_a_long_clause_takes_time_by_its_places():
    lexicon = lx.Lexicon([lx.Phrase("data", "needs", "c"), lx.Phrase("not", BEFORE), lx.Phrase("not only", STILL)])
    automaton, seconds = lexicon.automaton(), []
    for n in (2_000, 16_000):
        text = "data not x not only y " * n
        began = time.process_time()
        assert len(lx._read(text, automaton)[0]) == 4 * n
        seconds.append(time.process_time() - began)
    assert seconds[1] < 24 * max(seconds[0], 0.02)


def test_evidence_of_texts_is_that_of_their_places(spark):
    r = random.Random(7)
    words = ["alpha", "beta", "gamma", "delta", "no", "yet", "only"]
    phrases = [lx.Phrase(p, role, name) for p in ["alpha", "beta", "alpha beta", "gamma", "no", "yet", "no only", "delta"] for role, name in [(r.choice(ROLES), r.choice(["", "a", "b"])) for _ in range(2)]]
    texts = [" ".join(r.choice([*words, "x", "x.", "y,"]) for _ in range(r.randrange(40))) for _ in range(200)] + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    lexicon = lx.Lexicon(phrases)
    got = df.select("id", lx.evidence_of(F.col("text"), lexicon).alias("e")).orderBy("id").collect()
    want = df.select("id", lx.places(F.col("text"), lexicon).alias("p")).select("id", lx.evidence(F.col("p")).alias("e")).orderBy("id").collect()
    assert got == want and sum(len(x["e"]) for x in got) > 100


def test_texts_are_read_once(spark):
    plan = lexicons.QUERIES["capability_evidence"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
