"""Evidence of capabilities in notices, and the score that it gives. The vocabulary is configuration."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidstream.functions.text import phrase_hits
from bidstream.operators.classify import IN_TITLE, SCORES, SENTENCE, affirmed, record_score

#: Families that alone, without a code, are no delivery; a record with no other scores CAPPED at most. Fixed.
WEAK, CAPPED = ("pipeline", "staffing", "external_integration"), 10
LEAST = 12


@dataclass(frozen=True)
class Capability:
    """explicit: phrases that name it; needs: phrases of what it is for; context: words that a contextual phrase stands with."""

    name: str
    family: str
    explicit: tuple[str, ...] = ()
    needs: tuple[str, ...] = ()
    contextual: tuple[str, ...] = ()
    context: tuple[str, ...] = ()

    def found(self, sentence: Column) -> Column:
        """Structs (capability, family, basis, phrase, points) of one sentence; negated phrases give none."""
        low = F.lower(sentence)
        near = reduce(lambda a, b: a | b, [low.contains(w) for w in self.context], F.lit(False))
        parts = []
        for basis, phrases, ok in (("explicit", self.explicit, None), ("needs", self.needs, None), ("contextual", self.contextual, near)):
            if not phrases:
                continue
            stands = [F.when(affirmed(sentence, p), F.lit(p)) for p in phrases]
            hits = F.array_intersect(phrase_hits(low, list(phrases)), F.array_compact(F.array(*stands)))
            made = _items(self, basis, hits)
            parts.append(made if ok is None else F.when(ok, made).otherwise(F.array().cast(EVIDENCE)))
        return F.concat(*parts) if parts else F.array().cast(EVIDENCE)


EVIDENCE = "array<struct<capability:string,family:string,basis:string,phrase:string,points:int>>"
QUOTED = "array<struct<points:int,field:string,capability:string,family:string,basis:string,phrase:string,quote:string>>"


def _items(c: Capability, basis: str, hits: Column) -> Column:
    return F.transform(hits, lambda p: F.struct(
        F.lit(c.name).alias("capability"), F.lit(c.family).alias("family"), F.lit(basis).alias("basis"), p.alias("phrase"), F.lit(SCORES[basis]).alias("points"),
    ))


def _quoted(text: Column, field: str, capabilities: list[Capability]) -> Column:
    """All evidence of a text, with the sentence that it stands in; a phrase in the title has IN_TITLE more, but for contextual ones."""
    sentences = F.filter(F.transform(F.split(text, SENTENCE), lambda s: F.trim(s)), lambda s: _holds(s, capabilities))
    more, none = IN_TITLE if field == "title" else 0, F.array().cast(EVIDENCE)

    def of(s: Column) -> Column:
        return F.transform(F.concat(none, *[F.when(_holds(s, [c]), c.found(s)).otherwise(none) for c in capabilities]), lambda e: F.struct(
            (e["points"] + F.when(e["basis"] == "contextual", 0).otherwise(more)).alias("points"), F.lit(field).alias("field"), e["capability"], e["family"], e["basis"], e["phrase"], s.alias("quote"),
        ))

    # a text without the letters of any phrase has no evidence, and is not cut into sentences and clauses to find none
    return F.when(_holds(text, capabilities), F.flatten(F.transform(sentences, of)).cast(QUOTED)).otherwise(F.array().cast(QUOTED))


def _holds(text: Column, capabilities: list[Capability]) -> Column:
    """Whether the letters of any phrase stand in a text, as they have to for any evidence."""
    low = F.lower(text)
    return reduce(lambda a, b: a | b, [low.contains(p) for c in capabilities for p in (*c.explicit, *c.needs, *c.contextual)], F.lit(False))


def prefiltered(
    notices: DataFrame, capabilities: list[Capability], code_prefixes: tuple[str, ...] = (), digital: Column | None = None, exclusions: Column | None = None, best: int = 2,
) -> DataFrame:
    """Notices (title, description, codes ..) with evidence, capabilities, score, candidate and priority.

    evidence: the `best` strongest of each capability. exclusions: an array of reasons, any of which makes the score 0.
    All is worked out in the row; nothing is joined or shuffled.
    """
    found = F.concat(_quoted(F.col("title"), "title", capabilities), _quoted(F.col("description"), "description", capabilities))
    rows = notices.withColumn("all_", F.sort_array(found, asc=False))
    names = F.array_distinct(F.transform("all_", lambda e: e["capability"]))
    top = F.flatten(F.transform(names, lambda n: F.slice(F.filter("all_", lambda e: e["capability"] == n), 1, best)))
    families = F.array_distinct(F.transform("all_", lambda e: e["family"]))
    coded = reduce(lambda a, b: a | b, [_starts("codes", p) for p in code_prefixes], F.lit(False))
    coded = F.coalesce(coded, F.lit(False))
    reasons = exclusions if exclusions is not None else F.array().cast("array<string>")
    points = F.coalesce(F.array_max(F.transform("all_", lambda e: e["points"])), F.lit(0))
    score = record_score(points, F.size(families), coded, digital if digital is not None else F.lit(False), F.size(reasons) > 0)
    weak = (F.size(families) > 0) & (F.size(F.array_except(families, F.array(*map(F.lit, WEAK)))) == 0) & ~coded
    strong = F.transform(F.filter("all_", lambda e: e["basis"] != "contextual"), lambda e: e["family"])
    return rows.select(
        *notices.columns, top.alias("evidence"), F.array_sort(names).alias("capabilities"), F.when(weak, F.least(score, F.lit(CAPPED))).otherwise(score).alias("score"),
        F.when(F.array_contains(strong, "platform"), "platform").when(F.array_contains(strong, "ai"), "ai").otherwise("other").alias("priority"), reasons.alias("exclusions"),
    ).withColumn("candidate", F.col("score") >= LEAST)


def _starts(column: str, prefix: str) -> Column:
    return F.exists(column, lambda c: c.startswith(prefix))
