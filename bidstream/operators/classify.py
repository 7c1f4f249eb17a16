"""Classification of notices by phrases with evidence, and by ordered rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidstream.functions.text import phrase_hits
from bidstream.operators import scope

SENTENCE = r"(?<=[.!?])\s+|\n+"


def segments(df: DataFrame, key: str, field: str, text: Column) -> DataFrame:
    """(key, field, segment, quote): a text's sentences as they stand in it."""
    parts = F.filter(F.transform(F.split(text, SENTENCE), lambda s: F.trim(s)), lambda s: s != "")
    return df.select(key, F.lit(field).alias("field"), F.posexplode(parts).alias("segment", "quote"))


def phrase_evidence(parts: DataFrame, phrases: dict[str, list[str]]) -> DataFrame:
    """Sentences with phrases of a capability: key, field, segment, quote, capability, phrases.

    phrases: configuration; each capability is one expression over the sentence, so nothing is joined.
    """
    found = F.array(*[
        F.struct(F.lit(c).alias("capability"), phrase_hits(F.lower("quote"), listed).alias("phrases")) for c, listed in phrases.items()
    ])
    hits = F.filter(found, lambda x: F.size(x["phrases"]) > 0)
    return parts.withColumn("hit", F.explode(hits)).select("*", "hit.capability", "hit.phrases").drop("hit")


#: A mailbox as mail's own rules have it: atoms joined by dots, and a domain of labels that begin and end with a letter or a digit.
_ATOM, _LABEL = r"[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+", r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
MAILBOX = rf"{_ATOM}(?:\.{_ATOM})*@{_LABEL}(?:\.{_LABEL})+"
#: Text that says nothing of a scope: links, mailboxes, standards, clauses.
NOISE = (r"https?://\S+", MAILBOX, r"\b(?:ISO|IEC|EN|DIN|BS)[ /-]?\d+(?:[-:]\d+)*", r"(?i)\b(?:clause|article|section|§)\s*\d+(?:\.\d+)*")
#: Sentences of how to bid, not of what is bought.
BIDDING = r"(?i)\b(?:submit|upload|register|log ?in|portal|e-?tender\w*|bidders? (?:must|shall|should))\b"


def scope_text(text: Column) -> Column:
    """A text without noise and without sentences of bidding instructions."""
    for pattern in NOISE:
        text = F.regexp_replace(text, pattern, " ")
    return F.array_join(F.filter(F.split(text, SENTENCE), lambda s: ~s.rlike(BIDDING)), " ")


def affirmed(text: Column, phrase: str) -> Column:
    """Whether a phrase stands in a clause that negates it neither before nor after it; a later clause may."""
    return F.exists(scope.clauses(text), lambda c: scope.says(c, scope.words((phrase,))))


def requirements(text: Column, most: int = 5) -> Column:
    """Sentences that set conditions for taking part, the first few."""
    asked = r"(?i)\b(?:must (?:hold|have|be|provide)|is required to|minimum (?:turnover|experience)|certificat\w+|accredit\w+|insurance)\b"
    return F.slice(F.filter(F.transform(F.split(text, SENTENCE), lambda s: F.trim(s)), lambda s: s.rlike(asked)), 1, most)


def traceable(evidence: Column, texts: list[Column]) -> Column:
    """Evidence whose quote stands in one of the texts that it may be of."""
    def stands(e: Column) -> Column:
        out = F.lit(False)
        for t in texts:
            out = out | F.coalesce(t.contains(e["quote"]), F.lit(False))
        return out

    return F.filter(evidence, stands)


@dataclass(frozen=True)
class Rule:
    """Fires if the title matches, and the detail or a code's prefix does; an empty pattern asks nothing."""

    label: str
    title: str = ""
    detail: str = ""
    code_prefix: str = ""

    def fires(self, title: Column, detail: Column, codes: Column) -> Column:
        a = title.rlike(self.title) if self.title else F.lit(True)
        more = [detail.rlike(self.detail)] if self.detail else []
        more += [F.exists(codes, lambda c: c.startswith(self.code_prefix))] if self.code_prefix else []
        return a & (more[0] | more[-1]) if more else a


def first_rule(rules: list[Rule], title: Column, detail: Column, codes: Column) -> Column:
    """The label of the first rule that fires, or null."""
    out = F.when(F.lit(False), F.lit(""))
    for r in rules:
        out = out.when(r.fires(title, detail, codes), F.lit(r.label))
    return out


def reasons(checks: dict[str, Column]) -> Column:
    """Labels of all checks that hold, in their order."""
    return F.array_compact(F.array(*[F.when(p, F.lit(label)) for label, p in checks.items()]))


#: Points of a capability's evidence and of its phrase in the title; fixed.
SCORES = {"explicit": 46, "needs": 32, "contextual": 16}
IN_TITLE = 12


def record_score(best: Column, families: Column, coded: Column, digital: Column, excluded: Column) -> Column:
    """At most 100: the best capability's points, 6 for each further family up to 24, 12 for a code; 12 at least if digital."""
    score = F.least(F.lit(100), best + F.least(F.lit(24), 6 * F.greatest(families - 1, F.lit(0))) + F.when(coded, 12).otherwise(0))
    score = F.when(digital, F.greatest(score, F.lit(12))).otherwise(score)
    return F.when(excluded, F.lit(0)).otherwise(score)


def classified_once(df: DataFrame, inputs: list[str], classify) -> DataFrame:
    """Equal inputs are classified once and joined back: `classify` takes the distinct inputs and adds columns."""
    once = classify(df.select(*inputs).distinct())
    same = [F.col(f"i.{c}").eqNullSafe(F.col(f"o.{c}")) for c in inputs]
    added = [F.col(f"o.{c}") for c in once.columns if c not in inputs]
    return df.alias("i").join(once.alias("o"), same, "left").select("i.*", *added)
