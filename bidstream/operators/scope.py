"""What a notice is about, by families of rules over clauses. All vocabularies are configuration; the defaults are examples in English,
German, French and Spanish.

A clause is a piece of text between stops. A rule reads one clause at a time, so that words of different clauses do not add up, and
a clause that negates says nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

CLAUSE = r"(?i)[.;:!?\n]+|,? (?:but|however|aber|mais|pero) "
#: Words before a phrase, and after one, that negate a clause; "not only" and its like do not.
NEGATED_BEFORE = r"\b(?!(?:not (?:only|just)|nicht nur|no s[oó]lo|no solamente)\b)(?:no|not|without|excluding|except|neither|never|kein\w*|ohne|nicht|sans|aucun\w*|sin|ning[uú]n\w*)\b"
NEGATED_AFTER = r"\b(?:(?:is|are|was|were|will be|shall be) (?:excluded|not)|not (?:required|included|commissioned|part)|entf[aä]llt|exclue?s?|no requerid[oa]s?)\b"


def words(listed: tuple[str, ...]) -> str:
    """A pattern for any of the words or phrases, whole."""
    return r"(?U)(?<!\w)(?:" + "|".join(re.escape(w.lower()) for w in sorted(listed, key=lambda w: (-len(w), w))) + r")(?!\w)"


def clauses(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), CLAUSE), lambda c: F.trim(c)), lambda c: c != "")


def says(clause: Column, pattern: str) -> Column:
    """Whether a clause has the pattern, and neither negates it before nor after it."""
    low = F.lower(clause)
    body = pattern.removeprefix("(?U)")
    return low.rlike(pattern) & ~low.rlike(rf"(?U){NEGATED_BEFORE}[^,]*{body}") & ~low.rlike(rf"(?U){body}.*{NEGATED_AFTER}")


@dataclass(frozen=True)
class Sense:
    """A phrase with more than one meaning: it counts in clauses with one of `needs`, if any are named, and with none of `bars`.

    cased: it counts only as it is written, such as an acronym. reach: how many words lie between it and a word of `needs` at most.
    """

    phrase: str
    needs: tuple[str, ...] = ()
    bars: tuple[str, ...] = ()
    cased: bool = False
    reach: int | None = None

    def meant(self, clause: Column) -> Column:
        own = words((self.phrase,))
        out = clause.rlike(rf"(?<!\w){re.escape(self.phrase)}(?!\w)") if self.cased else says(clause, own)
        if self.needs:
            near = words(self.needs)
            if self.reach is None:
                out = out & F.lower(clause).rlike(near)
            else:
                gap, a, b = rf"(?:\W+\w+){{0,{self.reach}}}\W+", own.removeprefix("(?U)"), near.removeprefix("(?U)")
                out = out & F.lower(clause).rlike(rf"(?U)(?:{a}{gap}{b}|{b}{gap}{a})")
        return out & ~F.lower(clause).rlike(words(self.bars)) if self.bars else out


def meant(text: Column, senses: list[Sense]) -> Column:
    """The phrases that some clause of a text means, in the order of the list."""
    parts = clauses(text)
    return F.array_compact(F.array(*[F.when(F.exists(parts, s.meant), F.lit(s.phrase)) for s in senses]))


#: Verbs of delivery and the things that are delivered, by language.
DELIVERY = {
    "en": (("deliver", "build", "develop", "implement", "design", "configure", "migrate", "supply and install"), ("software", "platform", "application", "digital service", "website", "database", "api", "prototype")),
    "de": (("entwicklung", "einführung", "implementierung", "programmierung"), ("software", "plattform", "fachverfahren", "webportal", "datenbank")),
    "fr": (("développement", "réalisation", "mise en œuvre", "déploiement"), ("logiciel", "plateforme", "application", "site internet", "progiciel")),
    "es": (("desarrollo", "implantación", "diseño", "despliegue"), ("software", "plataforma", "aplicación", "portal web", "sistema informático")),
}


def delivers(text: Column, languages: dict = DELIVERY, gap: int = 6) -> Column:
    """The first clause that commissions a thing of software: a verb or noun of delivery, and at most `gap` words on the thing."""
    hits = []
    for verbs, things in languages.values():
        verb = r"(?<!\w)(?:" + "|".join(re.escape(v) for v in verbs) + r")\w*"
        hits.append(rf"(?U){verb}(?:\W+\w+){{0,{gap}}}?\W+{words(things).removeprefix('(?U)')}")
    return F.get(F.filter(clauses(text), lambda c: reduce(lambda a, b: a | b, [says(c, h) for h in hits])), 0)


@dataclass(frozen=True)
class ScopeRule:
    """Fires if the title has one of `title`, and the text one of `text` or a code one of the prefixes; not if either has one of `unless`.

    What is not named is not asked for. Of `text` and `codes` one is enough.
    """

    label: str
    title: tuple[str, ...] = ()
    text: tuple[str, ...] = ()
    codes: tuple[str, ...] = ()
    unless: tuple[str, ...] = ()

    def fires(self, title: Column, text: Column, codes: Column) -> Column:
        whole = F.lower(F.concat_ws(". ", title, text))
        out = F.lower(title).rlike(words(self.title)) if self.title else F.lit(True)
        either = [F.exists(clauses(text), lambda c: says(c, words(self.text)))] if self.text else []
        either += [F.coalesce(F.exists(codes, lambda c: c.rlike("^(?:" + "|".join(map(re.escape, self.codes)) + ")")), F.lit(False))] if self.codes else []
        if either:
            out = out & (either[0] | either[-1])
        return out & ~whole.rlike(words(self.unless)) if self.unless else out


#: Goods and works without a part of software: in the title, and not undone by a delivery in the text.
SUPPLIES = ScopeRule("goods or works", title=("furniture", "vehicles", "uniforms", "roof", "road", "road works", "catering", "cleaning", "fuel", "möbel", "fahrzeuge", "mobilier", "véhicules"), unless=("software", "platform", "telematics"))
#: Ordered families; the first that fires gives the reason.
EXCLUSIONS = [
    ScopeRule("vacancy", title=("vacancy", "job", "stellenangebot", "recruitment of"), unless=("contractor", "consultancy", "agency")),
    SUPPLIES,
    ScopeRule("works by code", title=("construction", "refurbishment", "maintenance", "repair"), text=("building", "bridge", "pavement"), codes=("45", "50")),
    ScopeRule("care or training", text=("training course", "medical treatment", "social care", "legal advice"), unless=("software", "platform", "e-learning system")),
    ScopeRule("grant", title=("grant", "funding call", "subvention"), unless=("grant management",)),
]


def exclusion(title: Column, text: Column, codes: Column, rules: list[ScopeRule] = EXCLUSIONS) -> Column:
    """The label of the first rule that fires, or null; a commissioned delivery of software in the text keeps a notice in."""
    out = F.when(delivers(F.concat_ws(". ", title, text)).isNotNull(), F.lit(None).cast("string"))
    for r in rules:
        out = out.when(r.fires(title, text, codes), F.lit(r.label))
    return out


#: What says that a buyer wants something digital, without what; and systems of business that it may be about.
DIGITAL, SYSTEMS = ("digital", "it services", "information technology", "digitalisation", "digitalisierung", "numérique"), (
    "erp", "crm", "case management", "records management", "payroll system", "booking system", "finance system",
)


def scope_kind(title: Column, text: Column) -> Column:
    """business_system, delivery, generic_digital or none, the first that holds."""
    whole = F.concat_ws(". ", title, text)
    some = lambda listed: F.exists(clauses(whole), lambda c: says(c, words(listed)))
    return (
        F.when(some(SYSTEMS), "business_system").when(delivers(whole).isNotNull(), "delivery").when(some(DIGITAL), "generic_digital").otherwise("none")
    )


def section(text: Column, heading: str, others: tuple[str, ...]) -> Column:
    """What stands under a heading, up to the next of the other headings; null without the heading."""
    stop = "|".join(re.escape(o) for o in others)
    found = F.regexp_extract(text, rf"(?is)(?<!\w){re.escape(heading)}\s+(.*?)(?=(?:\s\d{{1,2}}\.\s+|\n\s*)(?:{stop})|$)", 1)
    return F.nullif(F.trim(F.regexp_replace(found, r"\s+", " ")), F.lit(""))


def call_off(text: Column, heading: str, others: tuple[str, ...], least_words: int = 6) -> Column:
    """The clause by which a call-off's own summary commissions software; boilerplate elsewhere in the text does not count."""
    body = section(text, heading, others)
    said = F.filter(F.regexp_extract_all(body, F.lit(r"([\p{L}]{2,})"), F.lit(1)), lambda w: ~F.lower(w).isin("test", "testing", "this", "is", "the", "tbc", "tbd", "none"))
    return F.when(F.size(said) >= least_words, delivers(body))


#: Words by which a quoted clause speaks of what there is already, or of what may come.
EXISTING, UNCERTAIN = ("existing", "current", "currently", "incumbent", "legacy", "in place"), ("may", "might", "could", "potentially", "consider", "explore", "if required")


def quote_context(quote: Column) -> Column:
    """delivery, existing_system, uncertain or mention: what a quote of evidence says about its subject."""
    low = F.lower(quote)
    return (
        F.when(low.rlike(words(UNCERTAIN)), "uncertain").when(delivers(quote).isNotNull(), "delivery").when(low.rlike(words(EXISTING)), "existing_system").otherwise("mention")
    )


def compacted(evidence: Column, most: int = 2) -> Column:
    """Evidence for a ranking: distinct (capability, points, phrase), the strongest `most` of each capability, without quotes."""
    slim = F.array_distinct(F.transform(evidence, lambda e: F.struct(e["points"].alias("points"), e["capability"].alias("capability"), e["phrase"].alias("phrase"))))
    ranked = F.sort_array(slim, asc=False)
    return F.filter(ranked, lambda e, i: F.size(F.filter(F.slice(ranked, F.lit(1), i), lambda x: x["capability"] == e["capability"])) < most)


def signature(*settings: object) -> str:
    """A name for a rule set, by its content, that results are stored under: equal rules, equal name."""
    import hashlib

    return hashlib.sha256(repr(settings).encode()).hexdigest()[:16]


def reusable(results: Column, made_with: Column, current: str, compatible: tuple[str, ...] = ()) -> Column:
    """Stored results if the rules that made them are the current ones or known to give the same, else null."""
    return F.when(made_with.isin(current, *compatible), results)
