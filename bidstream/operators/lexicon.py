"""Many phrases at once: one automaton over folded text, and rules over the places where it finds phrases.

The phrases of a vocabulary, whatever their number and language, go into one Aho-Corasick automaton. A task builds it once
and reads each text once; what comes out is a list of places, with the clause and the word where each begins. Guards (what
else stands in the clause, what negates it) are expressions over that short list and name roles, not phrases, so a
plan's size does not depend on the vocabulary's.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from bidstream.operators.classify import SCORES
from bidstream.operators.scope import CLAUSE

#: Roles that guard others: what negates before and after, and what undoes such a negation ("not only").
BEFORE, AFTER, STILL = "negated before", "negated after", "not negated"
#: How many words may lie between a negation and what it negates.
REACH_BEFORE, REACH_AFTER = 4, 3

PLACE = "struct<clause:int,word:int,words:int,role:string,name:string,phrase:string,negated:boolean,inner:boolean>"
_FIELDS = [("clause", pa.int32()), ("word", pa.int32()), ("words", pa.int32()), ("role", pa.string()), ("name", pa.string()), ("phrase", pa.string()), ("negated", pa.bool_()), ("inner", pa.bool_())]
_CLAUSES = pa.list_(pa.list_(pa.struct(_FIELDS)))
_PROOFS = pa.list_(pa.struct([("name", pa.string()), ("strength", pa.string()), ("phrase", pa.string()), ("clause", pa.int32())]))


class _Folds(dict):
    """Each character without marks, case folded, and what is no word character as a space; worked out when first met."""

    def __missing__(self, code: int) -> str:
        folded = "".join(c for c in unicodedata.normalize("NFKD", chr(code)).casefold() if not unicodedata.combining(c))
        self[code] = re.sub(r"\W", " ", folded)
        return self[code]


_FOLDS = _Folds()


def folded_words(text: str) -> str:
    """Words as fold_for_index() has them, with a space before and after each."""
    return " " + " ".join(text.translate(_FOLDS).split()) + " "


@dataclass(frozen=True, order=True)
class Phrase:
    """A phrase, what it is in a rule (its role) and what it stands for (its name, such as a capability or a family)."""

    text: str
    role: str
    name: str = ""


class Lexicon:
    """Phrases of a vocabulary. One that folds to nothing is left out; one may have several roles and names."""

    def __init__(self, phrases: Iterable[Phrase]):
        self.entries: dict[str, list[tuple[str, str]]] = {}
        for p in sorted(set(phrases)):
            key = folded_words(p.text)
            if key.strip():
                self.entries.setdefault(key, []).append((p.role, p.name))

    @property
    def signature(self) -> str:
        """A name for the vocabulary, by its content."""
        return hashlib.sha256(repr(sorted(self.entries.items())).encode()).hexdigest()[:16]

    def automaton(self):
        import ahocorasick

        out = ahocorasick.Automaton()
        for key, uses in self.entries.items():
            out.add_word(key, (key, key.count(" ") - 1, uses))
        out.make_automaton()
        return out


def _marked(found: list[dict]) -> list[dict]:
    """A clause's places in order, with negated (by a negation near them) and inner (in a longer place of the same role and name).

    Each place is looked at a few times, whatever else the clause has.
    """
    found = sorted(found, key=lambda x: (x["word"], -x["words"], x["role"], x["name"]))
    still, first, last = -1, set(), set()  # how far what undoes a negation reaches, words at which negated places begin, and end
    for h in found:
        if h["role"] == STILL:
            still = max(still, h["word"] + h["words"])
        h["still"] = still
    # one that begins at the same word may come after a negation in this order
    begun = {h["word"]: h["still"] for h in found}
    for h in found:
        if h["role"] in (BEFORE, AFTER) and begun[h["word"]] < h["word"] + h["words"]:
            if h["role"] == BEFORE:
                first.update(range(h["word"] + h["words"], h["word"] + h["words"] + REACH_BEFORE + 1))
            else:
                last.update(range(h["word"] - REACH_AFTER, h["word"] + 1))
    reached: dict[tuple, int] = {}
    for h in found:
        del h["still"]
        end, alike = h["word"] + h["words"], (h["role"], h["name"])
        h["negated"], h["inner"] = h["word"] in first or end in last, reached.get(alike, -1) >= end
        reached[alike] = max(reached.get(alike, -1), end)
    return found


def _read(text: str, automaton) -> list[list[dict]]:
    out = []
    for number, clause in enumerate(re.split(CLAUSE, text)):
        folded = folded_words(clause)
        if len(folded) < 3:
            continue
        found, spaces, at = [], 0, 0
        for end, (key, words, uses) in automaton.iter(folded):
            spaces, at = spaces + folded.count(" ", at, end), end
            found += [{"clause": number, "word": spaces - words, "words": words, "role": role, "name": name, "phrase": key[1:-1]} for role, name in uses]
        if found:
            out.append(_marked(found))
    return out


#: Characters of texts whose places a task holds at once, but for a text that is longer by itself; a text may have a place for each of its words.
AT_ONCE = 1 << 18


def _read_batches(batches: Iterable[pa.Array], lexicon: Lexicon, made: Callable = lambda clauses: clauses, kind: pa.DataType = _CLAUSES) -> Iterator[pa.Array]:
    """What is `made` of the places of each text, in arrays of few texts, whatever a batch holds."""
    automaton = lexicon.automaton()
    for texts in batches:
        held, size = [], 0
        for t in texts:
            text = t.as_py() if lexicon.entries else None
            if held and size + len(text or "") > AT_ONCE:
                yield pa.array(held, type=kind)
                held, size = [], 0
            held.append(made(_read(text, automaton) if text else []))
            size += len(text or "")
        yield pa.array(held, type=kind)


def places(text: Column, lexicon: Lexicon) -> Column:
    """Where the lexicon's phrases stand in a text, whole words only: an array for each clause that has any, of
    (clause, word, words, role, name, phrase, negated, inner) in order of place.

    negated: a negation stands close before or after it; inner: it lies within a longer place of its role and name.

    Clauses and the words in them count from 0. Phrases that overlap are all found; none reaches across clauses. A null or empty text
    has none. Give the column a name before rules read it: Spark takes no Python function into a rule's lambda.
    """

    @F.arrow_udf(f"array<array<{PLACE}>>")
    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return _read_batches(batches, lexicon)

    return read(text)


def _proofs(clauses: list[list[dict]]) -> list[dict]:
    """evidence() of a text's places."""
    out = []
    for clause in clauses:
        contexts, bars = ({c["name"] for c in clause if c["role"] == role} for role in ("context", "bar"))
        for h in clause:
            if h["role"] not in ("explicit", "needs", "contextual") or h["negated"] or h["inner"] or h["name"] in bars or "" in bars:
                continue
            hint = h["role"] == "contextual" and h["name"] not in contexts and "" not in contexts
            out.append({"name": h["name"], "strength": "hint" if hint else h["role"], "phrase": h["phrase"], "clause": h["clause"]})
    return out


def evidence_of(text: Column, lexicon: Lexicon) -> Column:
    """evidence() of the places in a text, worked out where they are found, so that what counts for nothing does not leave Python."""

    @F.arrow_udf("array<struct<name:string,strength:string,phrase:string,clause:int>>")
    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return _read_batches(batches, lexicon, _proofs, _PROOFS)

    return read.asNondeterministic()(text)  # or else Spark reads the texts again for each filter on what is found


def by_clause(found: Column, rule: Callable[[Column], Column]) -> Column:
    """What a rule over one clause's places gives, of all clauses in order."""
    return F.flatten(F.transform(found, rule))


def _end(h: Column) -> Column:
    return h["word"] + h["words"]


def standing(clause: Column, *roles: str) -> Column:
    """A clause's places with one of the roles that nothing in it negates, in order."""
    return F.filter(clause, lambda h: h["role"].isin(*roles) & ~h["negated"])


def evidence(found: Column) -> Column:
    """(name, strength, phrase, clause) of the places that speak for a capability, in order of place.

    explicit and needs phrases count where they stand, the longest of those that overlap, and are not negated; contextual ones only in a clause
    with a place of the role context and the same name or none, and otherwise as a hint. A clause that bars a name (role bar) has none of it.
    """

    def proofs(clause: Column) -> Column:
        beside = lambda role, h: F.exists(clause, lambda c: (c["role"] == role) & c["name"].isin(h["name"], ""))
        strength = lambda h: F.when((h["role"] == "contextual") & ~beside("context", h), "hint").otherwise(h["role"])
        kept = F.filter(clause, lambda h: h["role"].isin("explicit", "needs", "contextual") & ~h["negated"] & ~h["inner"] & ~beside("bar", h))
        return F.transform(kept, lambda h: F.struct(h["name"].alias("name"), strength(h).alias("strength"), h["phrase"].alias("phrase"), h["clause"].alias("clause")))

    return by_clause(found, proofs)


def points(proof: Column, title: bool = False, in_title: int = 12) -> Column:
    """The most points that any evidence gives; a phrase in the title has more, but for a contextual one; hints give none."""
    worth = lambda e: reduce(lambda rest, s: F.when(e["strength"] == s, SCORES[s] + (in_title if title and s != "contextual" else 0)).otherwise(rest), SCORES, F.lit(0))
    return F.coalesce(F.array_max(F.transform(proof, worth)), F.lit(0))


@dataclass(frozen=True)
class ClauseRule:
    """Holds in a clause with a place of `subject`, not negated, and one of each of `near`, and none of `bars`.

    reach: how many words may lie between the subject and what is near; any, if None. order: what is near stands "before" or "after" the subject.
    """

    label: str
    subject: str
    near: tuple[str, ...] = ()
    bars: tuple[str, ...] = ()
    reach: int | None = None
    order: str | None = None

    def where(self, clause: Column) -> Column:
        """A clause's places of the subject at which the rule holds."""

        def close(n: Column, h: Column) -> Column:
            out = F.lit(True) if self.reach is None else F.greatest(h["word"] - _end(n), n["word"] - _end(h)) <= self.reach
            if self.order == "before":
                out = out & (_end(n) <= h["word"])
            elif self.order == "after":
                out = out & (_end(h) <= n["word"])
            return out

        def near(role: str, h: Column) -> Callable[[Column], Column]:
            return lambda n: (n["role"] == role) & close(n, h)

        def holds(h: Column) -> Column:
            out = F.lit(True)
            for role in self.near:
                out = out & F.exists(clause, near(role, h))
            return out & ~F.exists(clause, lambda b: b["role"].isin(*self.bars)) if self.bars else out

        return F.filter(standing(clause, self.subject), holds)

    def holds(self, found: Column) -> Column:
        return F.exists(found, lambda clause: F.size(self.where(clause)) > 0)


def first_holding(found: Column, rules: Iterable[ClauseRule]) -> Column:
    """The label of the first rule that holds in some clause, or null."""
    out = F.when(F.lit(False), F.lit(""))
    for r in rules:
        out = out.when(r.holds(found), F.lit(r.label))
    return out
