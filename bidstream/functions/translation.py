"""Checks and helpers of translations; the translating itself is no part of this engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"\d+(?:[.,]\d+)*"
URL = r"https?://[^\s<>\"')\]]+"
MAILBOX = r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+"
#: What a translation must carry over unchanged.
LITERALS = f"{URL}|{MAILBOX}|{NUMBER}"
#: What a match holds at least: texts without it are not searched, which for mailboxes takes the square of a word's length.
SIGNS = {URL: "://", MAILBOX: "@"}


def multiset(text: Column, pattern: str) -> Column:
    """A pattern's matches, sorted: equal for texts that hold the same ones as often, in any order."""
    found = F.array_sort(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)))
    sign = SIGNS.get(pattern)
    return found if sign is None else F.when(text.contains(sign), found).when(text.isNotNull(), F.array().cast("array<string>"))


def faults(source: Column, translated: Column, least: float = 0.3, most: float = 3.5) -> Column:
    """Why a translation cannot stand: empty, unlike length, changed numbers, links or mailboxes."""
    ratio = F.length(translated) / F.greatest(F.lit(1), F.length(source))
    bare = lambda t: F.when(t.contains("@"), F.regexp_replace(t, f"{URL}|{MAILBOX}", " ")).when(t.contains("://"), F.regexp_replace(t, URL, " ")).otherwise(t)
    checks = {
        "empty": (F.trim(source) != "") & (F.trim(translated) == ""), "length": (F.length(source) >= 40) & ~ratio.between(least, most),
        "numbers": multiset(bare(source), NUMBER) != multiset(bare(translated), NUMBER), "links": multiset(source, URL) != multiset(translated, URL),
        "mailboxes": multiset(source, MAILBOX) != multiset(translated, MAILBOX),
    }
    return F.array_compact(F.array(*[F.when(p, label) for label, p in checks.items()]))


def masked(text: Column) -> tuple[Column, Column]:
    """The text with its literals replaced by marks, and the literals in order."""
    parts = lambda pattern: (F.regexp_replace(text, pattern, "⟦⟧"), F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)))
    (mark, listed), (mark_, listed_) = parts(LITERALS), parts(f"{URL}|{NUMBER}")
    return F.when(text.contains("@"), mark).otherwise(mark_), F.when(text.contains("@"), listed).otherwise(listed_)


def restored(text: Column, literals: Column) -> Column:
    """The text with its marks replaced by the literals; null if there are not as many."""
    parts = F.split(text, "⟦⟧", -1)
    whole = F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.coalesce(F.get(literals, i), F.lit("")))), "")
    return F.when(F.size(parts) == F.size(literals) + 1, whole)


def pieces(text: Column, most: int) -> Column:
    """The text cut after sentences or spaces into pieces of at most `most` characters; joined, they are the text."""
    return F.regexp_extract_all(text, F.lit(rf"(?s)(.{{1,{most}}}\z|.{{1,{most}}}(?<=[.!?]\s)|.{{1,{most}}}(?<=\s)|.{{1,{most}}})"), F.lit(1))


#: Frequent words by language; fixed.
FREQUENT = {
    "en": "the and of to for is that with by on be this from are was", "de": "der die das und von zu mit den ist im für auf des dem nicht",
    "fr": "le la les de des et du en un une que pour dans est par", "es": "el la los las de que y en un una por con para del es",
}


def language(text: Column) -> Column:
    """The language with most frequent words in a text, null if there are none: a rule of thumb for prose."""
    words = F.split(F.lower(text), r"[^\p{L}]+")
    counts = F.array(*[F.struct(F.size(_among(words, listed.split())).alias("n"), F.lit(code).alias("code")) for code, listed in FREQUENT.items()])
    best = F.array_max(counts)
    return F.when(best["n"] > 0, best["code"])


def _among(words: Column, listed: list[str]) -> Column:
    return F.filter(words, lambda w: w.isin(*listed))
