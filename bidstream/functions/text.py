"""Text functions: folding, cleaning, phrases, compiled searches."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from functools import wraps
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Java's \w and \b are ASCII only unless asked.
_U = "(?U)"


class _Visible(HTMLParser):
    """Collects a page's visible text; scripts, styles and noscript are none."""

    HIDDEN = ("script", "style", "noscript")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in self.HIDDEN

    def handle_endtag(self, tag):
        self.hidden -= tag in self.HIDDEN and self.hidden > 0

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def clean_text(value: str | None, limit: int | None = None) -> str:
    """Visible text, NFKC, white space collapsed; whole, or cut at `limit` characters."""
    text = value or ""
    if "<" in text and ">" in text:
        parser = _Visible()
        parser.feed(text)
        parser.close()
        text = " ".join(parser.parts)
    return " ".join(unicodedata.normalize("NFKC", text).split())[:limit]


def fold_for_index(value: str | None) -> str:
    """NFKD, case folded, combining marks dropped, other than word characters to spaces, padded."""
    text = "".join(c for c in unicodedata.normalize("NFKD", value or "").casefold() if not unicodedata.combining(c))
    return " " + re.sub(r"\W+", " ", text).strip() + " "


def fold_for_query(value: str | None) -> str:
    """NFKD, marks dropped, lower case, all but letters and numbers to spaces; unlike the index, underscores too."""
    text = "".join(c for c in unicodedata.normalize("NFKD", value or "") if not unicodedata.category(c).startswith("M")).lower()
    return re.sub(r"[\W_]+", " ", text).strip()


#: So many texts at most are held as Python strings at once.
AT_ONCE = 256
#: Bytes of an Arrow batch of texts, however long they are; rows alone would let it grow with their length.
BATCH_BYTES = "4m"


def _vectorised(function):
    """A function of texts as one of columns: few texts at once, and of these equal ones once."""

    @F.arrow_udf(T.StringType())
    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for at in range(0, len(texts), AT_ONCE):
                some = texts.slice(at, AT_ONCE).dictionary_encode(null_encoding="encode")
                yield pa.array([function(v.as_py()) for v in some.dictionary], pa.string()).take(some.indices)

    @wraps(apply)
    def column(text: Column | str) -> Column:
        # the session reads this when a plan runs
        SparkSession.active().conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
        return apply(text)

    return column


clean = _vectorised(clean_text)
_fold_for_index, _fold_for_query = _vectorised(fold_for_index), _vectorised(fold_for_query)


def _plain(text: Column, lower: Column, other: Column) -> Column:
    """The quick form of ASCII text, which needs no Unicode rules; other text takes the long way."""
    return F.when(F.coalesce(text, F.lit("")).rlike(r"^[\x00-\x7f]*$"), lower).otherwise(other)


def search_text(text: Column) -> Column:
    """fold_for_index() of a column; ASCII text stays in the JVM."""
    t = F.coalesce(text, F.lit(""))
    return _plain(text, F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(t), r"\W+", " ")), F.lit(" ")), _fold_for_index(_unless_ascii(t)))


def folded(text: Column) -> Column:
    """fold_for_query() of a column; ASCII text stays in the JVM."""
    t = F.coalesce(text, F.lit(""))
    return _plain(text, F.trim(F.regexp_replace(F.lower(t), r"[\W_]+", " ")), _fold_for_query(_unless_ascii(t)))


def _unless_ascii(text: Column) -> Column:
    """Empty for ASCII text, so that little of it goes to Python."""
    return F.when(text.rlike(r"^[\x00-\x7f]*$"), F.lit("")).otherwise(text)


normal_text = _vectorised(lambda v: re.sub(r"[^\w]+", " ", clean_text(v).casefold()).strip())
unescaped = _vectorised(lambda v: html.unescape(v or ""))


def phrase_hits(text: Column, phrases: list[str]) -> Column:
    """Distinct phrases of the list in the text, in order of place; the longest wins where several begin."""
    listed = "|".join(re.escape(p) for p in sorted(phrases, key=lambda p: (-len(p), p)))
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"{_U}(?<!\w)({listed})(?!\w)"), F.lit(1)))


def tokens(text: Column, stop_words: list[str], shortest: int = 3, longest: int = 44) -> Column:
    """Words of letters and numbers in lower case, without stop words and words of odd length."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.filter(words, lambda w: F.length(w).between(shortest, longest) & ~w.isin(stop_words))


def compiled_search(text: Column, query: str, mode: str = "all") -> Column:
    """A predicate for a search over folded text: quoted phrases must stand whole; words by mode all, any or phrase.

    Words of three characters or fewer match whole words only, longer ones anywhere. An empty query matches all.
    """
    phrases = [fold_for_query(p) for p in re.findall(r'"([^"]+)"', query)]
    rest = fold_for_query(re.sub(r'"[^"]*"', " ", query))
    padded = F.concat(F.lit(" "), text, F.lit(" "))

    def word(w: str) -> Column:
        return padded.contains(f" {w} ") if len(w) <= 3 else padded.contains(w)

    words = [word(w) for w in rest.split()]
    found = F.lit(True)
    for p in phrases:
        found = found & padded.contains(f" {p} ")
    if mode == "phrase" and rest:
        return found & padded.contains(f" {rest} ")
    if mode == "any" and words:
        some = words[0]
        for w in words[1:]:
            some = some | w
        return found & some
    for w in words:
        found = found & w
    return found


def csv_cell(value: Column) -> Column:
    """A quoted cell; text that a spreadsheet would run as a formula gets an apostrophe first."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    guarded = F.when(text.rlike(r"^[\s]*[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)
    return F.concat(F.lit('"'), F.replace(guarded, F.lit('"'), F.lit('""')), F.lit('"'))


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, tracking parameters dropped, the query sorted, no trailing slash or fragment.

    Empty for other schemes, for a missing host and for URLs with credentials.
    """
    parts = lambda i: F.regexp_extract(url, r"^([A-Za-z]+)://([^/?#]*)([^?#]*)\??([^#]*)", i)
    kept = F.filter(F.split(parts(4), "&"), lambda p: (F.length(p) > 0) & p.contains("=") & ~p.rlike(r"^utm_|^(gclid|fbclid)=|=$"))
    query = F.array_join(F.array_sort(kept), "&")
    base = F.concat(F.lower(parts(1)), F.lit("://"), F.lower(parts(2)), F.regexp_replace(parts(3), "/+$", ""))
    good = F.lower(parts(1)).isin("http", "https") & (parts(2) != "") & ~parts(2).contains("@")
    return F.when(good, F.when(query != "", F.concat(base, F.lit("?"), query)).otherwise(base)).otherwise(F.lit(""))


def money(value: Column) -> Column:
    """A finite, non-negative number, or null."""
    number = value.try_cast("double")
    return F.when(F.isnan(number) | (number < 0) | (F.abs(number) == float("inf")), F.lit(None)).otherwise(number)


def digest(*columns: str) -> Column:
    """SHA-256 of the columns as JSON; this engine's own form, nulls included."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Lower and upper bound of a proportion."""
    p, n = hits / n, n.cast("double")
    centre, spread = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (centre - spread) / (1 + z * z / n), (centre + spread) / (1 + z * z / n)


def prefix(text: Column, most: int, mark: str = "…") -> Column:
    """At most `most` code points of a text; one that is cut ends at a word, where there is one, and with a mark."""
    cut = F.substring(text, 1, most - len(mark))
    at_word = F.when(cut.rlike(r"\s\S*\z"), F.regexp_replace(cut, r"\s+\S*\z", "")).otherwise(cut)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(at_word, F.lit(mark)))


def in_language(values: Column, preferred: tuple[str, ...] = ("en",)) -> Column:
    """Of a map from language to text the first preferred one that is not blank, else that of the least language code."""
    good = F.map_filter(values, lambda k, v: F.trim(F.coalesce(v, F.lit(""))) != "")
    first = F.get(F.array_sort(F.map_keys(good)), 0)
    return F.coalesce(*[F.try_element_at(good, F.lit(p)) for p in preferred], F.try_element_at(good, first))


def under_key(document: Column, key: str) -> Column:
    """Text values under a key anywhere in a JSON document, in document order; numbers and booleans as text.

    The document is read as a whole for its syntax; the values are found by their key's pattern, which stands at any depth.
    """
    ok = F.try_parse_json(document).isNotNull()
    pattern = rf'"{re.escape(key)}"\s*:\s*("(?:[^"\\]|\\.)*"|-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false)'
    raw = F.regexp_extract_all(document, F.lit(pattern), F.lit(1))
    text = F.transform(raw, lambda v: F.when(v.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), v, F.lit("}")), "$.v")).otherwise(v))
    return F.when(ok, text).otherwise(F.array().cast("array<string>"))


def joined(*columns: Column) -> Column:
    """What a search over a record reads: its texts and lists, one after the other, blanks left out."""
    return F.trim(F.regexp_replace(F.concat_ws(" ", *columns), r"\s+", " "))


def money_shown(low: Column, high: Column, currency: Column) -> Column:
    """An amount or a range with thousands, and its currency; empty without an amount."""
    n = lambda v: F.format_number(v, 0)
    span = F.when(low.isNotNull() & high.isNotNull() & (low != high), F.concat(n(low), F.lit(" to "), n(high))).otherwise(n(F.coalesce(high, low)))
    return F.when(F.coalesce(high, low).isNull(), F.lit("")).otherwise(F.concat_ws(" ", span, currency))


#: Labels that publishers put before a lot's own title.
LOT_LABEL = r"(?i)^\s*(?:lot|los|lote|lotto|parcela)\s*(?:n[o°.]*\s*)?[0-9]+[a-z]?\s*[:.\-–—)]*\s*"


def lot_title(title: Column, procedure: Column) -> Column:
    """A lot's title without its label, null if it says nothing that the procedure's title does not."""
    bare = F.nullif(F.trim(F.regexp_replace(title, LOT_LABEL, "")), F.lit(""))
    return F.when(~F.lower(bare).eqNullSafe(F.lower(F.trim(procedure))), bare)


def brief(title: Column, buyer: Column, deadline: Column, description: Column, most: int = 280) -> Column:
    """A notice in a few lines: what is not known is left out."""
    return F.concat_ws("\n", title, buyer, F.when(deadline.isNotNull(), F.concat(F.lit("Due "), deadline)), prefix(description, most))
