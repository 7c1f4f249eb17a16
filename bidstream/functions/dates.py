"""Dates and deadlines: what was published stays as it is; instants for comparison are derived beside it."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache
from zoneinfo import available_timezones

from pyspark.sql import Column
from pyspark.sql import functions as F

_FORMATS = ("dd/MM/yyyy", "d MMMM yyyy", "d MMM yyyy", "yyyyMMdd")
#: The last zone in which a day ends.
LAST_ZONE = "-12:00"


def micros(instant: Column) -> Column:
    """Microseconds since 1970 of a time with or without a zone; without one, as if in UTC."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), instant.cast("timestamp_ntz"))


def parse_date(value: Column) -> Column:
    """An instant of ISO text or of one of four other forms; text without a zone is in UTC, other text is null."""
    text = F.trim(value)
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}[+-]\d{2}:\d{2}$"), F.concat(F.substring(text, 1, 10), F.lit("T00:00:00"), F.substring(text, 11, 6))).otherwise(text)
    zoned = F.when(iso.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"), iso)
    with_zone = F.when(zoned.rlike(r"(Z|[+-]\d{2}:?\d{2})$") & zoned.contains(":"), zoned).otherwise(F.concat(zoned, F.when(F.length(zoned) > 10, F.lit("Z")).otherwise(F.lit("T00:00:00Z"))))
    shapes = (r"^\d{1,2}/\d{1,2}/\d{4}$", r"^\d{1,2} \p{L}{4,} \d{4}$", r"^\d{1,2} \p{L}{3} \d{4}$", r"^\d{8}$")
    others = [F.when(text.rlike(s), F.try_to_timestamp(F.concat(text, F.lit(" +0000")), F.lit(f + " xx"))) for s, f in zip(shapes, _FORMATS, strict=True)]
    return F.coalesce(with_zone.try_cast("timestamp"), *others)


@lru_cache
def known_zones() -> tuple[str, ...]:
    return tuple(sorted(available_timezones()))


def zoned_instant(local: Column, zone: Column) -> Column:
    """The one instant at which a wall clock in `zone` shows `local` (a time without a zone), null in a gap or a fold.

    Spark resolves both silently; so instants around its answer are tried, and must show `local` and be alone in it.
    `zone` has to be known: an unknown name is an error in Spark.
    """
    # answers near Spark's own, in steps of half an hour
    guess = F.convert_timezone(zone, F.lit("UTC"), local)
    steps = F.array(*[F.lit(m) for m in (-120, -60, -30, 0, 30, 60, 120)])
    tried = F.transform(steps, lambda m: F.timestamp_add("MINUTE", m, guess))
    real = F.array_distinct(F.filter(tried, lambda t: F.convert_timezone(F.lit("UTC"), zone, t) == local))
    return F.when(F.size(real) == 1, _as_utc(F.get(real, 0)))


def _as_utc(local: Column) -> Column:
    """The instant of a time without a zone that is in UTC, whatever the session's zone is."""
    return F.timestamp_micros(micros(local))


def end_of_day(date: Column, zone: Column) -> Column:
    """The last microsecond of a day in a known zone; in the last zone of all where there is none, or none such."""
    last = F.concat(date, F.lit(" 23:59:59")).try_cast("timestamp_ntz")
    known = zone.isin(*known_zones())
    there = F.when(known, zoned_instant(last, F.when(known, zone).otherwise(F.lit("UTC"))))
    anywhere = _as_utc(F.timestamp_add("HOUR", F.lit(12), last))
    return F.coalesce(there, anywhere) + F.expr("INTERVAL 0.999999 SECOND")


def deadline_instant(d: Column) -> Column:
    """When a deadline (date, time, timezone, precision, instant) is over, for comparison only."""
    stated = F.when((d["precision"] == "instant") & d["instant"].rlike(r"(Z|[+-]\d{2}:?\d{2})$"), parse_date(d["instant"]))
    known = d["timezone"].isin(*known_zones())
    local = F.concat_ws(" ", d["date"], d["time"]).try_cast("timestamp_ntz")
    timed = F.when((d["precision"] == "local_time") & d["time"].isNotNull() & known, zoned_instant(local, F.when(known, d["timezone"]).otherwise(F.lit("UTC"))))
    return F.coalesce(stated, timed, end_of_day(d["date"], d["timezone"]))


def response_deadline(deadlines: Column) -> Column:
    """Of current deadlines but for questions and invited submissions: the latest first-stage one, or else the latest."""
    current = F.filter(deadlines, lambda d: (d["status"] == "current") & ~d["kind"].isin("questions", "invited_submission"))
    initial = F.filter(current, lambda d: d["kind"].isin("application", "expression_of_interest"))
    return F.array_max(F.transform(F.when(F.size(initial) > 0, initial).otherwise(current), deadline_instant))


def shown_deadline(instants: Column, now: Column) -> Column:
    """The earliest that is still open, else the latest that has passed."""
    return F.coalesce(F.array_min(F.filter(instants, lambda t: t > now)), F.array_max(instants))


#: A day with or without an offset, then a clock with or without one, or nothing.
_WALL = r"^(\d{4}-\d{2}-\d{2})(Z|[+-]\d{2}:\d{2})?\|(?:(\d{2}:\d{2}:\d{2}(?:\.\d+)?)(Z|[+-]\d{2}:\d{2})?)?$"


def xml_deadline(day: Column, clock: Column) -> Column:
    """ISO text of a day and a clock that may each carry an offset; the clock's counts. A clock without any offset is left out.

    Null for a day that is none, and for a clock that is none.
    """
    both = F.concat_ws("|", day, F.coalesce(clock, F.lit("")))
    date, day_zone, time, clock_zone = (F.nullif(F.regexp_extract(both, _WALL, i), F.lit("")) for i in range(1, 5))
    # null in any part leaves the day alone
    return F.coalesce(F.concat(date, F.lit("T"), time, F.coalesce(clock_zone, day_zone)), date)


MONTHS = "january february march april may june july august september october november december".split()
_DAY = r"(?:(?:mon|tues|wednes|thurs|fri|satur|sun)day,?\s+)?(\d{1,2})(?:st|nd|rd|th)?\s+(?:of\s+)?(" + "|".join(f"{m}|{m[:3]}" for m in MONTHS) + r")\.?,?\s+(\d{4})"
_CLOCK = r"(\d{1,2})(?:[:.](\d{2}))?\s*(am|pm|noon|hrs|hours)?"


def prose_deadlines(text: Column, labels: tuple[str, ...], stops: tuple[str, ...] = (), reach: int = 120) -> Column:
    """Days (yyyy-MM-dd, with T and the time if one is given) that stand after a label, no more than `reach` characters on.

    labels: words that name the response deadline; stops: words at which a label's reach ends, such as the next row of a timeline. A
    sentence's end is one too. Of entries for one day the timed one counts; days come in order.
    """
    low = F.lower(text)
    named = "|".join(re.escape(x.lower()) for x in sorted(labels, key=len, reverse=True))
    tails = F.regexp_extract_all(low, F.lit(rf"(?:{named})((?:(?!{named}).){{0,{reach}}})"), F.lit(1))
    ended = F.transform(tails, lambda t: F.get(F.split(t, "[!?]" + "".join(rf"|(?<!\w){re.escape(x.lower())}(?!\w)" for x in stops), 2), 0))
    after = lambda t: F.regexp_extract(t, _DAY + r"(?:\s*(?:,|at|by|-|–)?\s*(?:at\s+|by\s+)?" + _CLOCK + r")?", 0)
    before = lambda t: F.regexp_extract(t, _CLOCK + r"\s*(?:on|,)\s+(?:the\s+)?" + _DAY, 0)

    def one(said: Column, t: Column) -> Column:
        """Of a day with what may follow it, and of the text that it stands in."""
        part = lambda i: F.regexp_extract(said, _DAY, i)
        day = F.concat_ws("-", part(3), F.lpad(_month(part(2)).cast("string"), 2, "0"), F.lpad(part(1), 2, "0"))
        clock = _once(before(t), lambda b: F.when(b != "", F.regexp_extract(b, "^" + _CLOCK, 0)).otherwise(
            F.regexp_extract(said, _DAY + r"\s*(?:,|at|by|-|–)?\s*(?:at\s+|by\s+)?(" + _CLOCK + ")$", 4)
        ))
        return _once(day, lambda d: F.when(d.try_cast("date").isNotNull(), F.concat(d, F.coalesce(F.concat(F.lit("T"), _once(clock, _clock)), F.lit("")))))

    found = F.array_sort(F.array_compact(F.transform(ended, lambda t: _once(after(t), lambda said: F.when(said != "", one(said, t))))))
    return timed_first(found)


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f names it; in a lambda Spark would work it out each time."""
    return F.get(F.transform(F.array(value), f), 0)


def _month(name: Column) -> Column:
    return F.array_position(F.array(*[F.lit(m[:3]) for m in MONTHS]), F.substring(name, 1, 3)).cast("int")


def _clock(text: Column) -> Column:
    """HH:mm of a clock such as 5pm, 17:00 or 12 noon; null for a bare number without minutes or half of the day."""
    pick = lambda i: F.regexp_extract(text, "^" + _CLOCK + "$", i)

    def told(c: Column) -> Column:
        half, minute, hour = c["half"], F.when(c["minute"] != "", c["minute"]).otherwise("00"), c["hour"].try_cast("int")
        shifted = F.when(half == "pm", hour % 12 + 12).when(half == "am", hour % 12).when(half == "noon", F.lit(12)).otherwise(hour)
        good = (shifted < 24) & (minute.try_cast("int") < 60) & ((half != "") | (c["minute"] != ""))
        return F.when(good, F.concat(F.lpad(shifted.cast("string"), 2, "0"), F.lit(":"), minute))

    return F.when(text != "", _once(F.struct(pick(1).alias("hour"), pick(2).alias("minute"), pick(3).alias("half")), told))


def timed_first(values: Column) -> Column:
    """Of ISO texts of one day the longest, so a time is not lost to a bare date; days in order."""
    def of_days(values: Column) -> Column:
        days = F.array_distinct(F.transform(values, lambda v: F.substring(v, 1, 10)))
        longest = lambda d: F.array_max(F.transform(F.filter(values, lambda v: v.startswith(d)), lambda v: F.struct(F.length(v).alias("n"), v.alias("v"))))["v"]
        return F.array_sort(F.transform(days, longest))

    return _once(values, of_days)


def engagement_deadline(text: Column, labels: tuple[str, ...] = ("responses by", "respond by", "register interest by", "expressions of interest by", "closing date")) -> Column:
    """The first day by which a notice of early engagement asks for answers in its prose; null if it names none."""
    return F.get(prose_deadlines(text, labels, ("contract start", "award")), 0)
