"""The state of a notice, weighed from what each of its fields says.

Each field is looked up in a table of its own and gives at most one statement: a precedence, a state and a reason. The statement
of lowest precedence decides. Publishers' own wordings are configuration; the tables below are the defaults.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Says:
    """A statement about a state; `order` is its precedence, the least first."""

    order: int
    state: str
    reason: str

    def when(self, holds: Column) -> Column:
        return F.when(holds, F.struct(F.lit(self.order).alias("order"), F.lit(self.state).alias("state"), F.lit(self.reason).alias("reason")))


_OVER, _ENDED = "the source ends the procedure", "the source reports a closed procedure"

# The names that publishers use, and which of them overrules which.
#: Words that a title starts with, in the spelling of the publishers.
HEADINGS = {
    r"(?:CANCELLED|CANCELED|AVLYST|KESKEYTETTY|PERUTTU)\b": Says(10, "CLOSED", "the title marks the procedure as called off"),
    r"(?i:bekanntmachung\s+vergebener\s+auftrag\b)": Says(11, "AWARDED", "the title announces an award"),
    r"(?i:transparenzbekanntmachung\b(?=.*135.*abs(?:\.?|atz)\s*3))": Says(12, "CLOSED", "a direct award is announced ahead, with no competition"),
}
#: Notice types, in lower case.
NOTICE_TYPES = {t: Says(13, "CLOSED", "a direct award is announced ahead, with no competition") for t in ("veat", "dir-awa-pre")}
#: Status names, in lower case with low lines.
STATUSES = {
    **{s: Says(20, "CANCELLED", "the source reports a cancellation") for s in ("cancelled", "canceled", "unsuccessful")},
    "withdrawn": Says(21, "WITHDRAWN", "the source reports a withdrawal"),
    "not_listed": Says(22, "CLOSED", "complete listings have left it out twice"),
    "restricted": Says(22, "CLOSED", "only holders of an earlier contract may take part"),
    "awarded": Says(23, "AWARDED", "the source reports an award"),
    **{s: Says(24, "CLOSED", _ENDED) for s in ("closed", "complete", "completed", "terminated")},
    "postponed": Says(25, "UNKNOWN", "bids are put off and no new date is known"),
    "expired": Says(30, "EXPIRED", "the response window is over"),
    **{s: Says(60, "OPEN", "the source reports an active procedure") for s in ("active", "open")},
}
#: Types of notices.
KINDS = {
    "AWARD": Says(23, "AWARDED", "an award notice, not a competition"),
    "RENEWAL_SIGNAL": Says(40, "FUTURE", "a contract's end suggests a new competition; nothing confirms it"),
    **{k: Says(50, "FUTURE", "an intention is published, and no competition yet") for k in ("PIPELINE", "FUTURE_OPPORTUNITY", "STRATEGIC_INTENT")},
}
TALKS, TALKS_DAYS = ("EARLY_MARKET_ENGAGEMENT", "RFI"), 90
PASSED = Says(30, "EXPIRED", "the response window is over")
TALKING = Says(45, "EARLY_ENGAGEMENT", "the buyer asks the market before a competition")
SILENT = Says(46, "UNKNOWN", "an older question to the market, with no window to answer in")
PLANNED = Says(51, "FUTURE", "the procedure is at its planning stage")
DUE = Says(61, "OPEN", "a response deadline is ahead")
NOTHING = Says(99, "UNKNOWN", "the notice gives no response window")


@dataclass(frozen=True)
class StateTables:
    """What titles, notice types, status names and kinds say; a publisher may have tables of its own."""

    headings: dict[str, Says] = field(default_factory=lambda: dict(HEADINGS))
    notice_types: dict[str, Says] = field(default_factory=lambda: dict(NOTICE_TYPES))
    statuses: dict[str, Says] = field(default_factory=lambda: dict(STATUSES))
    kinds: dict[str, Says] = field(default_factory=lambda: dict(KINDS))


def _looked_up(value: Column, table: dict[str, Says]) -> Column:
    """The statement that a value has in a table; one literal map, whatever its size."""
    rows = F.create_map(*[x for name, says in table.items() for x in (F.lit(name), says.when(F.lit(True)))])
    return F.try_element_at(rows, F.coalesce(value, F.lit("")))


def state_of(
    status: Column, kind: Column, title: Column, notice_type: Column, deadline: Column, published: Column, now: Column,
    stage: Column | None = None, uncertain: Column | None = None, tables: StateTables | None = None,
) -> Column:
    """(state, reason) of a notice at `now`. deadline: the response deadline, an instant; uncertain: whether its window is in doubt.

    A field that is null says nothing. A deadline that has passed outweighs all but what ended the procedure.
    """
    tables = tables or StateTables()
    name = F.replace(F.lower(status), F.lit("-"), F.lit("_"))
    ahead, active = deadline.isNotNull(), F.coalesce(name, F.lit("")) == "active"
    recent = F.coalesce(F.timestamp_diff("DAY", published, now) <= TALKS_DAYS, F.lit(False))
    talks = kind.isin(*TALKS)
    said = [says.when(F.trim(title).rlike("^" + words)) for words, says in tables.headings.items()]
    said += [_looked_up(F.lower(notice_type), tables.notice_types), _looked_up(name, tables.statuses), _looked_up(kind, tables.kinds)]
    said += [PASSED.when(deadline <= now), TALKING.when(talks & (ahead | active | recent)), SILENT.when(talks), DUE.when(ahead)]
    said += [PLANNED.when(stage == "planning")] if stage is not None else []
    said += [Says(31, "UNKNOWN", "nothing confirms that the window is the current one").when(uncertain)] if uncertain is not None else []
    first = F.array_min(F.array_compact(F.array(*said, NOTHING.when(F.lit(True)))))
    return F.struct(first["state"].alias("state"), first["reason"].alias("reason"))


#: States of no opportunity any more.
TERMINAL = ("AWARDED", "CANCELLED", "CLOSED", "EXPIRED", "WITHDRAWN")


def audiences(state: Column, kind: Column, status: Column, excluded: Column, award_statuses: Column, notice_type: Column, related_id: Column) -> Column:
    """(opportunity, award): whether a notice is shown as an opportunity, and as a confirmed award."""
    low = F.lower(F.coalesce(status, F.lit("")))
    award_kind = F.coalesce(kind == "AWARD", F.lit(False)) | (low == "awarded")
    open_to = ~low.isin("postponed", "unverified") & ~award_kind & ~state.isin(*TERMINAL) & ~excluded
    confirmed = F.coalesce(F.size(award_statuses) == 0, F.lit(True)) | F.array_contains(award_statuses, "active")
    award = (
        (state == "AWARDED") & confirmed & ~excluded & related_id.isNull() & (F.upper(F.coalesce(notice_type, F.lit(""))) != "UK5")
        & (F.coalesce(kind, F.lit("")) != "RENEWAL_SIGNAL")
    )
    return F.struct(open_to.alias("opportunity"), award.alias("award"))
