"""Precedence merges of facts from several sources, with the source of each."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from bidlens.functions.numbers import to_calendar

#: The ranges in which a fact that is already there stays.
KEPT_RANGES = {"nmck": (1e3, 1e11), "payment_terms_days": (1, 3650), "execution_days": (1, 5000), "penalty_percent_per_day": (0, 10), "fine_percent": (0, 100)}
_WHOLE = ("payment_terms_days", "execution_days")
Facts = Mapping[str, Column]


def _rounded(field: str, value: Column) -> Column:
    return F.bround(value.cast("double"), 0) if field in _WHOLE else value.cast("double")


def fill_missing(current: Facts, mined: Facts) -> dict[str, Column]:
    """A mined value takes the place of one that is missing or out of range; without a mined one even that stays."""
    out = {}
    for field, value in current.items():
        value, found = value.cast("double"), _rounded(field, mined[field])
        kept = F.coalesce(value.between(*KEPT_RANGES[field]), F.lit(False))
        out[field] = F.when(kept | found.isNull(), value).otherwise(found)
    return out


def fill_empty(current: Facts, picked: Facts) -> dict[str, Column]:
    """A picked value takes the place of a missing one only, whatever the range."""
    return {field: F.coalesce(value.cast("double"), _rounded(field, picked[field])) for field, value in current.items()}


def consolidate(current: Facts, detail: Facts, evidence: Facts) -> tuple[dict[str, Column], dict[str, Column]]:
    """Facts and their sources after what the clauses say in detail has taken precedence.

    `detail` has final_calendar, final_working, advance_days, penalty_percent_per_day and fine_percent; the
    first term of payment given there wins, working days as calendar days. The source is then meta; of
    a value that was there already it is that of its evidence, legacy without one or without a value.
    """
    terms = [F.bround(detail["final_calendar"].cast("double"), 0), to_calendar(detail["final_working"]).cast("double"), F.bround(detail["advance_days"].cast("double"), 0)]
    over = {"payment_terms_days": F.coalesce(*terms), "penalty_percent_per_day": detail["penalty_percent_per_day"].cast("double"), "fine_percent": detail["fine_percent"].cast("double")}
    values, sources = {}, {}
    for field, value in current.items():
        value, first = value.cast("double"), over.get(field, F.lit(None).cast("double"))
        values[field] = F.coalesce(first, value)
        named = F.when(value.isNotNull() & (F.coalesce(evidence[field], F.lit("")) != ""), evidence[field]).otherwise("legacy")
        sources[field] = F.when(first.isNotNull(), "meta").otherwise(named)
    return values, sources


def with_sources(values: Facts, sources: Facts) -> Column:
    """Array of (field, value, source), one for each field."""
    return F.array(*[F.struct(F.lit(field).alias("field"), values[field].alias("value"), sources[field].alias("source")) for field in values])
