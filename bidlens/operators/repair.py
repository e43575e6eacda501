"""A second pass over the fields that the ranked variant failed to read, fed back into the row.

The gate says which fields failed though their section is there. For those alone the section's snippets
are read again, with plain parsers in the order of the text; then the gate judges the row anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidlens.functions.numbers import parse_days_ranked, parse_money_scaled, parse_percent
from bidlens.functions.text import let
from bidlens.plans.analyze import FACTS, SECTION_OF, gate_ranked


def _first(values: Column) -> Column:
    return F.try_element_at(F.filter(values, lambda v: v.isNotNull()), F.lit(1))


def _days(text: Column) -> Column:
    """Working days count 1.4 calendar days here too, but are cut off, not rounded up."""
    return let(parse_days_ranked(text), lambda p: F.when(p["type"] == "working", F.floor(p["days"] * F.lit(1.4)).cast("int")).otherwise(p["days"]))


def read_again(field: str, snippets: Column) -> Column:
    """What the plain parser of a field finds in its section's snippets, null if nothing.

    Amounts and execution terms of 0 don't count, a payment term of 0 does; the penalty is the first percentage
    of the first snippet, whatever it belongs to.
    """
    texts = F.transform(snippets, lambda s: s["snippet"])
    if field == "nmck":
        return _first(F.transform(texts, lambda t: F.nullif(parse_money_scaled(t), F.lit(0.0))))
    if field == "penalty_percent_per_day":
        return parse_percent(F.try_element_at(texts, F.lit(1)))
    found = F.transform(texts, _days)
    return _first(found if field == "payment_terms_days" else F.transform(found, lambda d: F.nullif(d, F.lit(0)))).cast("double")


def repair(df: DataFrame, mode: str = "manual_text") -> DataFrame:
    """Of facts(…, "ranked"): the repaired facts with what they were (<field>_before), why they were read again (<field>_cause), and the gate after it.

    A field whose section is missing, or that was read, is left alone, and so is one that the second pass
    can't read either.
    """
    gated = gate_ranked(df, mode)
    failed = {field: F.coalesce(F.col(f"reason_{field}") == "parse_failed", F.lit(False)) & (F.size(f"s_{SECTION_OF[field]}") > 0) for field in FACTS}
    gated = gated.withColumns({f"{field}_before": F.col(field).cast("double") for field in FACTS} | {f"{field}_cause": F.col(f"reason_{field}") for field in FACTS})
    again = {field: F.when(failed[field], F.coalesce(read_again(field, F.col(f"s_{SECTION_OF[field]}")), F.col(field).cast("double"))).otherwise(F.col(field).cast("double")) for field in FACTS}
    return gate_ranked(gated.withColumns(again), mode)
