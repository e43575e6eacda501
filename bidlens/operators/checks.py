"""What is wrong with extracted facts, as ordered codes with labels.

A rule is a condition over a row and a code; codes are joined to their labels. The order of the rules is
the order in which a reader gets the codes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidlens import rules as R
from bidlens.functions.numbers import to_calendar
from bidlens.functions.text import any_of, let

FACTS = ("nmck", "payment_terms_days", "execution_days", "penalty_percent_per_day")
#: Ranges of a valid fact when quality is judged, and when errors are listed.
QUALITY_RANGES = {"nmck": (1e3, 1e11), "payment_terms_days": (1, 3650), "execution_days": (1, 5000), "penalty_percent_per_day": (0, 10)}
#: Names of facts, and what the reasons and codes mean.
FACT_LABELS = {"nmck": "НМЦК", "payment_terms_days": "срок оплаты", "execution_days": "срок исполнения", "penalty_percent_per_day": "пеня в день"}
REASON_LABELS = {"absent_in_docs": "Отсутствует в документах", "parse_failed": "Ошибка извлечения", "conflict": "Конфликт/некорректное значение"}
OUT_OF_RANGE = ": значение есть, но выходит за допустимые границы."
NOT_READ = ": найдены ключевые слова, но парсинг не сработал. Фрагмент: "
NO_SNIPPET = ": найдены ключевые слова, но подходящий фрагмент не найден."
_WORDS = {"nmck": R.SECTIONS_BASIC["price"], "payment_terms_days": R.SECTIONS_BASIC["payment"], "execution_days": R.SECTIONS_BASIC["execution"], "penalty_percent_per_day": R.SECTIONS_BASIC["penalties"]}
_SNIPPETS = {"nmck": "s_price", "payment_terms_days": "s_payment", "execution_days": "s_execution", "penalty_percent_per_day": "s_penalties"}


def _holds(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def quality(df: DataFrame) -> DataFrame:
    """G11 over columns corpus, the facts and the basic snippets (s_*): quality_score and quality, an array of (field, reason, label, warning) of the facts that aren't valid, in order."""

    def judge(field: str) -> Column:
        value, snippets = F.col(field).cast("double"), F.col(_SNIPPETS[field])
        whole = F.when(value < 0, F.ceil(value)).otherwise(F.floor(value)) if field in ("payment_terms_days", "execution_days") else value
        valid = _holds(whole.between(*QUALITY_RANGES[field]))
        there = any_of(F.lower("corpus"), _WORDS[field])
        reason = F.when(value.isNotNull(), "conflict").when(~there, "absent_in_docs").otherwise("parse_failed")
        # What stands in the first snippet, in one line.
        seen = F.substring(F.regexp_replace(F.try_element_at(snippets, F.lit(1))["snippet"], r"(?U)\s+", " "), 1, 200)
        told = F.when(value.isNotNull(), FACT_LABELS[field] + OUT_OF_RANGE).when(there, F.when(F.size(snippets) > 0, F.concat(F.lit(FACT_LABELS[field] + NOT_READ), seen)).otherwise(FACT_LABELS[field] + NO_SNIPPET))
        label = lambda r: F.coalesce(*[F.when(r == code, text) for code, text in REASON_LABELS.items()])
        return F.when(~valid, let(reason, lambda r: F.struct(F.lit(field).alias("field"), r.alias("reason"), label(r).alias("label"), told.alias("warning"))))

    found = F.array_compact(F.array(*[judge(field) for field in FACTS]))
    return df.withColumn("quality", found).withColumn("quality_score", F.round((len(FACTS) - F.size("quality")) * 100 / len(FACTS)).cast("long"))


def base_reasons(df: DataFrame, mode: str) -> DataFrame:
    """G13 after gate(): base_<field> beside reason_<field>; a typed text that lacks a section is partial input, not a fault of the documents."""
    manual = mode.startswith("manual_text")
    return df.withColumns({f"base_{field}": F.when(F.col(f"reason_{field}") == "not_provided_in_text", "partial_input").otherwise(F.col(f"reason_{field}")) if manual else F.col(f"reason_{field}") for field in FACTS})


def listed_errors(payment: Column, execution: Column, penalty: Column) -> Column:
    """Texts of the errors that a repair is asked for, in order."""
    whole = lambda v: F.when(v < 0, F.ceil(v)).otherwise(F.floor(v))
    valid = {"payment_terms_days": whole(payment.cast("double")).between(1, 365), "execution_days": whole(execution.cast("double")).between(1, 5000), "penalty_percent_per_day": (penalty > 0) & (penalty <= 10)}
    return F.array_compact(F.array(*[F.when(~_holds(ok), f"{field} missing or out of range") for field, ok in valid.items()]))


def check_selection(price: Column, payment: Column, execution: Column, penalty: Column, payments: Column) -> Column:
    """(warnings, nmck, payment_days, conservative_days, advance_allowed, advance_percent, execution_days, penalty, conflicts).

    The picks are structs with quote and value (payment: days, type, allowed, advance_percent; penalty: quote), null
    where nothing was picked; `payments` holds all payment candidates. A pick without a quote, or with a
    value out of range, is a conflict and goes. No advance, if any candidate says so, holds for the pick. The
    conservative term is the longest of all candidates, working days as calendar days.
    """
    empty = lambda c: F.trim(F.coalesce(c["quote"], F.lit(""))) == ""
    given = lambda c: c.isNotNull()
    value, days = price["value"].cast("double"), F.bround(payment["days"].cast("double"), 0).cast("long")
    term = F.bround(execution["value"].cast("double"), 0).cast("long")
    longest = lambda kind: F.array_max(F.transform(F.filter(payments, lambda c: _holds(c["type"] == kind)), lambda c: F.bround(c["days"].cast("double"), 0).cast("long")))
    working, calendar = longest("working"), longest("calendar")
    denied = F.exists(payments, lambda c: _holds(~c["allowed"]))
    rejected = {
        "nmck_non_positive_rejected": given(price) & ~empty(price) & (value.isNull() | (value <= 0)),
        "nmck_out_of_range_rejected": given(price) & ~empty(price) & _holds(value > 0) & ~value.between(100, 1e12),
        "nmck_missing_evidence_quote": given(price) & empty(price),
        "payment_terms_missing_evidence_quote": given(payment) & empty(payment),
        "payment_days_out_of_range_rejected": given(payment) & ~empty(payment) & _holds(~days.between(1, 3650)),
        "execution_days_invalid_rejected": given(execution) & ~empty(execution) & ~_holds(term > 0),
        "execution_days_missing_evidence_quote": given(execution) & empty(execution),
        "penalties_missing_evidence_quote": given(penalty) & empty(penalty),
    }
    fields = {"nmck": "nmck_", "payment_terms": "payment_", "execution_days": "execution_", "penalties": "penalties_"}
    refused = {field: F.coalesce(*[F.when(_holds(c), True) for code, c in rejected.items() if code.startswith(prefix)], F.lit(False)) for field, prefix in fields.items()}
    kept = {"nmck": given(price) & ~refused["nmck"], "payment_terms": given(payment) & ~refused["payment_terms"], "execution_days": given(execution) & ~refused["execution_days"], "penalties": given(penalty) & ~refused["penalties"]}
    both = kept["payment_terms"] & working.isNotNull() & calendar.isNotNull()
    order = [*list(rejected)[:5], "payment_days_conflict_working_vs_calendar_kept_both", *list(rejected)[5:]]
    holds = rejected | {"payment_days_conflict_working_vs_calendar_kept_both": both}
    conservative = F.coalesce(F.greatest(to_calendar(working).cast("long"), calendar), days)
    return F.struct(
        F.array_compact(F.array(*[F.when(_holds(holds[code]), code) for code in order])).alias("warnings"),
        F.when(kept["nmck"], value).alias("nmck"),
        F.when(kept["payment_terms"], days).alias("payment_days"),
        F.when(kept["payment_terms"], conservative).alias("conservative_days"),
        F.when(kept["payment_terms"], F.when(denied, False).otherwise(payment["allowed"])).alias("advance_allowed"),
        F.when(kept["payment_terms"], F.when(denied & payment["advance_percent"].isNotNull(), 0.0).otherwise(payment["advance_percent"])).alias("advance_percent"),
        F.when(kept["execution_days"], term).alias("execution_days"),
        F.when(kept["penalties"], penalty["quote"]).alias("penalty"),
        F.array_compact(F.array(*[F.when(refused[field], field) for field in fields])).alias("conflicts"),
    )
