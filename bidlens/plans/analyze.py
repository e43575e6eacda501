"""End-to-end analysis of tenders in three variants: text to facts, gate, risk, money and verdict.

Each variant is one projection chain over a row's text: no shuffle, no Python, and the same plan for
one tender or for billions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidlens import rules as R
from bidlens.functions.numbers import parse_money, safe_number, to_calendar
from bidlens.functions.text import any_of, clip_centred, count_hits, find_all, let, normalize_text
from bidlens.operators import mining as M
from bidlens.operators.corpus import blocks
from bidlens.operators.retrieval import basic_snippets, cased, evidence_snippets, ranked_snippets
from bidlens.operators.risk import danger_phrases, financials, risk, safe_cost, verdict

VARIANTS = ("basic", "ranked", "evidence")
FACTS = ("nmck", "payment_terms_days", "execution_days", "penalty_percent_per_day")
SECTION_OF = {"nmck": "price", "payment_terms_days": "payment", "execution_days": "execution", "penalty_percent_per_day": "liability"}


def _null() -> Column:
    return F.lit(None).cast("double")


def _core_price(text: Column) -> Column:
    """The price right after a keyword, whole roubles; it overrides the mined one (B2)."""
    pattern = r"(?iuU)(?:нмцк|начальн\w*\s*\(максимальн\w*\)\s*цена)[^\d]{0,60}(\d[\d\s  .,]*\d)"

    def score(m: Column) -> Column:
        value = F.bround(parse_money(F.regexp_extract(m["match"], pattern, 1)), 0)
        points = lambda quote: F.when(F.contains(quote, F.lit("нмцк")), 5).otherwise(0) + F.when(F.contains(quote, F.lit("цена")), 2).otherwise(0) + F.when(F.contains(quote, F.lit("руб")), 1).otherwise(0)
        return F.struct(let(F.lower(clip_centred(text, m["start"], m["end"])), points).alias("points"), value.alias("value"))

    return F.array_max(F.filter(F.transform(find_all(text, pattern), score), lambda c: c["value"].isNotNull()))["value"]


def _core_fine(text: Column) -> Column:
    """The largest fine whose surroundings don't speak of days."""
    pattern = r"(?iuU)штраф\w*[^\d%]{0,80}(\d+(?:[.,]\d+)?)\s*%"

    def read(m: Column) -> Column:
        said = any_of(F.lower(clip_centred(text, m["start"], m["end"])), ["день", "дн", "сутк", "ежедневн"])
        return F.when(~said, safe_number(F.regexp_extract(m["match"], pattern, 1)))

    return F.array_max(F.transform(find_all(text, pattern), read))


def _basic(df: DataFrame) -> DataFrame:
    """R1, C1-C4, C15, G1, G5, G6."""
    text = F.col("corpus")
    df = df.withColumns({f"s_{section}": basic_snippets(text, section, lower=F.col("cased")) for section in R.SECTIONS_BASIC} | {"files": blocks(text)})
    df = df.withColumns(
        {
            "c_price": M.price_basic(text, F.col("s_price"), F.col("files")),
            "payment": M.best(M.payment_basic(text, F.col("s_payment"))),
            "execution": M.best(M.execution_basic(text, F.col("s_execution"))),
            "penalty": M.best(M.penalty_basic(text, F.col("s_penalties"))),
        }
    ).withColumn("price", M.best(F.filter("c_price", lambda c: c["value"].between(1e3, 1e11))))
    pay = F.col("payment")
    return df.withColumns(
        {
            "nmck": F.coalesce(_core_price(text), F.col("price.value")),
            "payment_terms_days": F.coalesce(pay["final_calendar"], to_calendar(pay["final_working"]), pay["advance_days"], pay["days"]),
            "execution_days": F.col("execution.value"),
            "penalty_percent_per_day": F.col("penalty.per_day"),
            "fine_percent": F.coalesce(F.col("penalty.fine"), _core_fine(text)),
            "advance_percent": _null(),
            "vague": F.lit(False),
            "quote": F.col("price.quote"),
        }
    )


def _ranked(df: DataFrame) -> DataFrame:
    """R3, C6-C9, G2, G3, G7."""
    text = F.col("corpus")
    df = df.withColumns({f"s_{section}": ranked_snippets(text, section, lower=F.col("cased")) for section in ("price", "payment", "execution", "liability")})
    df = df.withColumns(
        {
            "price": M.best(M.price_ranked(text, F.col("s_price"))),
            "payment": M.best(M.payment_ranked(F.col("s_payment"))),
            "execution": M.best(M.execution_ranked(text, F.col("s_execution"))),
            "penalty": M.best(M.penalty_ranked(F.col("s_liability"))),
        }
    )
    return df.withColumns(
        {
            "nmck": F.col("price.value"),
            "payment_terms_days": F.col("payment.days"),
            "execution_days": F.col("execution.value"),
            "penalty_percent_per_day": F.col("penalty.per_day"),
            "fine_percent": F.col("penalty.fine"),
            "advance_percent": _null(),
            "vague": F.col("cased.low").rlike(R.TRAPS_RANKED["has_vague_acceptance_terms"]),
            "quote": F.col("price.quote"),
        }
    )


def _evidence(df: DataFrame) -> DataFrame:
    """Conservative terms over all payment candidates, no advance if any candidate says so."""
    text = F.col("corpus")
    df = df.withColumns({f"s_{section}": evidence_snippets(text, section, lower=F.col("cased")) for section in R.SECTIONS_EVIDENCE})
    anchors = {"price": ["начальная (максимальная) цена", "нмцк", "цена контракта"], "payment": ["оплат", "расчет", "аванс", "счет"], "execution": ["срок", "поставк", "исполн", "оказани"], "penalty": ["пеня", "неустой", "штраф", "1042"]}

    def choose(candidates: Column, words: list[str]) -> Column:
        ordered = F.array_sort(candidates)
        anchored = F.filter(ordered, lambda c: any_of(F.lower(c["quote"]), words))
        return F.coalesce(F.try_element_at(anchored, F.lit(1)), F.try_element_at(ordered, F.lit(1)))

    df = (
        df.withColumn("c_price", M.price_evidence(F.col("s_price")))
        .withColumn("c_payment", M.payment_evidence(F.col("s_payment")))
        .withColumn("c_execution", M.execution_evidence(F.col("s_execution")))
        .withColumn("c_penalty", M.penalty_evidence(F.col("s_liability")))
        .withColumn("price", choose(F.slice(F.array_sort("c_price"), 1, 12), anchors["price"]))
        .withColumn("payment", choose(F.col("c_payment"), anchors["payment"]))
        .withColumn("execution", choose(F.col("c_execution"), anchors["execution"]))
        .withColumn("penalty", choose(F.col("c_penalty"), anchors["penalty"]))
    )
    of_type = lambda kind: F.array_max(F.transform(F.filter("c_payment", lambda c: c["type"] == kind), lambda c: c["days"]))
    conservative = F.coalesce(F.greatest(to_calendar(of_type("working")), of_type("calendar")), F.col("payment.days"))
    denied = F.exists("c_payment", lambda c: F.coalesce(~c["allowed"], F.lit(False)))
    sane = F.col("payment").isNotNull() & F.coalesce(F.col("payment.days").between(1, 3650), F.lit(True))
    return (
        df.withColumn("nmck", F.when(F.col("price.value").between(100, 1e12), F.col("price.value")))
        .withColumn("payment_terms_days", F.when(sane, conservative))
        .withColumn("execution_days", F.when(F.col("execution.value") > 0, F.col("execution.value")))
        .withColumn("penalty_percent_per_day", _null())
        .withColumn("fine_percent", F.col("penalty.fine"))
        .withColumn("advance_percent", F.when(sane & denied, F.lit(0.0)).when(sane, F.col("payment.advance_percent")))
        .withColumn("vague", F.lit(False))
        .withColumn("quote", F.regexp_replace(F.col("price.quote"), r"\s+", " "))
    )


def facts(df: DataFrame, variant: str, text_col: str = "text") -> DataFrame:
    """The input's columns and the variant's facts, with its snippets and candidates."""
    df = df.withColumn("corpus", normalize_text(F.coalesce(F.col(text_col), F.lit("")))).withColumn("cased", cased(F.col("corpus")))
    return {"basic": _basic, "ranked": _ranked, "evidence": _evidence}[variant](df)


def traps(text: Column, variant: str, low: Column | None = None) -> dict[str, Column]:
    """G19. `low` is the text in lower case where a row has it already."""
    table = R.TRAPS_RANKED if variant == "ranked" else R.TRAPS_BASIC
    low = text if variant != "ranked" else F.lower(text) if low is None else low
    return {name: F.coalesce(low.rlike(pattern), F.lit(False)) for name, pattern in table.items() if name != "has_vague_acceptance_terms"}


def section_hits(text: Column, low: Column | None = None) -> dict[str, Column]:
    """Keyword hits of each counted section. `low` is the text in lower case where a row has it already."""
    low = F.lower(text) if low is None else low
    return {section: count_hits(low, words) for section, words in R.SECTIONS_COUNTED.items()}


def valid(field: str, value: Column) -> Column:
    """Validity for the gate."""
    return F.coalesce((value > 0) & (value <= 100) if field == "penalty_percent_per_day" else value > 0, F.lit(False))


def gate(df: DataFrame, mode: str = "manual_text") -> DataFrame:
    """G12-G15 over columns corpus and the facts: has_*_section, sections, is_partial, partial_reasons, reason_*, completeness, can_compute."""
    text, manual = F.col("corpus"), mode.startswith("manual_text")
    low = F.col("cased.low") if "cased" in df.columns else None
    df = df.withColumns({f"has_{section}_section": hits > 0 for section, hits in section_hits(text, low).items()})
    present = sum((F.col(f"has_{s}_section").cast("int") for s in R.SECTIONS_COUNTED), F.lit(0))
    priced = valid("nmck", F.col("nmck"))
    has_price = F.col("has_price_section")
    reasons = [
        F.when(~(has_price & priced), "manual_text_without_price") if manual else F.lit(None).cast("string"),
        F.when(~has_price, "missing_price_section"),
        F.when(present <= 1, "only_contract_excerpt"),
        F.when(F.length(text) < 4000, "corpus_too_short"),
    ]
    df = df.withColumn("sections_score", present * 25).withColumn("partial_reasons", F.array_sort(F.array_compact(F.array(*reasons)))).withColumn("is_partial", F.size("partial_reasons") > 0)
    for field in FACTS:
        there = F.col(f"has_{SECTION_OF[field]}_section")
        absent = F.when(F.col("is_partial"), "not_provided_in_text").otherwise("absent_in_docs") if manual else F.lit("absent_in_docs")
        df = df.withColumn(f"reason_{field}", F.when(~valid(field, F.col(field)), F.when(there, "parse_failed").otherwise(absent)))
    count = sum((valid(field, F.col(field)).cast("int") for field in FACTS), F.lit(0))
    blocked = F.col("is_partial") & ~(priced & has_price) if manual else F.lit(False)
    return df.withColumn("completeness", count * 25).withColumn("can_compute", priced & ~blocked)


def gate_ranked(df: DataFrame, mode: str = "manual_text") -> DataFrame:
    """As gate(), by the ranked variant's own rules."""
    manual = mode in ("manual_text", "attachments_plus_text")
    sections = ("price", "payment", "execution", "liability")
    for section in sections:
        df = df.withColumn(f"has_{section}_section", F.size(f"s_{section}") > 0)
    missing = sum(((~F.col(f"has_{s}_section")).cast("int") for s in sections), F.lit(0)) > 0
    reasons = [
        F.when(missing, "manual_text_missing_sections") if mode == "manual_text" else F.lit(None).cast("string"),
        F.when(~F.col("has_price_section"), "missing_price_section"),
        F.when(missing & (F.length("corpus") < 1200), "corpus_too_short"),
    ]
    df = df.withColumn("partial_reasons", F.array_sort(F.array_compact(F.array(*reasons)))).withColumn("is_partial", F.size("partial_reasons") > 0)
    ok = {field: F.coalesce(F.col(field).between(0, 100) if field == "penalty_percent_per_day" else F.col(field) > 0, F.lit(False)) for field in FACTS}
    candidate = {"nmck": "price", "payment_terms_days": "payment", "execution_days": "execution", "penalty_percent_per_day": "penalty"}
    for field in FACTS:
        there = F.col(f"has_{SECTION_OF[field]}_section")
        code = F.when(F.col("is_partial") & ~there, "partial_input") if manual else F.lit(None).cast("string")
        df = df.withColumn(f"reason_{field}", F.when(~ok[field], F.coalesce(code, F.when(~there & F.col(candidate[field]).isNull(), "not_provided_in_docs"), F.lit("parse_failed"))))
    return df.withColumn("completeness", sum((c.cast("int") for c in ok.values()), F.lit(0)) * 25).withColumn("can_compute", ok["nmck"] & ~F.col("is_partial"))


def gate_evidence(df: DataFrame, mode: str = "manual_text") -> DataFrame:
    """Reasons by candidate; names of payment and penalty reasons that the risk rules don't know."""
    names = {"nmck": "price", "payment_terms": "payment", "execution_days": "execution", "penalties": "penalty"}
    kept = {"nmck": F.col("nmck").isNotNull(), "payment_terms": F.col("payment_terms_days").isNotNull() | (F.col("payment").isNotNull() & F.col("payment.days").isNull()), "execution_days": F.col("execution_days").isNotNull(), "penalties": F.col("penalty").isNotNull()}
    missing = [F.when(~kept[name], f"missing_{name}") for name in names]
    extra = F.when(~kept["nmck"], "manual_without_nmck") if mode == "manual_text" else F.lit(None).cast("string")
    df = df.withColumn("partial_reasons", F.array_sort(F.array_compact(F.array(*missing, extra)))).withColumn("is_partial", F.size("partial_reasons") > 0)
    for field, name in zip(FACTS, names, strict=True):
        found = F.size(f"c_{names[name]}") > 0
        df = df.withColumn(f"reason_{field}", F.when(~kept[name], F.when(found, "conflict").otherwise("not_provided")))
    count = sum((c.cast("int") for c in kept.values()), F.lit(0))
    return df.withColumn("completeness", count * 25).withColumn("can_compute", kept["nmck"] & (F.col("nmck") > 0))


def analyze(df: DataFrame, variant: str = "basic", mode: str = "manual_text", text_col: str = "text", cost_col: str = "cost_price", margin_col: str = "planned_margin_percent", id_col: str = "k") -> DataFrame:
    """One row per tender: facts, gate, danger phrases, risk, money, verdict.

    A null text is empty; a null cost or margin leaves the money columns null or 0 as the rules say.
    """
    known = facts(df, variant, text_col)
    for name, flag in traps(F.col("corpus"), variant, F.col("cased.low")).items():
        known = known.withColumn(name, flag)
    known = {"basic": gate, "ranked": gate_ranked, "evidence": gate_evidence}[variant](known, mode)
    unknown = F.lit(None).cast("string")
    codes = variant != "evidence"
    scored = risk(
        {
            "nmck": F.col("nmck"),
            "payment_terms_days": F.col("payment_terms_days"),
            "execution_days": F.col("execution_days"),
            "penalty": F.col("penalty_percent_per_day"),
            "advance": F.col("advance_percent"),
            "bid_security": _null(),
            "contract_security": _null(),
            "payment_reason": F.col("reason_payment_terms_days") if codes else unknown,
            "penalty_reason": F.col("reason_penalty_percent_per_day") if codes else unknown,
            "vague": F.col("vague"),
            "pay_after_full": F.col("payment_after_full_delivery"),
            "by_requests": F.col("delivery_by_customer_requests"),
            "hold_stock": F.col("supplier_must_hold_stock"),
        }
    )
    for name, value in scored.items():
        known = known.withColumn(name, value)
    allowed = F.coalesce(F.col("nmck") > 0, F.lit(False))
    roi, gap = financials(F.col("nmck"), F.col(cost_col), F.col(margin_col), F.col("payment_terms_days"), F.col("execution_days"))
    return known.withColumn("roi_percent", F.when(allowed, roi)).withColumn("cash_gap", F.when(allowed, gap)).select(
        F.col(id_col),
        F.lit(variant).alias("variant"),
        F.col("nmck").cast("double").alias("nmck"),
        F.col("payment_terms_days").cast("long").alias("payment_terms_days"),
        F.col("execution_days").cast("long").alias("execution_days"),
        F.col("penalty_percent_per_day").cast("double").alias("penalty_percent_per_day"),
        F.col("fine_percent").cast("double").alias("fine_percent"),
        F.col("advance_percent").cast("double").alias("advance_percent"),
        "payment_after_full_delivery",
        "delivery_by_customer_requests",
        "supplier_must_hold_stock",
        F.col("vague").alias("has_vague_acceptance_terms"),
        F.col("completeness").cast("long").alias("completeness"),
        "is_partial",
        F.array_join("partial_reasons", "|").alias("partial_reasons"),
        "can_compute",
        F.size(danger_phrases(F.col("corpus"))).cast("long").alias("n_danger"),
        F.col("risk_score").cast("long").alias("risk_score"),
        "risk_level",
        F.array_join("reasons", "|").alias("reasons"),
        F.round("roi_percent", 2).alias("roi_percent"),
        F.round("cash_gap", 2).alias("cash_gap"),
        F.when(allowed, safe_cost(F.col("nmck"), F.col("roi_percent"))).alias("safe_cost"),
        verdict(F.col("nmck"), allowed, F.col("is_partial"), F.col("risk_score")).alias("verdict"),
        F.col("quote"),
    )
