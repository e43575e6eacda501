"""Relational queries over the analysis history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidlens import rules as R
from bidlens.functions.text import any_of, let
from bidlens.rules import DEFAULT_LIMIT, PLAN_LIMITS, VOTE_TIES


def masked(df: DataFrame) -> DataFrame:
    """Q2: no return where the money was skipped."""
    return df.withColumn("roi", F.when(~F.col("skipped"), F.col("roi")))


def latest(df: DataFrame, most: int) -> DataFrame:
    """Q1 for all users at once: their newest analyses, 1..100."""
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("id")))
    return df.withColumn("_nth", nth).filter(F.col("_nth") <= min(100, max(1, most))).drop("_nth")


def key_hash(key: Column) -> Column:
    """U4: what is stored of a key."""
    return F.sha2(key, 256)


def resolve_keys(requests: DataFrame, keys: DataFrame) -> DataFrame:
    """Q4: requests joined to the user of their key, both active."""
    return requests.join(keys.filter("key_active and user_active"), "key_hash")


def revoke_keys(keys: DataFrame, requests: DataFrame) -> DataFrame:
    """Q7: keys key_id, user_id, key_active after requests key_id, user_id; only an owner's request turns a key off."""
    asked = requests.select("key_id", "user_id").distinct().withColumn("_revoked", F.lit(True))
    return keys.join(asked, ["key_id", "user_id"], "left").withColumn("key_active", F.col("key_active") & F.col("_revoked").isNull()).drop("_revoked")


def provider(name: Column) -> Column:
    """The provider that a name stands for; any other is left to choice."""
    low = F.lower(F.trim(name))
    return F.when(low.isin("gemini", "google"), "gemini").when(low.isin("gigachat", "giga"), "gigachat").otherwise("auto")


def exists_in(df: DataFrame, other: DataFrame, key: str, name: str) -> DataFrame:
    """Q6."""
    return df.join(other.select(key).distinct().withColumn(name, F.lit(True)), key, "left").fillna(False, [name])


def plan_limit(plan: Column) -> Column:
    cases = F.lit(DEFAULT_LIMIT)
    for name, limit in PLAN_LIMITS.items():
        cases = F.when(plan == name, limit).otherwise(cases)
    return cases.cast("long")


def monthly_use(events: DataFrame, user: str, ts: str, plan: Column) -> DataFrame:
    """Q5: uses a month against the plan's limit."""
    used = events.groupBy(F.col(user).alias("user_id"), F.date_trunc("month", ts).alias("m")).agg(F.count(F.lit(1)).alias("used"))
    return used.select("user_id", F.date_format("m", "yyyy-MM").alias("month"), "used", plan_limit(plan).alias("quota"), (F.col("used") >= plan_limit(plan)).alias("exceeded"))


def dashboard(df: DataFrame) -> DataFrame:
    """Q8-Q11."""
    high = (F.col("risk_score") >= 8) | F.lower("risk_level").rlike("(?iu)high|critical|высок|крит")
    usage = F.least(F.count(F.lit(1)), F.lit(30))
    return df.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("risk_score"), 1).alias("mean_risk"), F.count_if(high).alias("high_risk"), F.max("id").alias("latest"), usage.alias("usage"), F.least(F.lit(100), F.round(usage * 100 / 30)).cast("long").alias("usage_percent")
    )


def tone(score: Column) -> Column:
    """Q12."""
    return F.when(score >= 9, "critical").when(score >= 7, "high").when(score >= 4, "medium").otherwise("low")


def _named(key: Column, names: dict[str, str], otherwise: str) -> Column:
    cases = F.lit(otherwise)
    for name, label in names.items():
        cases = F.when(key == name, label).otherwise(cases)
    return cases


def ui_level(score: Column, text: Column | None = None) -> Column:
    """Q14: by the score; without one by the first level word that the text holds, else low."""
    by_score = F.when(score >= 10, "critical").when(score >= 9, "high").when(score >= 7, "medium").when(score.isNotNull(), "low")
    if text is None:
        return F.coalesce(by_score, F.lit("low"))
    low = F.lower(text)
    return F.coalesce(by_score, *[F.when(F.contains(low, F.lit(word)), level) for word, level in R.LEVEL_WORDS], F.lit("low"))


def source_label(name: Column, kind: Column) -> Column:
    """Q13: the name if there is one, else what kind of source it was."""
    return F.when(name != "", name).otherwise(_named(kind, R.SOURCE_LABELS, R.SOURCE_OTHER))


def severity(reason: Column) -> Column:
    """Q15."""
    return let(F.lower(reason), lambda low: F.when(any_of(low, R.HIGH_SIGNALS), "high").when(any_of(low, R.MEDIUM_SIGNALS), "medium").otherwise("low"))


def finding_id(prefix: str, nth: Column, title: Column) -> Column:
    """Q16: prefix, number and slug of the title."""
    slug = F.btrim(F.regexp_replace(F.lower(title), "[^a-zа-я0-9]+", "-"), F.lit("-"))
    return F.concat(F.lit(f"{prefix}-"), nth.cast("string"), F.lit("-"), let(slug, lambda s: F.when(s == "", "item").otherwise(s)))


def findings(df: DataFrame, most: int = 6) -> DataFrame:
    """Q15, Q16: one row a reason, up to the sixth, with severity and id."""
    rows = df.select("id", F.posexplode(F.slice("reasons", 1, most)).alias("nth", "title"))
    return rows.select("id", F.col("nth").cast("long").alias("nth"), finding_id("r", F.col("nth"), F.col("title")).alias("finding_id"), severity(F.col("title")).alias("severity"), "title")


def fix_suggestions(advance: Column, after_full: Column, contract_security: Column, bid_security: Column, by_requests: Column) -> Column:
    """Q17: what to ask for, in this order; two general suggestions where nothing applies."""
    number = lambda value: F.coalesce(value, F.lit(0))
    holds = {"advance": number(advance) <= 0, "after_full": after_full, "contract_security": number(contract_security) >= 20, "bid_security": number(bid_security) >= 5, "by_requests": by_requests}
    found = F.array_compact(F.array(*[F.when(F.coalesce(condition, F.lit(False)), F.lit(R.FIXES[name])) for name, condition in holds.items()]))
    return let(found, lambda f: F.when(F.size(f) > 0, f).otherwise(F.array(*[F.lit(x) for x in R.FIXES_OTHERWISE])))


def decision(level: Column) -> Column:
    """Q18."""
    return _named(level, R.DECISIONS, R.DECISIONS["low"])


def level_label(level: Column) -> Column:
    """Q18."""
    return _named(level, R.LEVEL_LABELS, R.LEVEL_LABELS["low"])


def _grouped(value: Column) -> Column:
    return F.replace(F.format_number(F.round(value, 0), 0), F.lit(","), F.lit("\u00a0"))


def primary_factor(cash_gap: Column, reasons: Column) -> Column:
    """Q18: the cash gap if there is one, else the first reason."""
    gap = F.when(cash_gap > 0, F.concat(F.lit("Кассовый разрыв ~ "), _grouped(cash_gap), F.lit(" ₽")))
    return F.coalesce(gap, F.get(reasons, F.lit(0)), F.lit(R.NO_FACTOR))


def shown_rub(value: Column) -> Column:
    """Q19: whole roubles in the Russian manner, no-break spaces between thousands; a dash for null."""
    return F.coalesce(F.concat(_grouped(value), F.lit("\u00a0₽")), F.lit("—"))


def shown_percent(value: Column) -> Column:
    """Q19."""
    return F.coalesce(F.concat(F.round(value, 0).cast("long").cast("string"), F.lit("%")), F.lit("—"))


def shown_time(value: Column) -> Column:
    """Q19."""
    return F.date_format(value, "dd.MM.yyyy, HH:mm")


def _listed(items: Column, otherwise: str) -> Column:
    lines = F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))
    return F.when(F.size(items) > 0, F.array_join(lines, "\n")).otherwise(f"1. {otherwise}")


def report(c: dict[str, Column]) -> Column:
    """K5: the text report of an analysis, line by line.

    Keys of c: id, created_at, level (see ui_level), verdict, risk_score, roi_percent, cash_gap, safe_cost,
    reasons, fixes. The heading is the number of the analysis.
    """
    say = lambda label, value: F.concat(F.lit(label), value)
    return F.concat_ws(
        "\n",
        say("Анализ #", c["id"].cast("string")),
        say("Дата: ", shown_time(c["created_at"])),
        say("Решение: ", decision(c["level"])),
        say("Вердикт: ", c["verdict"]),
        F.concat(F.lit("Индекс риска: "), c["risk_score"].cast("string"), F.lit("/10")),
        say("Ожидаемый ROI: ", shown_percent(c["roi_percent"])),
        say("Кассовый разрыв: ", shown_rub(c["cash_gap"])),
        say("Безопасная себестоимость: ", shown_rub(c["safe_cost"])),
        F.lit(""),
        F.lit("Ключевые риски:"),
        _listed(F.slice(c["reasons"], 1, 6), "Не выделено"),
        F.lit(""),
        F.lit("Рекомендации:"),
        _listed(c["fixes"], "Нет рекомендаций"),
    )


def last_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Q20."""
    return df.groupBy(*keys).agg(F.max(order).alias(order))


def accuracy(df: DataFrame) -> DataFrame:
    """Q21."""
    ok = lambda c: F.avg(F.when(F.coalesce(c, F.lit(False)), 1.0).otherwise(0.0))
    out = df.rollup("mode").agg(
        F.count(F.lit(1)).alias("n"),
        ok(F.abs(F.col("f_nmck") - F.col("nmck")) <= F.col("nmck") * 0.01).alias("price"),
        ok(F.col("f_payment") == F.col("payment_terms_days")).alias("payment"),
        ok(F.col("f_execution") == F.col("execution_days")).alias("execution"),
        F.round(ok(F.col("f_penalty") == F.col("penalty_txt").cast("double")), 6).alias("penalty"),
    )
    return out.withColumn("mode", F.coalesce("mode", F.lit("all")))


def missing_reasons(df: DataFrame, most: int) -> DataFrame:
    """Q22: the commonest field and reason pairs, with their share of all rows."""
    pairs = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.concat(F.lit(c.removeprefix("reason_") + ":"), F.col(c))) for c in df.columns if c.startswith("reason_")]))
    counted = df.select(F.explode(F.concat(pairs, F.array(F.lit("")))).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    total = counted.filter("reason = ''").select(F.col("n").alias("total"))
    top = counted.filter("reason != ''").orderBy(F.desc("n"), "reason").limit(most)
    return top.join(F.broadcast(total)).select("reason", "n", F.round(F.col("n") * 100.0 / F.col("total"), 4).cast("double").alias("percent"))


def vote(answers: DataFrame, key: str, *fields: str) -> DataFrame:
    """One value a key and field of several answers key, nth, value, near; all fields in one grouping.

    A value scores 0.2 for each answer up to 0.6, 0.2 within the field's range, 0.2 if it stands near the
    field's words; values out of range take part. Of equal scores the field's rule decides, else the first.
    """
    counted = answers.filter("value is not null").groupBy(key, "value").agg(F.count(F.lit(1)).alias("n"), F.max(F.coalesce("near", F.lit(False))).alias("near"), F.min("nth").alias("first"))
    plus = lambda condition: F.when(condition, 0.2).otherwise(0.0)

    def best(field: str) -> Column:
        score = F.least(F.lit(0.6), F.lit(0.2) * F.col("n")) + plus(F.col("value").between(*R.VOTE_RANGES[field])) + plus(F.col("near"))
        order = {"largest": F.col("value"), "smallest": -F.col("value")}.get(VOTE_TIES.get(field, ""), -F.col("first"))
        return F.max_by("value", F.struct(score.alias("score"), order.alias("order"))).alias(field)

    return counted.groupBy(key).agg(*[best(field) for field in fields])


def vote_currency(answers: DataFrame, key: str) -> DataFrame:
    """The commonest known currency, the first in the alphabet of several."""
    counted = answers.filter(F.col("value").isin(R.CURRENCIES)).groupBy(key, "value").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(key).agg(F.min_by("value", F.struct(-F.col("n"), "value")).alias("currency"))


def vote_flag(answers: DataFrame, key: str, name: str) -> DataFrame:
    """Of answers key, nth, value, near: true if one says so and the text has the words; without the words the first answer; else false."""
    told = answers.filter("value is not null").groupBy(key).agg(F.max("value").alias("any"), F.max(F.coalesce("near", F.lit(False))).alias("near"), F.min_by("value", "nth").alias("first"))
    return told.select(key, F.when(F.col("any") & ~F.col("near"), F.col("first")).otherwise(F.col("any")).alias(name))
