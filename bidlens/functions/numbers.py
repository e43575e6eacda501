"""Scalar parsers over columns: money, percent, days, dates (P1-P15). Null where nothing can be read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bidlens.functions.text import let, normalize_light, normalize_text, strip
from bidlens.rules import AMOUNT_EVIDENCE

_RUB = r"(?iuU)\b(?:руб(?:\.|ля|лей)?|rur|rub)\b"
_VAT = r"(?iuU)\b(?:без\s*ндс|в\s*т\.?\s*ч\.?\s*ндс|ндс)\b"
_DAYS = r"(?iuU)(\d{1,4})\s*(рабоч\w*|календарн\w*)?\s*(?:дн\w*|день|дня|дней)"
#: Russian months in the genitive.
MONTHS = ["января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря"]


def some(text: Column) -> Column:
    """The text, null if it is empty; worked out once."""
    return let(text, lambda t: F.when(t != "", t))


def _plain_number(text: Column) -> Column:
    """Digits with separators as a double: of both separators the last is decimal; a lone one only before one or two final digits."""
    comma, dot = F.contains(text, F.lit(",")), F.contains(text, F.lit("."))
    without = lambda t, c: F.replace(t, F.lit(c), F.lit(""))
    last_comma = F.length(F.substring_index(text, ",", -1)) < F.length(F.substring_index(text, ".", -1))
    return (
        F.when(comma & dot & last_comma, F.replace(without(text, "."), F.lit(","), F.lit(".")))
        .when(comma & dot, without(text, ","))
        .when(comma & text.rlike(r",\d{1,2}$"), F.replace(text, F.lit(","), F.lit(".")))
        .when(comma, without(text, ","))
        .when(dot & ~text.rlike(r"\.\d{1,2}$"), without(text, "."))
        .otherwise(text)
        .try_cast("double")
    )


def parse_money(text: Column) -> Column:
    """The first amount, after taking out currency and VAT words."""
    text = F.regexp_replace(F.replace(F.regexp_replace(normalize_text(text), _RUB, ""), F.lit("₽"), F.lit("")), _VAT, "")
    found = F.regexp_extract(text, r"[-+]?\d[\d\s\u00A0\u202F.,]*", 0)
    return let(some(F.regexp_replace(F.regexp_replace(found, r"(?U)\s+", ""), r"^[.,]+|[.,]+$", "")), _plain_number)


def parse_money_scaled(text: Column) -> Column:
    """P1 times the billion, million or thousand named within 20 code points after the amount."""
    clean = F.regexp_replace(F.regexp_replace(F.replace(normalize_text(text), F.lit("₽"), F.lit("")), _RUB, ""), _VAT, "")
    after = F.lower(F.left(F.regexp_extract(clean, r"(?s)[-+]?\d[\d\s\u00A0\u202F.,]*(.*)", 1), F.lit(20)))
    factor = let(after, lambda a: F.when(F.contains(a, F.lit("млрд")), 1e9).when(F.contains(a, F.lit("млн")), 1e6).when(F.contains(a, F.lit("тыс")), 1e3).otherwise(1.0))
    return let(clean, lambda c: parse_money(c) * factor)


def parse_money_grouped(text: Column) -> Column:
    """The first amount with well-formed groups of thousands, exact; a lone comma is decimal."""
    raw = F.regexp_replace(some(F.regexp_extract(text, AMOUNT_EVIDENCE, 0)), r"[\s\u00A0\u202F]+", "")
    return F.replace(raw, F.lit(","), F.lit(".")).try_cast("decimal(20,2)")


def parse_percent(text: Column) -> Column:
    """A number before % or, failing that, before the word."""

    def read(t: Column) -> Column:
        sign = some(F.regexp_extract(t, r"(-?\d+(?:[.,]\d+)?)\s*%", 1))
        word = some(F.regexp_extract(t, r"(?iuU)(-?\d+(?:[.,]\d+)?)\s*процент\w*", 1))
        return F.replace(F.coalesce(sign, word), F.lit(","), F.lit(".")).try_cast("double")

    return F.when(text.isNotNull(), let(normalize_text(text), read))


def parse_days(text: Column) -> Column:
    """(days, type) of the first term in days; type is working, calendar or null."""
    return first_days(normalize_text(text), _DAYS)


def parse_days_ranked(text: Column) -> Column:
    """P7 of the ranked variant, which knows whole days by their other name as well."""
    return first_days(normalize_text(text), _DAYS.replace("|дней)", r"|дней|сут\w*)"))


def first_days(text: Column, pattern: str) -> Column:
    """(days, type) of the pattern's first match; its groups are looked for in the match alone. Null without a match."""
    return let(F.regexp_extract(text, pattern, 0), lambda m: F.when(m != "", days_of_match(m, pattern)))


def days_of_match(match: Column, pattern: str) -> Column:
    return day_pair(F.regexp_extract(match, pattern, 1), F.regexp_extract(match, pattern, 2))


def day_pair(days: Column, unit: Column) -> Column:
    kind = lambda u: F.when(F.contains(u, F.lit("рабоч")), "working").when(F.contains(u, F.lit("календар")), "calendar")
    return F.struct(some(days).try_cast("int").alias("days"), let(F.lower(unit), kind).alias("type"))


def to_calendar(days: Column) -> Column:
    """Working days as calendar days, rounded up."""
    return F.ceil(days * F.lit(1.4)).cast("int")


def calendar_days(pair: Column) -> Column:
    return F.when(pair["type"] == "working", to_calendar(pair["days"])).otherwise(pair["days"])


def parse_date(text: Column) -> Column:
    """D.m.Y or d.m.y with any of . / -, or the month by name."""
    plain = F.translate(strip(text), "/-", "..")
    for number, name in enumerate(MONTHS, 1):
        plain = F.regexp_replace(plain, rf"(?iuU)\s+{name}\s+", f".{number}.")
    # Two-digit years: 69-99 are of the last century.
    century = lambda d: F.when(F.right(d, F.lit(2)) >= "69", "19").otherwise("20")
    full = let(plain, lambda d: F.when(d.rlike(r"^\d{1,2}\.\d{1,2}\.\d{2}$"), F.concat(F.left(d, F.length(d) - 2), century(d), F.right(d, F.lit(2)))).otherwise(d))
    return let(full, lambda d: F.when(d.rlike(r"^\d{1,2}\.\d{1,2}\.\d{4}$"), F.try_to_timestamp(d, F.lit("d.M.yyyy")).cast("date")))


def parse_date_range(text: Column) -> Column:
    """P10: days from the first date to the second, if positive."""
    dates = F.regexp_extract_all(normalize_text(text), F.lit(r"\d{1,2}[./-]\d{1,2}[./-]\d{2,4}"), F.lit(0))
    apart = lambda d: F.datediff(F.get(d, F.lit(1)), F.get(d, F.lit(0)))
    return let(let(F.transform(F.slice(dates, 1, 2), parse_date), apart), lambda days: F.when(days > 0, days))


def key_rate_fraction(text: Column, pattern: str) -> Column:
    """(numerator, denominator) of a fraction of the key rate."""
    lower = some(F.regexp_extract(text, pattern, 2)).try_cast("int")
    return F.when(lower > 0, F.struct(some(F.regexp_extract(text, pattern, 1)).try_cast("int").alias("numerator"), lower.alias("denominator")))


def number_tokens(text: Column) -> Column:
    """Cells of a line, parted by tab, semicolon, bar or two blanks and more."""
    return F.filter(F.transform(F.split(text, r"[\t;|]|\s{2,}"), strip), lambda x: x != "")


def safe_number(text: Column) -> Column:
    """P5: what is left of digits, dots and minus signs, as a double."""
    return some(F.regexp_replace(F.replace(text, F.lit(","), F.lit(".")), r"[^0-9.\-]", "")).try_cast("double")


def safe_int(text: Column) -> Column:
    """P5: the number rounded half to even."""
    return F.bround(safe_number(text), 0).try_cast("long")


def parse_amount(text: Column) -> Column:
    """All digits and separators of the text as one amount; currency words and other letters are left out."""
    plain = F.replace(F.regexp_replace(normalize_light(text), _RUB, ""), F.lit("₽"), F.lit(""))
    digits = F.regexp_replace(F.regexp_replace(plain, r"(?U)[^0-9,.\-\s]", ""), r"(?U)\s+", "")
    return let(some(F.regexp_replace(digits, r"^[.,]+|[.,]+$", "")), _plain_number)


def safe_bool(text: Column) -> Column:
    """P5: yes and no words."""
    low = F.lower(strip(text))
    return F.when(low.isin("true", "1", "yes", "да"), True).when(low.isin("false", "0", "no", "нет"), False)


def json_in_text(text: Column, schema: str) -> Column:
    """The object between the first and the last brace."""
    return F.from_json(some(F.regexp_extract(text, r"(?s)\{.*\}", 0)), schema)


def format_rub(amount: Column) -> Column:
    """Whole roubles with blanks between thousands; a dash for null."""
    return F.coalesce(F.concat(F.replace(F.format_number(F.bround(amount, 0), 0), F.lit(","), F.lit(" ")), F.lit(" ₽")), F.lit("—"))


def percent_amount(amount: Column, percent: Column) -> Column:
    """P15."""
    return amount * percent / F.lit(100.0)
