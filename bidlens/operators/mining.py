"""Candidate mining (C1-C16): patterns over retrieved snippets, scored; and the choice of the best.

Every miner maps an array of snippets to an array of candidates whose first fields are the order in
which candidates are preferred, so that the best is the smallest. Three variants share these helpers and
keep their own patterns and weights: basic, ranked, evidence.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from bidlens import rules as R
from bidlens.functions.numbers import calendar_days, days_of_match, first_days, key_rate_fraction, parse_date, parse_date_range, parse_money, parse_money_grouped, parse_percent, some, to_calendar
from bidlens.functions.text import any_of, clip, find_all, let, starts_of
from bidlens.operators.corpus import block_file

_CALENDAR = "календар"
#: Candidates of a field that are kept, by variant.
MOST_BASIC, MOST_RANKED, MOST_EVIDENCE = 8, 10, 12


def _clamped(value: Column) -> Column:
    """C16."""
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)), 4)


def _bonus(condition: Column, value: float) -> Column:
    return F.when(condition, F.lit(value)).otherwise(F.lit(0.0))


def _all_days(text: Column, pattern: str) -> Column:
    """Calendar days of every match."""
    return F.transform(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: days_of_match(m, pattern)), calendar_days)


def _percent_at(text: Column, pattern: str) -> Column:
    return parse_percent(some(F.regexp_extract(text, pattern, 0)))


def _count(*signals: Column) -> Column:
    total = F.lit(0)
    for signal in signals:
        total = total + signal.cast("int")
    return total


def _hits(text: Column, words: list[str]) -> Column:
    return let(text, lambda t: _count(*[F.contains(t, F.lit(word)) for word in words]))


def _best(candidates: Column) -> Column:
    """The first in order; null if there is none."""
    return F.try_element_at(F.array_sort(candidates), F.lit(1))


def _listed(found: Column, order: Callable[[Column], list[Column]], key: Callable[[Column], Column], most: int) -> Column:
    """The first `most` candidates in that order (then as found), of equal keys the first. No more are held at a time, so one pass does."""
    ordered = F.array_sort(F.transform(found, lambda c, nth: F.struct(F.struct(*order(c), nth).alias("order"), c.alias("c"))))

    def keep(kept: Column, x: Column) -> Column:
        return F.when((F.size(kept) >= most) | F.exists(kept, lambda k: key(k) == key(x["c"])), kept).otherwise(F.concat(kept, F.array(x["c"])))

    return let(ordered, lambda all_: F.aggregate(all_, F.transform(F.filter(all_, lambda x: F.lit(False)), lambda x: x["c"]), keep))


def _ranked(found: Column) -> Column:
    """By confidence, offset and id; of equal values at one offset the first; ten at most."""
    return _listed(found, lambda c: [c["rank"], c["offset"], c["id"]], lambda c: F.struct(c["value"], c["offset"]), MOST_RANKED)


def _json_number(value: Column) -> Column:
    """A double as JSON text that never uses an exponent for values in range; it breaks ties by its characters."""
    whole = F.concat(value.cast("long").cast("string"), F.lit(".0"))
    return F.when(value == F.floor(value), whole).otherwise(F.regexp_replace(F.format_string("%.6f", value), "0+$", ""))


def _spaces(corpus: Column, snippets: Column) -> Column:
    """Where the basic miners look: in a section's snippets, in the whole corpus if there is none."""
    own = F.transform(snippets, lambda s: F.struct(s["offset"].alias("offset"), s["snippet"].alias("snippet")))
    return F.when(F.size(snippets) > 0, own).otherwise(F.array(F.struct(F.lit(0).alias("offset"), corpus.alias("snippet"))))


def _near_amounts(snippets: Column, amount: str, radius: int = 220) -> Column:
    """Band match in a row: each amount within `radius` of each price keyword; (start, end, raw, distance), offsets in the corpus."""

    def around(s: Column, k: Column) -> Column:
        left = F.greatest(F.lit(0), k["start"] - radius)
        right = F.least(F.length(s["snippet"]), k["end"] + radius)
        found = find_all(F.substring(s["snippet"], left + 1, right - left), amount)
        return F.transform(
            found,
            lambda a: F.struct((s["offset"] + left + a["start"]).alias("start"), (s["offset"] + left + a["end"]).alias("end"), a["match"].alias("raw"), F.abs(left + a["start"] - k["start"]).alias("distance")),
        )

    return F.flatten(F.transform(snippets, lambda s: F.flatten(F.transform(find_all(s["snippet"], R.NMCK_KEYWORD), lambda k: around(s, k)))))


def _quoted(amounts: Column, corpus: Column, radius: int, mark: str) -> Column:
    """Each amount with its value, its quote, and what the scores look at."""

    def read(a: Column) -> Column:
        quote = clip(corpus, a["start"], a["end"], radius, 300, mark)
        return let(quote, lambda q: F.struct(a["start"].alias("start"), a["raw"].alias("raw"), a["distance"].alias("distance"), parse_money(a["raw"]).alias("value"), q.alias("quote"), F.lower(q).alias("low"), q.rlike(R.NMCK_STRONG).alias("strong")))

    return F.transform(amounts, read)


def price_basic(corpus: Column, snippets: Column, files: Column) -> Column:
    """Of equal values (to the kopeck) of a file the surest, eight at most; the fields are in the order of G1. `files` are the blocks of the corpus."""

    def score(a: Column) -> Column:
        quote, low, strong, value = a["quote"], a["low"], a["strong"], a["value"]
        confidence = (
            F.lit(0.35)
            + F.lit(0.3) * (F.lit(1.0) - F.least(a["distance"], F.lit(220)) / F.lit(220.0))
            + _bonus(strong, 0.25)
            + _bonus(F.contains(low, F.lit("руб")) | F.contains(quote, F.lit("₽")), 0.08)
            + _bonus(quote.rlike(R.SECURITY_WORD) & ~strong, -0.25)
            + _bonus(F.contains(low, F.lit("цена")), 0.05)
            + _bonus(~value.between(1e3, 1e11), -0.2)
        )
        return F.struct((-_clamped(confidence)).alias("rank"), _json_number(value).alias("json"), a["start"].alias("offset"), value.alias("value"), a["raw"].alias("raw"), quote.alias("quote"), block_file(files, a["start"]).alias("file"))

    found = F.filter(F.transform(_quoted(_near_amounts(_spaces(corpus, snippets), R.AMOUNT), corpus, 170, "…"), score), lambda c: c["value"].isNotNull())
    return _listed(found, lambda c: [c["rank"]], lambda c: F.struct(F.round(c["value"], 2), F.coalesce(c["file"], F.lit(""))), MOST_BASIC)


def price_ranked(corpus: Column, snippets: Column) -> Column:
    """C6, sorted, deduped and cut by C10."""

    def score(a: Column, nth: Column) -> Column:
        quote, low, strong, value = a["quote"], a["low"], a["strong"], a["value"]
        confidence = (
            F.lit(0.45)
            + F.lit(0.25) * (F.lit(1.0) - F.least(a["distance"], F.lit(220)) / F.lit(220.0))
            + _bonus(strong, 0.22)
            + _bonus(F.contains(low, F.lit("руб")) | F.contains(quote, F.lit("₽")), 0.05)
            + _bonus(any_of(low, R.NMCK_EXCLUSIONS) & ~strong, -0.35)
            + _bonus(~value.between(1e3, 1e11), -0.2)
        )
        return F.struct((-_clamped(confidence)).alias("rank"), a["start"].alias("offset"), F.concat(F.lit("nmck_"), (nth + 1).cast("string")).alias("id"), value.alias("value"), a["raw"].alias("raw"), quote.alias("quote"))

    return _ranked(F.filter(F.transform(_quoted(_near_amounts(snippets, R.AMOUNT_RANKED), corpus, 150, ""), score), lambda c: c["value"].isNotNull()))


def price_evidence(snippets: Column) -> Column:
    """C11: numbers on a line with a price keyword and on the two lines after it; the twelve first by confidence, offset and id."""

    def of_snippet(s: Column) -> Column:
        seen = F.struct(F.split(s["snippet"], "\n", -1).alias("rows"), _hits(F.lower(s["snippet"]), R.NMCK_EXCLUSIONS).alias("excluded"))
        return let(seen, lambda x: of_rows(s, x["rows"], x["excluded"]))

    def of_rows(s: Column, rows: Column, excluded: Column) -> Column:
        def of_line(low: Column, i: Column) -> Column:
            zone = F.array_join(F.slice(rows, i + 1, 3), "\n")
            anchors = _hits(low, R.NMCK_ANCHORS_EVIDENCE)
            others = _hits(low, R.NMCK_KEYWORDS_EVIDENCE) - anchors
            confidence = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(0.45) + anchors * F.lit(0.28) + others * F.lit(0.04) - excluded * F.lit(0.2)))
            before = F.coalesce(F.aggregate(F.slice(rows, 1, i), F.lit(0), lambda n, x: n + F.length(x) + 1), F.lit(0))
            amounts = lambda z: F.regexp_extract_all(z["zone"], F.lit(R.AMOUNT_EVIDENCE), F.lit(0))
            read = lambda z: F.transform(amounts(z), lambda raw: F.struct(z["rank"].alias("rank"), z["offset"].alias("offset"), raw.alias("raw"), parse_money_grouped(raw).cast("double").alias("value"), z["zone"].alias("quote")))
            made = let(F.struct(zone.alias("zone"), F.round(-confidence, 6).alias("rank"), (s["offset"] + before).alias("offset")), read)
            return F.when(any_of(low, R.NMCK_KEYWORDS_EVIDENCE), made).otherwise(F.array().cast("array<struct<rank:double,offset:int,raw:string,value:double,quote:string>>"))

        return F.flatten(F.transform(rows, lambda line, i: let(F.lower(line), lambda low: of_line(low, i))))

    every = F.flatten(F.transform(snippets, of_snippet))
    named = F.transform(every, lambda c, i: F.struct(c["rank"].alias("rank"), c["offset"].alias("offset"), F.concat(F.lit("nmck_"), (i + 1).cast("string")).alias("id"), c["value"].alias("value"), c["raw"].alias("raw"), c["quote"].alias("quote")))
    return F.slice(F.array_sort(named), 1, MOST_EVIDENCE)


def payment_basic(corpus: Column, snippets: Column) -> Column:
    """One candidate a snippet, with the longest term of all found."""

    def mine(s: Column) -> Column:
        text = s["snippet"]
        return let(
            F.struct(
                F.lower(text).alias("low"), _percent_at(text, R.ADVANCE_PERCENT).alias("advance"), _percent_at(text, R.FINAL_PERCENT).alias("final"), let(first_days(text, R.ADVANCE_DAYS), calendar_days).alias("advance_days"),
                first_days(text, R.FINAL_DAYS).alias("end"), text.rlike(R.PAY_AFTER_FULL).alias("after_full"), F.concat(_all_days(text, R.PAY_DAYS), _all_days(text, R.PAY_DAYS_ALT)).alias("terms"),
            ),
            lambda x: judge(s, x["low"], x),
        )

    def judge(s: Column, low: Column, x: Column) -> Column:
        advance, final, advance_days, end, after_full = x["advance"], x["final"], x["advance_days"], x["end"], x["after_full"]
        working = F.when(end["type"] == "working", end["days"])
        calendar = F.when(F.coalesce(end["type"], F.lit("")) != "working", end["days"])
        days = F.array_max(F.concat(F.array(to_calendar(working), calendar), x["terms"]))
        signals = _count(advance.isNotNull(), final.isNotNull(), advance_days.isNotNull(), working.isNotNull(), calendar.isNotNull(), days.isNotNull(), after_full)
        confidence = F.lit(0.2) + signals * F.lit(0.1) + _bonus(any_of(low, R.PAYMENT_KEYWORDS), 0.18) + _bonus(F.contains(low, F.lit("в течение")), 0.08) + _bonus((advance + final).between(70, 110), 0.07)
        null = F.lit("null")
        json = F.concat_ws(
            ",", F.coalesce(advance_days.cast("string"), null), F.coalesce(_json_number(advance), null), F.coalesce(calendar.cast("string"), null), F.coalesce(working.cast("string"), null), F.coalesce(_json_number(final), null), after_full.cast("string"), F.coalesce(days.cast("string"), null)
        )
        return F.struct(
            (-_clamped(confidence)).alias("rank"), json.alias("json"), s["offset"].alias("offset"), signals.alias("signals"), advance.alias("advance_percent"), final.alias("final_percent"), advance_days.alias("advance_days"), working.alias("final_working"), calendar.alias("final_calendar"), days.alias("days"), after_full.alias("after_full")
        )

    return F.filter(F.transform(_spaces(corpus, snippets), mine), lambda c: (c["signals"] > 0) & F.coalesce(c["days"].between(1, 3650), F.lit(True)))


def payment_ranked(snippets: Column) -> Column:
    """C7."""

    def mine(s: Column, nth: Column) -> Column:
        text = s["snippet"]
        return let(
            F.struct(
                F.lower(text).alias("low"), _percent_at(text, R.ADVANCE_PERCENT_RANKED).alias("advance"), _percent_at(text, R.FINAL_PERCENT_RANKED).alias("final"), let(first_days(text, R.ADVANCE_DAYS_RANKED), calendar_days).alias("advance_days"),
                first_days(text, R.FINAL_DAYS_RANKED).alias("end"), text.rlike(R.AFTER_ACCEPTANCE).alias("accepted"), _all_days(text, R.CONTEXT_DAYS_RANKED).alias("terms"),
            ),
            lambda x: judge(s, nth, x["low"], x),
        )

    def judge(s: Column, nth: Column, low: Column, x: Column) -> Column:
        advance, final, advance_days, end, accepted = x["advance"], x["final"], x["advance_days"], x["end"], x["accepted"]
        working = F.when(end["type"] == "working", end["days"])
        calendar = F.when(F.coalesce(end["type"], F.lit("")) != "working", end["days"])
        days = F.array_max(F.concat(F.array(advance_days, to_calendar(working), calendar), x["terms"]))
        signals = _count(advance.isNotNull(), advance_days.isNotNull(), final.isNotNull(), working.isNotNull(), calendar.isNotNull(), days.isNotNull())
        confidence = F.lit(0.22) + signals * F.lit(0.09) + _bonus(any_of(low, R.PAYMENT_KEYWORDS_RANKED), 0.16) + _bonus(accepted, 0.08) + _bonus((advance + final).between(85, 110), 0.08)
        return F.struct((-_clamped(confidence)).alias("rank"), s["offset"].alias("offset"), F.concat(F.lit("payment_terms_"), (nth + 1).cast("string")).alias("id"), (signals + accepted.cast("int")).alias("signals"), advance.alias("advance_percent"), final.alias("final_percent"), advance_days.alias("advance_days"), days.alias("days"))

    return F.filter(F.transform(snippets, mine), lambda c: c["signals"] > 0)


def payment_evidence(snippets: Column) -> Column:
    """Up to three candidates a snippet: no advance, an advance, a term."""

    def mine(s: Column) -> Column:
        return let(F.struct(F.lower(s["snippet"]).alias("low"), first_days(s["snippet"], R.PAY_DAYS_EVIDENCE).alias("explicit")), lambda x: told(s["snippet"], s, x["low"], x["explicit"]))

    def told(text: Column, s: Column, low: Column, explicit: Column) -> Column:
        loose = first_days(text, r"(?iuU)(\d{1,4})\s*(рабоч\w*|календар\w*)?\s*дн(?:я|ей|ь)?")
        strict = explicit["days"].isNotNull()
        return let(F.when(strict, explicit).when(any_of(low, ["оплат", "расчет", "платеж"]), loose), lambda pair: judge(text, s, low, strict, pair))

    def judge(text: Column, s: Column, low: Column, strict: Column, pair: Column) -> Column:
        denied = low.rlike(R.NO_ADVANCE)
        percent = F.replace(some(F.regexp_extract(text, r"(?iuU)(\d{1,3}(?:[.,]\d+)?)\s*(?:%|процент\w*)", 1)), F.lit(","), F.lit(".")).try_cast("double")
        given = low.rlike(r"(?iuU)\bаванс\w*\b") & ~low.rlike(r"(?iuU)не\s+предусмотрен")
        trigger = F.coalesce(*[F.when(any_of(low, words), name) for name, words in R.PAY_TRIGGERS.items()], F.lit("after_acceptance"))
        shape = "struct<rank:double,offset:int,allowed:boolean,advance_percent:double,days:int,type:string,trigger:string,quote:string>"
        start = starts_of(text, R.PAY_DAYS_EVIDENCE)
        one = lambda rank, offset, allowed, advance, days, kind, why, quote: F.struct(F.lit(rank) if isinstance(rank, float) else rank, offset, allowed, advance, days, kind, why, quote).cast(shape)
        none = F.lit(None)
        return F.array_compact(
            F.array(
                F.when(denied, one(-0.96, s["offset"], F.lit(False), none, none, none, none, text)),
                F.when(given, one(-0.58, s["offset"], F.lit(True), percent, none, none, none, text)),
                F.when(pair["days"].isNotNull(), one(F.when(strict, -0.9).otherwise(-0.72), s["offset"] + F.when(strict, start).otherwise(0), none, none, pair["days"], pair["type"], trigger, F.when(strict, F.regexp_extract(text, R.PAY_DAYS_EVIDENCE, 0)).otherwise(text))),
            )
        )

    every = F.flatten(F.transform(snippets, mine))
    return F.transform(every, lambda c, i: F.struct(c["rank"].alias("rank"), c["offset"].alias("offset"), F.concat(F.lit("payment_terms_"), (i + 1).cast("string")).alias("id"), c["allowed"].alias("allowed"), c["advance_percent"].alias("advance_percent"), c["days"].alias("days"), c["type"].alias("type"), c["trigger"].alias("trigger"), c["quote"].alias("quote")))


def _days_found(snippet: Column, offset: Column, pattern: str, plain: float, calendar: float = 0.0) -> Column:
    def read(m: Column) -> Column:
        bonus = _bonus(F.contains(F.lower(F.regexp_extract(m["match"], pattern, 2)), F.lit(_CALENDAR)), calendar) if calendar else F.lit(0.0)
        return F.struct((offset + m["start"]).alias("start"), (offset + m["end"]).alias("end"), let(days_of_match(m["match"], pattern), calendar_days).alias("days"), (F.lit(plain) + bonus).alias("score"))

    return F.transform(find_all(snippet, pattern), read)


def _ranges_found(snippet: Column, offset: Column, plain: float) -> Column:
    return F.transform(find_all(snippet, R.DATE_RANGE), lambda m: F.struct((offset + m["start"]).alias("start"), (offset + m["end"]).alias("end"), parse_date_range(m["match"]).alias("days"), F.lit(plain).alias("score")))


def execution_basic(corpus: Column, snippets: Column) -> Column:
    """The eight surest, then of most keywords, then shortest; the fields are in the order of G1."""
    found = F.flatten(F.transform(_spaces(corpus, snippets), lambda s: F.concat(_days_found(s["snippet"], s["offset"], R.EXEC_DAYS, 0.35, 0.1), _days_found(s["snippet"], s["offset"], R.EXEC_DAYS_ALT, 0.28), _ranges_found(s["snippet"], s["offset"], 0.3))))

    def score(d: Column) -> Column:
        return let(clip(corpus, d["start"], d["end"], 170, 300, "…"), lambda quote: judge(d, quote, F.lower(quote)))

    def judge(d: Column, quote: Column, low: Column) -> Column:
        confidence = d["score"] + _bonus(any_of(low, R.EXECUTION_KEYWORDS), 0.22) + _bonus(F.contains(low, F.lit("срок")), 0.1)
        return F.struct((-_clamped(confidence)).alias("rank"), d["days"].cast("string").alias("json"), d["start"].alias("offset"), d["days"].alias("value"), quote.alias("quote"))

    kept = F.filter(F.transform(found, score), lambda c: c["value"].between(1, 5000))
    order = lambda c: F.struct(c["rank"], -_hits(F.lower(c["quote"]), R.EXECUTION_KEYWORDS), c["value"])
    ordered = F.array_sort(F.transform(kept, lambda c, nth: F.struct(order(c).alias("order"), nth.alias("nth"), c.alias("c"))))
    return F.transform(F.slice(ordered, 1, MOST_BASIC), lambda x: x["c"])


def execution_ranked(corpus: Column, snippets: Column) -> Column:
    """C8, sorted, deduped and cut by C10."""
    found = F.flatten(F.transform(snippets, lambda s: F.concat(_days_found(s["snippet"], s["offset"], R.EXEC_DAYS_RANKED, 0.45), _ranges_found(s["snippet"], s["offset"], 0.38))))
    kept = F.filter(found, lambda d: d["days"].between(1, 5000))

    def score(d: Column, nth: Column) -> Column:
        return let(clip(corpus, d["start"], d["end"], 150, 300, ""), lambda quote: judge(d, nth, quote))

    def judge(d: Column, nth: Column, quote: Column) -> Column:
        confidence = d["score"] + _bonus(any_of(F.lower(quote), R.EXECUTION_KEYWORDS_RANKED), 0.22)
        return F.struct((-_clamped(confidence)).alias("rank"), d["start"].alias("offset"), F.concat(F.lit("execution_"), (nth + 1).cast("string")).alias("id"), d["days"].alias("value"), quote.alias("quote"))

    return _ranked(F.transform(kept, score))


def execution_evidence(snippets: Column) -> Column:
    """An explicit term, else any days near the words; and the span of all dates."""

    def mine(s: Column) -> Column:
        dates = F.transform(F.regexp_extract_all(s["snippet"], F.lit(r"(?U)\b(\d{2}\.\d{2}\.\d{4})\b"), F.lit(1)), parse_date)
        return let(F.struct(first_days(s["snippet"], R.EXEC_DAYS_EVIDENCE).alias("explicit"), dates.alias("dates")), lambda x: told(s["snippet"], s, x["explicit"], x["dates"]))

    def told(text: Column, s: Column, explicit: Column, dates: Column) -> Column:
        loose = first_days(text, r"(?iuU)(\d{1,4})\s*(рабоч\w*|календар\w*)?\s*дн(?:я|ей|ь)?")
        strict = explicit["days"].isNotNull()
        return let(F.when(strict, explicit).when(any_of(F.lower(text), ["срок", "поставк", "исполн", "оказани"]), loose), lambda pair: judge(text, s, strict, pair, dates))

    def judge(text: Column, s: Column, strict: Column, pair: Column, dates: Column) -> Column:
        span = F.datediff(F.array_max(dates), F.array_min(dates))
        start = starts_of(text, R.EXEC_DAYS_EVIDENCE)
        shape = "struct<rank:double,offset:int,days:int,type:string,quote:string>"
        return F.array_compact(
            F.array(
                F.when(pair["days"].isNotNull(), F.struct(F.when(strict, -0.9).otherwise(-0.65), s["offset"] + F.when(strict, start).otherwise(0), pair["days"], pair["type"], F.when(strict, F.regexp_extract(text, R.EXEC_DAYS_EVIDENCE, 0)).otherwise(text)).cast(shape)),
                F.when((F.size(dates) >= 2) & (span > 0), F.struct(F.lit(-0.63), s["offset"], span, F.lit("date_range"), text).cast(shape)),
            )
        )

    every = F.flatten(F.transform(snippets, mine))
    return F.transform(every, lambda c, i: F.struct(c["rank"].alias("rank"), c["offset"].alias("offset"), F.concat(F.lit("execution_days_"), (i + 1).cast("string")).alias("id"), c["days"].alias("value"), c["type"].alias("type"), c["quote"].alias("quote")))


def penalty_basic(corpus: Column, snippets: Column) -> Column:
    """C4."""

    def mine(s: Column) -> Column:
        text = s["snippet"]

        def fine_at(first: Column) -> Column:
            # A fine whose surroundings speak of days is no fine.
            left = F.greatest(F.lit(0), first["start"] - 20)
            near = F.lower(F.substring(text, left + 1, first["end"] + 20 - left))
            return F.when(~any_of(near, ["день", "дня", "сутк", "ежеднев"]), parse_percent(first["match"]))

        per_day = F.coalesce(_percent_at(text, R.PENALTY_PER_DAY), _percent_at(text, R.PENALTY_PER_DAY_ALT))
        fine = let(F.try_element_at(find_all(text, R.FINE), F.lit(1)), fine_at)
        return let(F.struct(per_day.alias("per_day"), _percent_at(text, R.PENALTY_CAP).alias("cap"), fine.alias("fine")), lambda x: judge(s, text, x))

    def judge(s: Column, text: Column, x: Column) -> Column:
        per_day, cap, fine = x["per_day"], x["cap"], x["fine"]
        confidence = F.lit(0.25) + _bonus(per_day.isNotNull(), 0.32) + _bonus(cap.isNotNull(), 0.12) + _bonus(fine.isNotNull(), 0.14) + _bonus(any_of(F.lower(text), R.PENALTY_KEYWORDS), 0.12)
        json = F.concat_ws(",", *[F.coalesce(_json_number(v), F.lit("null")) for v in (fine, cap, per_day)])
        return F.struct((-_clamped(confidence)).alias("rank"), json.alias("json"), s["offset"].alias("offset"), per_day.alias("per_day"), cap.alias("cap"), fine.alias("fine"))

    sane = lambda v, most: F.coalesce(v.between(0, most), F.lit(True))
    return F.filter(F.transform(_spaces(corpus, snippets), mine), lambda c: F.coalesce(c["per_day"], c["cap"], c["fine"]).isNotNull() & sane(c["per_day"], 10) & sane(c["fine"], 100))


def penalty_ranked(snippets: Column) -> Column:
    """C9."""

    def mine(s: Column, nth: Column) -> Column:
        text = s["snippet"]
        per_day, cap = _percent_at(text, R.PENALTY_PER_DAY_RANKED), _percent_at(text, R.CAP_RANKED)
        said = F.regexp_extract(text, R.FINE_PERCENT_RANKED, 0)
        fine = F.when(~any_of(F.lower(said), ["в день", "ежеднев", "сутк"]), parse_percent(some(said)))
        fixed = parse_money(some(F.regexp_extract(text, R.FINE_AMOUNT_RANKED, 1)))
        found = F.struct(per_day.alias("per_day"), cap.alias("cap"), fine.alias("fine"), fixed.alias("fixed"))
        return let(found, lambda x: judge(s, nth, text, x))

    def judge(s: Column, nth: Column, text: Column, x: Column) -> Column:
        per_day, cap, fine, fixed = x["per_day"], x["cap"], x["fine"], x["fixed"]
        confidence = (
            F.lit(0.28) + _bonus(per_day.isNotNull(), 0.28) + _bonus(cap.isNotNull(), 0.12) + _bonus(fine.isNotNull(), 0.12) + _bonus(fixed.isNotNull(), 0.08) + _bonus(any_of(F.lower(text), R.PENALTY_KEYWORDS), 0.1)
        )
        return F.struct((-_clamped(confidence)).alias("rank"), s["offset"].alias("offset"), F.concat(F.lit("penalties_"), (nth + 1).cast("string")).alias("id"), per_day.alias("per_day"), cap.alias("cap"), fine.alias("fine"), fixed.alias("fixed"))

    return F.filter(F.transform(snippets, mine), lambda c: F.coalesce(c["per_day"], c["cap"], c["fine"], c["fixed"]).isNotNull())


def penalty_evidence(snippets: Column) -> Column:
    """C14: fraction of the key rate, fine with bounds, reference to the decree."""

    def mine(s: Column, nth: Column) -> Column:
        text = s["snippet"]
        fraction = key_rate_fraction(text, R.KEY_RATE_FRACTION)
        named = text.rlike("(?iuU)штраф")
        percent = F.when(named, F.replace(some(F.regexp_extract(text, r"(?iuU)(\d{1,3}(?:[.,]\d+)?)\s*(?:%|процент\w*)", 1)), F.lit(","), F.lit(".")).try_cast("double"))
        bound = lambda words: F.when(named, parse_money_grouped(some(F.regexp_extract(text, rf"(?iuU)не\s+{words}\s+([0-9\s  .,]+)", 1))).cast("double"))
        found = F.struct(fraction.alias("fraction"), percent.alias("percent"), bound("менее").alias("least"), bound("более").alias("most"))
        return let(found, lambda x: judge(s, nth, text, x))

    def judge(s: Column, nth: Column, text: Column, x: Column) -> Column:
        fraction, percent, least, most = x["fraction"], x["percent"], x["least"], x["most"]
        decree = F.contains(text, F.lit("1042"))
        fined = F.coalesce(percent, least, most).isNotNull()
        confidence = F.lit(0.62) + _bonus(fraction.isNotNull(), 0.2) + _bonus(fined, 0.12) + _bonus(decree, 0.05)
        return F.struct(
            F.round(-confidence, 6).alias("rank"), s["offset"].alias("offset"), F.concat(F.lit("penalties_"), (nth + 1).cast("string")).alias("id"), fraction["denominator"].alias("denominator"), percent.alias("fine"), least.alias("fine_min"), most.alias("fine_max"), F.when(decree, "1042").alias("decree"), (fraction.isNotNull() | fined | decree).alias("found"), text.alias("quote")
        )

    return F.filter(F.transform(snippets, mine), lambda c: c["found"])


best = _best
