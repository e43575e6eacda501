"""Risk (F1), money (F2-F6) and danger phrases (DP1), as conditional arithmetic over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bidlens.functions.numbers import format_rub, percent_amount
from bidlens.functions.text import find_all, strip
from bidlens.rules import DANGER_RULES

_CONTEXT_CODES = ("partial_input", "not_provided_in_text", "absent_in_docs")


def _rule(*cases: tuple[Column, int, Column | str]) -> tuple[Column, Column]:
    """Points and reason of the first case that holds."""
    points, reason = F.lit(0), F.lit(None).cast("string")
    for condition, value, text in reversed(cases):
        points = F.when(condition, value).otherwise(points)
        reason = F.when(condition, F.lit(text) if isinstance(text, str) else text).otherwise(reason)
    return points, reason


def _number(value: Column) -> Column:
    """A percent as the texts print it: at least one decimal."""
    return F.when(value == F.floor(value), F.concat(value.cast("long").cast("string"), F.lit(".0"))).otherwise(F.regexp_replace(F.format_string("%.4f", value), "0+$", ""))


def risk(c: dict[str, Column]) -> dict[str, Column]:
    """F1: risk_score 0..10, risk_level, reasons in order.

    Keys of c: nmck, payment_terms_days, execution_days, penalty, advance, bid_security, contract_security
    (numbers or null), payment_reason, penalty_reason (missing codes or null), vague, pay_after_full,
    by_requests, hold_stock (booleans).
    """
    say = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    flag = lambda name: F.coalesce(c[name], F.lit(False))
    whole = lambda name: c[name].cast("long").cast("string")
    always = F.lit(True)
    bid, contract = percent_amount(c["nmck"], c["bid_security"]), percent_amount(c["nmck"], c["contract_security"])
    about = lambda amount: F.when(amount.isNotNull(), say(" (~", format_rub(amount), ")")).otherwise("")
    known = c["execution_days"].isNotNull() & c["nmck"].isNotNull()
    frozen = F.array_compact(F.array(F.when(bid.isNotNull(), say("обеспечение заявки ~ ", format_rub(bid))), F.when(contract.isNotNull(), say("обеспечение контракта ~ ", format_rub(contract)))))
    rules = [
        _rule((c["nmck"].isNull(), 1, "Не удалось извлечь НМЦК — возможна неполнота данных/нестандартный документ.")),
        _rule(
            (c["payment_terms_days"] >= 60, 2, say("Долгий срок оплаты: ", whole("payment_terms_days"), " дней — высокий риск кассового разрыва.")),
            (c["payment_terms_days"] >= 30, 1, say("Срок оплаты: ", whole("payment_terms_days"), " дней — возможен кассовый разрыв.")),
            (c["payment_terms_days"].isNotNull(), 0, F.lit(None).cast("string")),
            (c["payment_reason"].isin(*_CONTEXT_CODES), 1, "Недостаточно контекста: условия оплаты не обнаружены в текущем наборе документов (возможно в приложениях)."),
            (c["payment_reason"] == "parse_failed", 2, "Раздел оплаты найден, но срок не распознан — требуется проверка."),
            (always, 1, "Не найден срок оплаты — риск неопределенности по кэшу."),
        ),
        _rule(
            (known & (c["execution_days"] <= 30) & (c["nmck"] >= 10_000_000), 2, say("Короткий срок исполнения (", whole("execution_days"), " дней) при НМЦК ≥ 10 млн — риск срыва сроков.")),
            (known & (c["execution_days"] <= 20), 1, say("Очень короткий срок исполнения: ", whole("execution_days"), " дней.")),
            (~known, 1, "Не найден срок исполнения — риск неверной оценки нагрузки."),
        ),
        _rule(
            (c["penalty"] >= 0.2, 2, say("Высокая пеня: ", _number(c["penalty"]), "%/день — штрафной риск.")),
            (c["penalty"] >= 0.1, 1, say("Пеня: ", _number(c["penalty"]), "%/день — заметный штрафной риск.")),
            (c["penalty"].isNotNull(), 0, F.lit(None).cast("string")),
            (c["penalty_reason"].isin(*_CONTEXT_CODES), 0, "Недостаточно контекста: условия по пеням/штрафам не обнаружены в текущем наборе документов (возможно в приложениях)."),
            (c["penalty_reason"] == "parse_failed", 1, "Раздел ответственности найден, но пеня/штраф не распознаны — требуется проверка."),
            (always, 0, "Пеня/штрафы не извлечены — проверь вручную (экстрактор мог не распознать формулировку)."),
        ),
        _rule((c["advance"] == 0, 1, "Аванс отсутствует — увеличивает кассовую нагрузку."), (c["advance"] >= 30, -1, say("Высокий аванс: ", _number(c["advance"]), "% — снижает кассовый риск."))),
        _rule((c["contract_security"] >= 10, 1, say("Высокое обеспечение контракта: ", _number(c["contract_security"]), "%", about(contract), " — нагрузка на финансы/гарантии."))),
        _rule((c["bid_security"] >= 5, 1, say("Высокое обеспечение заявки: ", _number(c["bid_security"]), "%", about(bid), " — финансовая нагрузка."))),
        _rule((flag("vague"), 2, "Есть признаки размытых условий приемки/оснований отказа — риск конфликтов и задержек оплаты.")),
        _rule((flag("pay_after_full"), 2, "Оплата только после полной поставки — риск длительного кассового разрыва и зависания оборотки.")),
        _rule((flag("by_requests"), 2, "Поставка партиями/по заявкам заказчика — риск растягивания сроков и заморозки товара/денег.")),
        _rule((flag("hold_stock"), 1, "Требование держать товар на складе поставщика — заморозка оборотных средств и риск срыва сроков.")),
        _rule((flag("pay_after_full") & flag("by_requests"), 1, "Комбо-капкан: оплата после полной поставки + поставка по заявкам — высокий риск долгой заморозки оборотки.")),
        _rule(
            (
                F.size(frozen) > 0,
                0,
                say(
                    "Оценка заморозки оборотных средств: ",
                    F.array_join(frozen, "; "),
                    ".",
                    F.when(c["advance"] == 0, " Аванса нет — потребуется больше оборотки.").otherwise(""),
                    F.when(flag("pay_after_full") | flag("by_requests"), " Условия оплаты/поставки могут дополнительно растянуть возврат денег.").otherwise(""),
                ),
            )
        ),
    ]
    total = F.lit(0)
    for points, _ in rules:
        total = total + points
    score = F.greatest(F.lit(0), F.least(F.lit(10), total))
    return {"risk_score": score, "risk_level": level(score), "reasons": F.array_compact(F.array(*[reason for _, reason in rules]))}


def level(score: Column) -> Column:
    return F.when(score <= 3, "Низкий").when(score <= 6, "Средний").otherwise("Высокий")


def financials(nmck: Column, cost: Column, margin: Column, payment_days: Column, execution_days: Column) -> tuple[Column, Column]:
    """expected return in percent and cash gap; (0, null) without a positive price and cost."""
    valid = (nmck > 0) & (cost > 0)
    profit = cost * (F.coalesce(margin, F.lit(0.0)) / F.lit(100.0))
    roi = F.when(valid, profit / cost * F.lit(100.0)).otherwise(F.lit(0.0))
    gap = F.when(valid & (execution_days > 0) & (payment_days >= 0), F.try_divide(cost, execution_days) * payment_days)
    return roi, gap


def safe_cost(nmck: Column, roi: Column) -> Column:
    """F3."""
    denominator = F.lit(1.0) + roi / F.lit(100.0)
    return F.when((nmck > 0) & (denominator > 0), F.round(F.try_divide(nmck, denominator), 2))


def verdict(nmck: Column, allowed: Column, is_partial: Column, score: Column) -> Column:
    """F4 and F5."""
    return (
        F.when(~F.coalesce(nmck > 0, F.lit(False)) & ~allowed, "Недостаточно данных для финансовой оценки")
        .when(is_partial, "Требуется проверка")
        .when(score >= 7, "Не рекомендуется участвовать")
        .when(score >= 4, "Участвовать с осторожностью")
        .otherwise("Можно участвовать")
    )


def danger_phrases(text: Column) -> Column:
    """DP1: array of findings (nth, id, severity, title, hint, matches of (snippet, start, end)), one a rule that matched.

    Ids number all matches over all rules, and a finding has that of its first.
    """
    found = []
    before = F.lit(0)
    for pattern, severity, title, hint in DANGER_RULES:
        matches = find_all(text, pattern)
        cut = lambda m: strip(F.replace(F.substring(text, F.greatest(F.lit(0), m["start"] - 80) + 1, F.least(F.length(text), m["end"] + 120) - F.greatest(F.lit(0), m["start"] - 80)), F.lit("\n"), F.lit(" ")))
        listed = F.transform(matches, lambda m: F.struct(cut(m).alias("snippet"), m["start"].alias("start"), m["end"].alias("end")))
        one = F.struct(F.concat(F.lit("dp_"), (before + 1).cast("string")).alias("id"), F.lit(severity).alias("severity"), F.lit(title).alias("title"), F.lit(hint).alias("hint"), listed.alias("matches"))
        found.append(F.when(F.size(matches) > 0, one))
        before = before + F.size(matches)
    return F.array_compact(F.array(*found))
