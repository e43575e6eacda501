"""Keyword lists, patterns and labels of the tender analysis.

Fixed values: everything in this file belongs to the subject and must stay as it is for right results.
Patterns are in Java's dialect; with (?iuU) letters, words and case follow Unicode.
"""

# Retrieval sections, single-stage search: price, payment, execution, penalties.
SECTIONS_BASIC = {
    "price": ["нмцк", "нмц", "начальная (максимальная) цена", "цена договора", "цена контракта", "цена лота"],
    "payment": ["оплата", "расчет", "аванс", "предоплата", "окончательный расчет", "платеж"],
    "execution": ["срок поставки", "срок исполнения", "отгруз", "поставка", "партия"],
    "penalties": ["пеня", "неустойк", "штраф", "ответственность сторон"],
}
# Sections counted for completeness.
SECTIONS_COUNTED = {
    "price": SECTIONS_BASIC["price"],
    "payment": SECTIONS_BASIC["payment"],
    "execution": SECTIONS_BASIC["execution"],
    "liability": ["ответственность", "неустойк", "пеня", "штраф"],
}
# Retrieval sections of the ranked search.
SECTIONS_RANKED = {
    "price": ["нмцк", "нмц", "начальная (максимальная) цена", "цена договора", "цена контракта", "цена лота", "по извещению"],
    "payment": ["оплата", "расчет", "аванс", "предоплата", "платеж", "окончательный расчет", "приемка", "накладная"],
    "execution": ["срок поставки", "срок исполнения", "исполнения обязательств", "отгрузка", "поставка"],
    "liability": ["ответственность", "неустойка", "пеня", "штраф"],
    "specs": ["техническое задание", "спецификация", "характеристики", "требования к товару"],
    "security": ["обеспечение заявки", "обеспечение исполнения", "банковская гарантия", "задаток"],
}
# Retrieval sections of the evidence-first search.
SECTIONS_EVIDENCE = {
    "price": ["нмцк", "нмц", "начальная (максимальная) цена", "цена контракта", "цена договора", "начальная цена", "максимальная цена"],
    "payment": ["оплата", "расчет", "расчеты", "счет", "платеж", "аванс", "предоплата", "окончательный расчет", "приемк", "документ о приемке", "подписан"],
    "execution": ["срок поставки", "срок исполнения", "срок оказания", "поставка осуществляется", "в течение", "календарн", "рабоч"],
    "liability": ["ответственность", "неустойк", "пеня", "штраф", "1/300", "ключевой ставк", "постановлен", "1042"],
}
# Retrieval sections of the scored context search, over text in lower case without ё.
SECTIONS_SCORED = {
    "price": ["нмцк", "нмц", "начальная (максимальная) цена", "цена контракта", "цена договора", "обоснование нмц", "итого"],
    "payment": ["оплата", "платеж", "расчет", "аванс", "предоплата", "счет", "документ о приемке", "приемк"],
    "liability": ["ответственность", "неустойк", "пеня", "штраф", "1/300", "ключев", "1042"],
    "execution": ["срок поставки", "срок исполнения", "поставка", "отгруз", "партия", "в течение", "календарн", "рабоч"],
}
# The scored lists name payment words with ё as well; both spellings are searched after ё becomes е, so these count twice.
SCORED_TWICE = ["платеж", "расчет", "счет"]

# Price mining: keyword, strong keyword, amounts, what speaks against a price.
NMCK_KEYWORDS = ["нмцк", "нмц", "начальная (максимальная) цена", "цена договора", "цена контракта", "цена лота", "по извещению"]
NMCK_KEYWORD = r"(?iuU)(?:нмцк|нмц\b|начальн\w*\s*\(максимальн\w*\)\s*цена|цена\s+(?:договора|контракта|лота)|по\s+извещению)"
NMCK_STRONG = r"(?iuU)(?:нмцк|начальн\w*\s*\(максимальн\w*\)\s*цена)"
AMOUNT = r"\d[\d\s\u00A0\u202F]{0,24}(?:[.,]\d{1,2})?"
SECURITY_WORD = r"(?iuU)(?:обеспечени|гаранти|задаток)"
NMCK_EXCLUSIONS = ["обеспечение", "банковская гарантия", "задаток", "штраф", "пеня"]
NMCK_ANCHORS_EVIDENCE = ["начальная (максимальная) цена контракта", "нмцк"]
NMCK_KEYWORDS_EVIDENCE = [*NMCK_ANCHORS_EVIDENCE, "цена контракта", "цена договора", "начальная цена", "максимальная цена"]
AMOUNT_EVIDENCE = r"(?<!\d)(?:\d{1,3}(?:[ \u00A0\u202F]\d{3})+(?:[.,]\d{1,2})?|\d+(?:[.,]\d{1,2})?)(?!\d)"

# Payment mining.
PAYMENT_KEYWORDS = ["оплата", "расчет", "аванс", "предоплата", "окончательный", "платеж"]
PAY_AFTER_FULL = r"(?iuU)(?:после\s+полной\s+поставки|после\s+поставки\s+всего\s+объема|после\s+полного\s+исполнения)"
PAY_DAYS = r"(?iuU)в\s+течение\s+(\d{1,3})\s*(рабоч\w*|календарн\w*)?\s*(?:дн\w*|день|дня|дней)"
PAY_DAYS_ALT = r"(?iuU)(?:оплат\w*|расчет\w*|платеж\w*)[^\n]{0,100}?(\d{1,3})\s*(рабоч\w*|календарн\w*)?\s*(?:дн\w*|день|дня|дней)"
ADVANCE_PERCENT = r"(?iuU)(?:аванс|предоплат\w*)[^\n%]{0,80}?(\d+(?:[.,]\d+)?)\s*%"
FINAL_PERCENT = r"(?iuU)(?:окончательн\w*\s+(?:расчет|оплат\w*)|окончательн\w*)[^\n%]{0,120}?(\d+(?:[.,]\d+)?)\s*%"
ADVANCE_DAYS = r"(?iuU)(?:аванс|предоплат\w*)[^\n]{0,120}?(\d{1,3})\s*(рабоч\w*|календарн\w*)?\s*(?:дн\w*|день|дня|дней)"
FINAL_DAYS = r"(?iuU)(?:окончательн\w*\s+(?:расчет|оплат\w*)|окончательн\w*)[^\n]{0,140}?(\d{1,3})\s*(рабоч\w*|календарн\w*)?\s*(?:дн\w*|день|дня|дней)"
PAY_DAYS_EVIDENCE = r"(?iuU)(?:оплат\w*|расчет\w*|расчеты|платеж\w*)[^.\n]{0,180}?(?:в\s+течение|не\s+позднее)\s+(\d{1,4})\s*(рабоч\w*|календар\w*)?\s*дн"
PAY_TRIGGERS = {"after_acceptance": ["приемк", "документ о приемке", "подписан"], "after_invoice": ["счет", "счета", "счет-фактур", "invoice"], "after_delivery": ["поставк", "доставк", "отгрузк"]}
NO_ADVANCE = r"(?iuU)аванс\w*\s+не\s+предусмотрен"

# Execution mining.
EXECUTION_KEYWORDS = ["срок", "поставка", "исполнения", "отгруз", "партия"]
EXEC_DAYS = r"(?iuU)(?:срок\s+(?:поставки|исполнения)|поставка|отгруз\w*|исполнени\w*)[^\n]{0,120}?(\d{1,4})\s*(рабоч\w*|календарн\w*)?\s*(?:дн\w*|день|дня|дней)"
EXEC_DAYS_ALT = r"(?iuU)в\s+течение\s+(\d{1,4})\s*(рабоч\w*|календарн\w*)?\s*(?:дн\w*|день|дня|дней)"
DATE_RANGE = r"(?iuU)(?:с|со)\s*\d{1,2}[./-]\d{1,2}[./-]\d{2,4}\s*(?:-|–|—|по)\s*\d{1,2}[./-]\d{1,2}[./-]\d{2,4}"
EXEC_DAYS_EVIDENCE = r"(?iuU)(?:срок\s+(?:поставки|исполнения|оказания)|поставка\s+осуществляется)[^.\n]{0,120}?(\d{1,4})\s*(рабоч\w*|календар\w*)?\s*дн"

# Penalty mining.
PENALTY_KEYWORDS = ["пеня", "неустойк", "штраф", "ответственность"]
PENALTY_PER_DAY = r"(?iuU)(?:пен[яи]|неустойк\w*)[^\n%]{0,120}?(\d+(?:[.,]\d+)?)\s*%[^\n]{0,100}?(?:за\s+кажд\w+\s+д|в\s+день|ежеднев|сутк)"
PENALTY_PER_DAY_ALT = r"(?iuU)(\d+(?:[.,]\d+)?)\s*%[^\n]{0,80}?(?:пен[яи]|неустойк\w*)[^\n]{0,80}?(?:за\s+кажд\w+\s+д|в\s+день|ежеднев|сутк)"
PENALTY_PER_DAY_RANKED = r"(?iuU)(?:пен[яи]|неустойк\w*)[^\n%]{0,140}?(\d+(?:[.,]\d+)?)\s*%[^\n]{0,120}?(?:за\s+кажд\w+\s+дн\w*|в\s+день|ежеднев|сутк)"
PENALTY_CAP = r"(?iuU)не\s+более\s+(\d+(?:[.,]\d+)?)\s*%"
FINE = r"(?iuU)штраф\w*[^\n%]{0,80}?(\d+(?:[.,]\d+)?)\s*%"
KEY_RATE_FRACTION = r"(?iuU)\b(\d+)\s*/\s*(\d+)\b[^.\n]{0,120}ключев\w*\s+ставк\w*"

# Trap flags: the basic and evidence pipelines share one set, the ranked one has its own.
TRAPS_BASIC = {
    "payment_after_full_delivery": r"(?iuU)после\s+полной\s+поставки|после\s+поставки\s+всего\s+объ[её]ма|после\s+полного\s+исполнения|оплата\s+после\s+полной\s+поставки",
    "delivery_by_customer_requests": r"(?iuU)по\s+заявк(?:ам|е)\s+заказчика|поставка\s+партиями|отгрузка\s+партиями|по\s+отдельным\s+заявкам|по\s+мере\s+необходимости",
    "supplier_must_hold_stock": r"(?iuU)обязан\s+обеспечить\s+наличие\s+товара\s+на\s+складе|обязан\s+иметь\s+товар\s+на\s+складе|обеспечить\s+наличие\s+на\s+складе|наличие\s+товара\s+на\s+складе\s+поставщика",
}
TRAPS_RANKED = {
    "payment_after_full_delivery": r"(?iuU)после\s+полной\s+поставки|после\s+поставки\s+всего\s+объема|после\s+полного\s+исполнения",
    "delivery_by_customer_requests": r"(?iuU)по\s+заявк\w+\s+заказчика|поставка\s+партиями|по\s+мере\s+необходимости|отгрузка\s+партиями",
    "supplier_must_hold_stock": r"(?iuU)обязан\s+иметь\s+товар\s+на\s+складе|обеспечить\s+наличие\s+товара\s+на\s+складе",
    "has_vague_acceptance_terms": r"(?iuU)по\s+усмотрению\s+заказчика|вправе\s+отказать|на\s+усмотрение\s+заказчика",
}

# Ranked mining.
AMOUNT_RANKED = r"\d[\d\s\u00A0\u202F.,]*\d(?:[.,]\d{1,2})?"
PAYMENT_KEYWORDS_RANKED = ["оплата", "расчет", "аванс", "предоплата", "окончательный", "платеж", "приемка", "накладная"]
AFTER_ACCEPTANCE = r"(?iuU)после\s+поставк\w*|после\s+приемк\w*|после\s+подписани\w+\s+накладн\w*"
ADVANCE_PERCENT_RANKED = r"(?iuU)(?:аванс|предоплат\w*)[^\n%]{0,120}?(\d+(?:[.,]\d+)?)\s*%"
FINAL_PERCENT_RANKED = r"(?iuU)(?:окончательн\w*\s+(?:расчет|оплат\w*)|оставш\w+\s+част\w*)[^\n%]{0,120}?(\d+(?:[.,]\d+)?)\s*%"
ADVANCE_DAYS_RANKED = r"(?iuU)(?:аванс|предоплат\w*)[^\n]{0,140}?(\d{1,4})\s*(рабоч\w*|календарн\w*)?\s*(?:дн\w*|дней|день|дня)"
FINAL_DAYS_RANKED = r"(?iuU)(?:окончательн\w*\s+(?:расчет|оплат\w*)|после\s+приемк\w*|после\s+поставк\w*)[^\n]{0,160}?(\d{1,4})\s*(рабоч\w*|календарн\w*)?\s*(?:дн\w*|дней|день|дня)"
CONTEXT_DAYS_RANKED = r"(?iuU)(?:оплат\w*|расчет\w*|платеж\w*|аванс|предоплат\w*|приемк\w*|накладн\w*)[^\n]{0,110}?(\d{1,4})\s*(рабоч\w*|календарн\w*)?\s*(?:дн\w*|дней|день|дня)"
EXECUTION_KEYWORDS_RANKED = ["срок поставки", "срок исполнения", "исполнения", "поставка", "отгрузка"]
EXEC_DAYS_RANKED = r"(?iuU)(?:срок\s+(?:поставк\w*|исполнени\w*)|поставк\w*|исполнени\w*)[^\n]{0,160}?(\d{1,4})\s*(рабоч\w*|календарн\w*)?\s*(?:дн\w*|дней|день|дня)"
CAP_RANKED = r"(?iuU)(?:не\s+более|ограничива\w*\s+размером)\s+(\d+(?:[.,]\d+)?)\s*%"
FINE_PERCENT_RANKED = r"(?iuU)штраф\w*[^\n%]{0,100}?(\d+(?:[.,]\d+)?)\s*%"
FINE_AMOUNT_RANKED = r"(?iuU)штраф\w*[^\n]{0,100}?(\d[\d\s\u00A0\u202F.,]*\d(?:[.,]\d{1,2})?)"

# Danger phrases: pattern, severity, title, hint.
DANGER_RULES = [
    (r"(?iuU)\bпо\s+заявк(?:ам|е)\b", "high", "Поставка по заявкам", "Объём/график может быть неопределённым → риск заморозки оборотки."),
    (r"(?iuU)\bобъем\s+не\s+фиксирован\b|\bбез\s+фиксированного\s+объема\b", "high", "Объём не фиксирован", "Риск непредсказуемых поставок и затрат."),
    (r"(?iuU)\bоплат[аы]\s+после\s+полной\s+поставки\b", "high", "Оплата после полной поставки", "Кассовый разрыв: финансируешь поставку целиком."),
    (r"(?iuU)\bбез\s+аванса\b|\bаванс\s+не\s+предусмотрен\b|\bпредоплат[аы]\s+не\s+предусмотрен", "medium", "Нет аванса", "Повышенная потребность в оборотных средствах."),
    (r"(?iuU)\bсрок\s+оплат[ыа]\s+до\s+(?:\d{2,3})\s+(?:банковских|рабочих)\s+дн", "medium", "Длинный срок оплаты", "Длинная отсрочка оплаты увеличивает финансовую нагрузку."),
    (r"(?iuU)\bнеустойк[аи]\s+в\s+размере\s+(?:\d+(?:[.,]\d+)?)\s*%\s*(?:в\s+день|за\s+день)", "high", "Высокая неустойка", "Штрафы могут съесть маржу."),
    (r"(?iuU)\bобеспечени[ея]\s+исполнени[яе]\s+контракт[аы]\s+в\s+размере\s+(?:\d+(?:[.,]\d+)?)\s*%", "medium", "Высокое обеспечение контракта", "Заморозка средств/стоимость гарантии."),
]

# Words near which a value must stand to be proven by the text; they are sought in lower case as they are spelled here.
VALUE_WORDS = {
    "nmck": ["НМЦК", "начальн", "цена договора", "цена контракта"],
    "payment_terms_days": ["оплат", "расчет", "платеж", "аванс", "предоплат", "окончательн"],
    "execution_days": ["срок", "постав", "отгруз", "исполн", "заверш", "оказан"],
    "penalty_percent_per_day": ["пеня", "неустойк", "штраф"],
}

# Plans and their monthly limits.
PLAN_LIMITS = {"free": 30, "pro": 500, "business": 5000}
DEFAULT_LIMIT = 30

# Document roles: anchors in the text, and what the file name says.
ROLE_ANCHORS = {
    "contract": ["предмет контракта", "порядок оплаты", "оплата", "платеж", "платёж", "расчет", "расчёт", "аванс", "предоплата", "ответственность", "неустойк", "штраф", "пеня", "1/300", "ключев"],
    "tech": ["техничес", "требован", "тз", "спецификац", "описание объекта", "поставка", "отгруз", "партия", "срок поставки"],
    "price": ["нмцк", "начальная (максимальная) цена", "цена контракта", "обоснование нмц", "расчет нмц", "итого", "цена, руб"],
}
ROLE_FILE_NAMES = {"contract": r"контракт|договор|проект", "tech": r"тех|тз|требован|описание", "price": r"нмц|обосн"}
ROLE_THRESHOLD = 3

# History and report: what makes a reason a high or a medium risk, labels of sources, decisions and levels.
HIGH_SIGNALS = ["нет аванс", "аванса нет", "оплата после полной поставки", "после полной поставки", "штраф", "пеня", "обеспечение контракта: 20", "обеспечение контракта 20", "обеспечение контракта: 30", "обеспечение заявки", "кассов", "замороз", "по заявкам", "неопределенн", "неопределённ"]
MEDIUM_SIGNALS = ["обеспечение контракта", "обеспечение заявки", "гаранти", "срок", "растягив", "партиями", "поэтап"]
SOURCE_LABELS = {"batch": "Пакет документов", "doc": "Документ", "docx": "Документ", "pdf": "PDF-документ"}
SOURCE_OTHER = "Текстовый анализ"
LEVEL_WORDS = [("critical", "critical"), ("high", "high"), ("medium", "medium"), ("low", "low"), ("крит", "critical"), ("высок", "high"), ("средн", "medium"), ("низк", "low")]
LEVEL_LABELS = {"critical": "критический", "high": "высокий", "medium": "средний", "low": "низкий"}
DECISIONS = {"critical": "Не участвовать", "high": "Не участвовать", "medium": "Участвовать с осторожностью", "low": "Можно участвовать"}
NO_FACTOR = "Условия контракта создают повышенный риск"
FIXES = {
    "advance": "Запросить аванс 20–30% или частичную предоплату по этапам/партиям.",
    "after_full": "Разбить оплату по этапам/партиям вместо оплаты после полной поставки.",
    "contract_security": "Проверить возможность снизить обеспечение контракта до <=10% или заменить формат (гарантия и т.п.).",
    "bid_security": "Уточнить условия обеспечения заявки и заложить стоимость заморозки средств/гарантии в цену.",
    "by_requests": "Зафиксировать объём и график поставки: убрать неопределённость 'по заявкам' или прописать лимиты/сроки.",
}
FIXES_OTHERWISE = ["Проверить условия оплаты/сроков и оценить потребность в оборотных средствах до участия.", "Заложить риски штрафов/гарантий/сроков в цену или запросить разъяснения у заказчика."]
CURRENCIES = ["RUB", "USD", "EUR"]
# Votes over several answers: the range of a field, and which of equally good values wins (none: the first).
VOTE_RANGES = {"payment_terms_days": (0, 365), "execution_days": (1, 5000), "nmck": (1_000, 10_000_000_000), "penalty_percent_per_day": (0, 100), "fine_percent": (0, 100), "advance_percent": (0, 100)}
VOTE_TIES = {"payment_terms_days": "largest", "execution_days": "smallest", "nmck": "largest", "penalty_percent_per_day": "largest", "fine_percent": "largest"}
