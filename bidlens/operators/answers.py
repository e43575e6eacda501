"""Answers of a model as untrusted rows: checked by schema, joined to the candidates they choose from, refused with a cause.

The model itself is outside; what it answered arrives as a table of texts. Two rule sets exist: ranked and
evidence. Everything is joined by key and field, so it spreads over the cluster by them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidlens.functions.text import any_of, let, strip

#: Words of which one must stand in the quote of a chosen candidate.
QUOTE_WORDS = {
    "nmck": ["нмцк", "начальная (максимальная) цена", "цена контракта", "цена договора"],
    "payment_terms": ["оплат", "расчет", "платеж", "аванс", "предоплат", "приемк"],
    "execution_days": ["срок", "поставк", "исполн", "оказани", "дн"],
    "penalties": ["пеня", "неустойк", "штраф", "1/300", "ключевой ставк", "1042"],
}


def json_object(text: Column) -> Column:
    """The object that a text is, else the one between its first and its last brace, as a variant; null if there is none."""
    # In brackets, as the parser stops after a first value, whatever follows it.
    alone = lambda v: F.when(F.variant_get(v, "$[1]", "variant").isNull(), F.variant_get(v, "$[0]", "variant"))
    parse = lambda t: let(F.try_parse_json(F.concat(F.lit("["), t, F.lit("]"))), alone)
    whole = lambda t: F.when(F.startswith(t, F.lit("{")) & F.endswith(t, F.lit("}")), parse(t))
    inner = lambda t: parse(F.nullif(F.regexp_extract(t, r"(?s)\{.*\}", 0), F.lit("")))
    return let(strip(text), lambda t: F.coalesce(whole(t), inner(t)))


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _given(value: Column) -> Column:
    """Whether a JSON value counts as true: no null, false, 0 or empty text."""
    kind, text = _kind(value), F.try_variant_get(value, "$", "string")
    number = F.coalesce(text.try_cast("double") != 0, F.lit(True))
    return F.when(kind == "VOID", False).when(kind == "BOOLEAN", text == "true").when(kind == "STRING", text != "").when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), number).otherwise(True)


def _share(value: Column) -> Column:
    """A confidence between 0 and 1; 0 for what isn't a number."""
    number = F.when(_kind(value) == "BOOLEAN", F.when(F.try_variant_get(value, "$", "boolean"), 1.0).otherwise(0.0)).otherwise(F.trim(F.try_variant_get(value, "$", "string")).try_cast("double"))
    return let(number, lambda n: F.when(n.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.nanvl(n, F.lit(1.0))))))


def check_answers(answers: DataFrame, candidates: DataFrame, rules: str) -> DataFrame:
    """One row per answer (key, field, raw): key, field, accepted, cause, selected_id, confidence, note.

    `candidates` has key, field, nth, id, quote; of equal ids the first counts. Causes of refusal: no_candidates,
    not_an_object, unknown_id, no_quote (ranked), no_anchor (evidence). The ranked rules take no choice
    (id null) for an answer, the evidence rules don't; theirs compare ids as texts only. Repeated answers are judged
    one by one; a null raw text is no object. A repeated name in an object makes it none.
    """
    ranked = rules == "ranked"
    if not ranked and rules != "evidence":
        raise ValueError("rules are ranked or evidence")
    read = answers.withColumn("_o", json_object(F.col("raw")))
    read = read.withColumn("_o", F.when(_kind(F.col("_o")).startswith("OBJECT"), F.col("_o")))
    chosen = F.variant_get("_o", "$.selected_id", "variant")
    kind = F.coalesce(_kind(chosen), F.lit("VOID"))
    text_only = F.lit(True) if ranked else kind == "STRING"
    read = read.withColumns({"selected_id": F.when((kind != "VOID") & text_only, F.try_variant_get(chosen, "$", "string")), "_named": kind != "VOID"})
    ids = candidates.groupBy("key", "field", F.col("id").alias("selected_id")).agg(F.min_by(F.struct("quote"), "nth").alias("_c"))
    any_ = candidates.select("key", "field").distinct().withColumn("_any", F.lit(True))
    met = read.join(any_, ["key", "field"], "left").join(ids, ["key", "field", "selected_id"], "left")
    demand = F.coalesce(_given(F.variant_get("_o", "$.must_have_quote" if ranked else "$.must_quote_match", "variant")), F.lit(True))
    quote = F.lower(F.coalesce(F.col("_c.quote"), F.lit("")))
    anchored = F.lit(False)
    for field, words in QUOTE_WORDS.items():
        anchored = F.when(F.col("field") == field, any_of(quote, words)).otherwise(anchored)
    unknown = (F.col("_named") & F.col("_c").isNull()) if ranked else F.col("_c").isNull()
    unproven = F.when(F.col("_c").isNotNull() & (F.coalesce("selected_id", F.lit("")) != "") & demand & (quote == ""), "no_quote") if ranked else F.when(demand & ~anchored, "no_anchor")
    cause = F.when(F.col("_any").isNull(), "no_candidates").when(F.col("_o").isNull(), "not_an_object").when(unknown, "unknown_id").otherwise(unproven)
    said = F.variant_get("_o", "$.reason" if ranked else "$.notes", "variant")
    note = F.coalesce(F.when(said.isNotNull() & _given(said), F.try_variant_get(said, "$", "string")), F.lit("ok" if ranked else rules))
    out = met.withColumn("cause", cause)
    fine = F.col("cause").isNull()
    return out.select(
        "key", "field", fine.alias("accepted"), "cause", F.when(fine, F.col("selected_id")).alias("selected_id"),
        F.when(fine, _share(F.variant_get("_o", "$.confidence", "variant"))).otherwise(0.0).alias("confidence"), F.when(fine, F.substring(note, 1, 200) if ranked else note).alias("note"),
    )


def choose(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """One candidate a key and field: the one decided on, else the surest.

    `candidates` has key, field, nth, id, quote, confidence, offset; `decisions` key, field, selected_id,
    accepted, one for each. A refused decision, or none, leaves the surest: by confidence, offset and id, the
    first with a quote if any has one. An accepted one without a choice, or with an id that no candidate has, leaves the first in order.
    """
    judged = candidates.join(decisions.select("key", "field", F.col("selected_id").alias("_id"), F.coalesce("accepted", F.lit(False)).alias("_accepted")), ["key", "field"], "left")
    trusted = F.coalesce("_accepted", F.lit(False))
    asked = trusted & F.coalesce(F.col("id") == F.col("_id"), F.lit(False))
    sure = F.struct((F.coalesce("quote", F.lit("")) == "").alias("q"), (-F.coalesce("confidence", F.lit(0.0))).alias("c"), F.coalesce("offset", F.lit(0)).alias("o"), F.coalesce("id", F.lit("")).alias("i"), F.col("nth").alias("n"))
    first = F.struct(F.lit(False).alias("q"), F.lit(0.0).alias("c"), F.lit(0).cast(candidates.schema["offset"].dataType).alias("o"), F.lit("").alias("i"), F.col("nth").alias("n"))
    order = F.struct((~asked).alias("a"), F.when(trusted, first).otherwise(sure).alias("b"))
    how = F.when(F.max(F.when(asked, 1)) == 1, "decision").when(F.max(F.when(trusted, 1)) == 1, "first").otherwise("surest")
    return judged.groupBy("key", "field").agg(F.min_by(F.struct(*candidates.columns), order).alias("c"), how.alias("how")).select("c.*", "how")
