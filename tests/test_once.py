"""Texts that several rows share are worked on once, and every row gets their result."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from bidlens.sources.tables import once

SF = "/root/testdata/sf0.001"
TEXTS = [
    "facts_basic", "facts_ranked", "facts_evidence", "facts_fallback", "candidates_basic", "candidates_ranked", "candidates_evidence", "missing_reasons", "quality_gate", "quality_warnings", "repaired_fields",
    "analyze_basic", "analyze_ranked", "analyze_evidence", "eval_accuracy", "audit_missing_topk", "rerun_diff", "value_places", "price_candidates", "evidence_passages", "danger_phrases_query", "trap_flags",
]


def test_equal_rows_are_worked_on_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def length(text):
        seen.add(1)
        return len(text or "")

    rows = spark.range(0, 900, numPartitions=3).select(F.col("id").alias("k"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("т" * 5), (F.col("id") % 3).cast("string"))).alias("text"), (F.col("id") % 2).alias("n"))
    got = once(rows, "k", lambda texts: texts.select("of", "text", "n", length("text").alias("long"))).collect()
    assert sorted((r.k, r.text, r.n, r.long) for r in got) == [(k, f"{'т' * 5}{k % 3}" if k % 3 else None, k % 2, 6 if k % 3 else 0) for k in range(900)]
    assert seen.value == 6


def test_null_and_empty_texts_differ(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, " "), (4, None), (5, '"'), (6, '\\"')], "k long, text string")
    got = once(rows, "k", lambda texts: texts.select("of", F.col("text").alias("same"))).collect()
    assert {r.k: r.same for r in got} == {1: None, 2: "", 3: " ", 4: None, 5: '"', 6: '\\"'}


class Given(Exception):
    """Ends a query at once(), with the columns that it gives."""


@pytest.mark.parametrize("name", TEXTS)
def test_queries_take_each_text_once(spark, name, monkeypatch):
    def noted(rows, key, make):
        raise Given(rows.columns)

    for module in ("queries", "review"):
        monkeypatch.setattr(f"bidlens.plans.{module}.once", noted)
    with pytest.raises(Given) as given:
        __spark_entry__.queries()[name](spark, SF)
    assert "text" in given.value.args[0]


@pytest.mark.parametrize("name", ["reason_severity", "report_lines"])
def test_columns_of_an_order_need_no_join(spark, name):
    plan = __spark_entry__.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_rows_equal_to_distinct_are_joined_back(spark):
    """A zero below zero is the same to distinct(), so it must be to the mark; what lies on either side of a column's end is not."""
    rows = spark.createDataFrame([(1, "а", 0.0, None), (2, "а", -0.0, None), (3, "а1:б", 1.0, ""), (4, "а", 1.0, "1:б"), (5, None, float("nan"), "а"), (6, None, float("nan"), "а")], "k long, text string, x double, other string")
    got = once(rows, "k", lambda texts: texts.select("of", "text", F.col("x").cast("string").alias("x"), "other")).collect()
    assert sorted((r.k, r.text, r.x, r.other) for r in got) == [(1, "а", "0.0", None), (2, "а", "0.0", None), (3, "а1:б", "1.0", ""), (4, "а", "1.0", "1:б"), (5, None, "NaN", "а"), (6, None, "NaN", "а")]


def test_a_row_is_marked_once_a_side(spark):
    """The join would add a filter on null marks, which works the mark out again for every row."""
    rows = spark.range(0, 90).select(F.col("id").alias("k"), F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("text"))
    plan = once(rows, "k", lambda texts: texts.select("of", F.length("text").alias("n")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sha2(") == 2 and "to_json" not in plan


def test_no_more_tasks_than_keep_the_cores_busy(spark):
    """Each task gets make()'s long expressions ready anew, so many partitions of a shuffle would cost more than the texts."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1000")
    try:
        rows = spark.range(0, 90).select(F.col("id").alias("k"), F.col("id").cast("string").alias("text"))
        plan = once(rows, "k", lambda texts: texts.select("of", F.length("text").alias("n")))._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert f"], {max(24, 3 * spark.sparkContext.defaultParallelism)}" in plan and "], 1000" not in plan


@pytest.mark.parametrize("name", ["candidates_basic", "candidates_ranked", "candidates_evidence", "danger_phrases_query", "evidence_passages", "missing_reasons", "price_candidates", "quality_warnings", "repaired_fields", "value_places"])
def test_lists_are_unfolded_once_a_text(spark, name, monkeypatch):
    """What once() gives is the result; nothing is left to do for each row."""
    given = spark.range(1)
    for module in ("queries", "review"):
        monkeypatch.setattr(f"bidlens.plans.{module}.once", lambda rows, key, make: given)
    assert __spark_entry__.queries()[name](spark, SF) is given


def test_a_corpus_is_lowered_once(spark):
    """The sections and the gate share one lower case; before, each worked it out anew."""
    from bidlens.plans.analyze import facts, gate

    texts = spark.createDataFrame([("НМЦК: 5 000 000 руб.",)], "text string")
    plan = gate(facts(texts, "basic"))._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"lower\(corpus#\d+", plan)) == 1


@pytest.mark.parametrize("name", ["candidates_basic", "candidates_ranked", "candidates_evidence"])
def test_candidates_come_with_their_fields(spark, name):
    """The name of the unfolded struct was that of a subquery of the tenders, so that k stood there twice and the fields were missing."""
    assert __spark_entry__.queries()[name](spark, SF).columns == ["k", "field", "start", "confidence"]
