"""Evidence, repair, consolidation, answers, checks and storage: awkward cases by hand, and each query against its SQL."""

import time

import duckdb
import pytest
from pyspark.sql import functions as F

from bidlens.functions import numbers as N
from bidlens.functions import text as T
from bidlens.operators import answers as A
from bidlens.operators import checks as K
from bidlens.operators import consolidation as S
from bidlens.operators import corpus as C
from bidlens.operators import evidence as E
from bidlens.operators import retrieval as V
from bidlens.operators.repair import read_again
from bidlens.options import int_option
from bidlens.plans import queries as Q
from bidlens.plans import review
from bidlens.plans.analyze import facts
from bidlens.sources import history_store as store
from tests.test_engine import SF, TABLES, one, plain, tender

REVIEW = [name for name, function in Q.QUERIES.items() if function.__module__ == review.__name__ and name not in ("missing_reasons", "price_candidates")]


@pytest.mark.parametrize("name", REVIEW)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = Q.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = con.execute(f"select {', '.join(columns)} from ({Q.SQL[name]})").fetchall()
    assert sorted(map(str, map(plain, got.select(*columns).collect()))) == sorted(map(str, map(plain, want)))


def test_positions_with_the_mark_in_the_text(spark):
    text = "a￿b контракта ￿￾ контракта"
    row = one(spark, a=T.find_all(F.lit(text), T.quoted("контракта")), b=V.keyword_hits(F.lit(text), ["контракта", "b"]), c=T.find_all(F.lit("x￿y"), "x.y"), d=T.find_word(F.lit(text), "контракта"))
    assert [tuple(m) for m in row.a] == [(4, 13, "контракта"), (17, 26, "контракта")]
    assert [(h.start, h.keyword) for h in row.b] == [(2, "b"), (4, "контракта"), (17, "контракта")]
    assert [tuple(m) for m in row.c] == [(0, 3, "x￿y")] and row.d == [4, 17]


def test_positional_search_grows_with_the_text(spark):
    def seconds(n):
        df = spark.range(1).select(F.repeat(F.lit("слово оплата текст "), n).alias("t")).cache()
        df.count()
        began = time.time()
        row = df.select(F.size(T.find_all(F.col("t"), T.quoted("оплата"))).alias("a"), F.size(V.basic_snippets(F.col("t"), "payment")).alias("b"), F.size(C.lines(F.replace("t", F.lit(" "), F.lit("\n")))).alias("c")).first()
        assert tuple(row) == (n, 1, 3 * n + 1)
        return time.time() - began

    seconds(100)
    assert seconds(32_000) < 12  # copies at each match took minutes


def test_running_totals(spark):
    row = one(spark, a=T.running_sum(F.array(*[F.lit(x) for x in (3, 1, 4, 1, 5, 9)])), b=T.running_max(F.array(*[F.lit(x) for x in (3, 1, 4, 1, 5)])), c=T.running_sum(F.array().cast("array<int>")), d=T.running_sum(F.lit(None).cast("array<int>")))
    assert (row.a, row.b, row.c, row.d) == ([0, 3, 4, 8, 9, 14], [-1, 3, 3, 4, 4], [], None)


def test_quotes(spark):
    text = F.lit("x" * 300 + " цена " + "y" * 300)
    row = one(spark, a=T.clip_centred(text, F.lit(301), F.lit(305)), b=T.clip_centred(text, F.lit(250), F.lit(350)), c=T.clip_flat(F.lit(" a \n b ")), d=T.clip_flat(F.lit("a b " * 200)))
    assert row.a == ("x" * 300 + " цена " + "y" * 300)[121:485] and len(row.b) == 400
    assert row.c == "a b" and len(row.d) <= 320 and row.d.endswith("…")


def test_whole_corpus_is_searched_without_snippets(spark):
    row = facts(tender(spark, "Работы выполнить в течение 10 дней с даты договора"), "basic").first()
    assert (row.nmck, row.payment_terms_days, row.execution_days) == (None, 10, 10)
    assert row.c_price == [] and [(b.start, b.file) for b in row.files] == [(0, None)]


def test_equal_prices_of_two_files_are_two_candidates(spark):
    text = "\n\n".join(f"===== FILE {i}/2: {name} (.txt) =====\nНМЦК: 5 000 000 руб." for i, name in enumerate(("a.txt", "b.txt"), 1))
    row = facts(tender(spark, text), "basic").first()
    assert sorted((c.value, c.file) for c in row.c_price if c.value == 5e6) == [(5e6, "a.txt (.txt)"), (5e6, "b.txt (.txt)")]
    assert [(b.file, b.text) for b in row.files] == [("a.txt (.txt)", "НМЦК: 5 000 000 руб.\n\n"), ("b.txt (.txt)", "НМЦК: 5 000 000 руб.")]
    assert all(row.corpus[b.start :].startswith(b.text) for b in row.files)


def test_value_evidence(spark):
    say = lambda value, text, words, marks=None: one(spark, e=E.value_evidence(F.lit(text), F.lit(value), words, marks)).e
    assert say(5e6, "Этаж 5. Цена контракта 5 000 000 руб.", ["цена контракта"]).start == 23
    assert say(5e6, "Обеспечение 5.000.000" + " x" * 200 + " цена контракта 5,000,000", ["цена контракта"]).start > 400
    assert say(0.1, "пеня 0,1% в день", ["пеня"]).quote == "пеня 0,1% в день"
    assert say(0.1, "пеня 10,15%", ["пеня"]) is None and say(15.0, "срок 150 дней", ["срок"]) is None
    assert say(7.0, "НМЦК 7", ["НМЦК"]) is None  # words are sought in lower case as they are spelled
    assert say(7.0, "без слов 7", []).start == 9 and say(7.0, "", ["x"]) is None
    assert one(spark, e=E.value_evidence(F.lit("срок 7"), F.lit(None).cast("double"), ["срок"])).e is None
    text = "===== FILE 1/1: a.txt =====\nсрок 7 дней"
    assert say(7.0, text, ["срок"], C.markers(F.lit(text))).file == "a.txt"


def test_passages_under_a_budget(spark):
    made = lambda text, words, **options: one(spark, p=E.passages(F.lit(text), words, **options)).p
    long = " ".join(f"{i} оплата {'x' * 400}" for i in range(12))
    row = made(long, ["оплата"])
    assert row.stop == "most_chars" and sum(map(len, row.pieces)) >= 1600 and sum(map(len, row.pieces[:-1])) < 1600
    assert made(long, ["оплата"], window=5).stop == "most_pieces" and len(made(long, ["оплата"], window=5).pieces) == 6
    assert made("Оплата, оплата", ["оплата"]).pieces == ["Оплата, оплата"]  # one piece twice counts once
    assert made("", ["оплата"]).stop == "exhausted" and made("x", ["%"]).pieces == []
    assert one(spark, p=E.passages(F.lit(None).cast("string"), ["x"])).p is None


def test_repair_reads_plainly(spark):
    def again(field, *texts):
        snippets = F.array(*[F.struct(F.lit(t).alias("snippet")) for t in texts]) if texts else F.array().cast("array<struct<snippet:string>>")
        return one(spark, v=read_again(field, snippets)).v

    assert again("nmck", "цена 0 руб.", "НМЦК 3 млн руб.") == 3e6 and again("nmck", "нет") is None
    assert again("payment_terms_days", "срок 7 рабочих дней") == 9.0 and again("payment_terms_days", "0 дней") == 0.0
    assert again("execution_days", "0 дней", "5 суток") == 5.0 and again("execution_days") is None
    assert again("penalty_percent_per_day", "аванс 10%", "пеня 0,1%") == 10.0 and again("penalty_percent_per_day", "нет", "пеня 1%") is None
    assert one(spark, v=N.parse_money_scaled(F.lit("5 миллионов"))).v == 5.0


def test_sources_win_once_each(spark):
    none = F.lit(None).cast("double")
    current = {"nmck": F.lit(10.0), "payment_terms_days": F.lit(5000), "execution_days": none, "penalty_percent_per_day": F.lit(0.5), "fine_percent": none}
    mined = {"nmck": F.lit(5e6), "payment_terms_days": F.lit(30.5), "execution_days": F.lit(20.5), "penalty_percent_per_day": F.lit(1.0), "fine_percent": none}
    detail = {"final_calendar": none, "final_working": F.lit(7), "advance_days": F.lit(3), "penalty_percent_per_day": none, "fine_percent": F.lit(2.0)}
    filled = S.fill_missing(current, mined)
    values, sources = S.consolidate(filled, detail, {**dict.fromkeys(current, F.lit(None).cast("string")), "nmck": F.lit("regex")})
    row = one(spark, f=F.array(*filled.values()), v=F.array(*values.values()), s=F.array(*sources.values()), e=F.array(*S.fill_empty(current, mined).values()), w=S.with_sources(values, sources))
    assert row.f == [5e6, 30.0, 20.0, 0.5, None] and row.v == [5e6, 10.0, 20.0, 0.5, 2.0]
    assert row.s == ["regex", "meta", "legacy", "legacy", "meta"] and row.e == [10.0, 5000.0, 20.0, 0.5, None]
    assert [(x.field, x.source) for x in row.w][1] == ("payment_terms_days", "meta")


def test_answers_of_odd_shape(spark):
    candidates = spark.createDataFrame([(1, "nmck", 1, "a", "НМЦК"), (1, "nmck", 2, "", ""), (1, "nmck", 3, "5", None), (1, "nmck", 4, "a", "")], "key int, field string, nth int, id string, quote string")
    raws = ['{"selected_id": "a"}', '{"selected_id": ""}', '{"selected_id": 5, "must_have_quote": 0}', '{"selected_id": 5}', '{"selected_id": {}}', "{}", "", None, '{"a":1} {"b":2}', '{"selected_id":"a","selected_id":"b"}', ' {"selected_id": "a", "confidence": true, "reason": "' + "д" * 300 + '"} ']
    answers = spark.createDataFrame([(1, "nmck", r) for r in raws] + [(2, "nmck", "{}"), (None, "nmck", "{}")], "key int, field string, raw string")
    got = A.check_answers(answers, candidates, "ranked")
    assert sorted((r.cause or "ok", r.selected_id or "-") for r in got.collect()) == sorted(
        [("ok", "a"), ("ok", "-"), ("ok", "5"), ("no_quote", "-"), ("unknown_id", "-"), ("ok", "-"), ("not_an_object", "-"), ("not_an_object", "-"), ("not_an_object", "-"), ("not_an_object", "-"), ("ok", "a"), ("no_candidates", "-"), ("no_candidates", "-")]
    )
    best = [r for r in got.collect() if r.confidence == 1.0]
    assert len(best) == 1 and best[0].note == "д" * 200
    strict = A.check_answers(answers, candidates, "evidence").filter("accepted").collect()
    assert {r.selected_id for r in strict} == {"a"}
    with pytest.raises(ValueError):
        A.check_answers(answers, candidates, "other")
    assert A.check_answers(answers.limit(0), candidates, "ranked").count() == 0


def test_choice_by_ranked_ids(spark):
    rows = [(1, "f", 1, "a", "", 0.9, 5), (1, "f", 2, "b", "q", 0.5, 9), (1, "f", 3, "c", "q", 0.5, 3), (2, "f", 1, "a", None, None, None), (3, "f", 1, "x", "q", 0.1, 1), (3, "f", 2, "x", "r", 0.2, 1)]
    candidates = spark.createDataFrame(rows, "key int, field string, nth int, id string, quote string, confidence double, offset int")
    choose = lambda *decisions: {r.key: (r.id, r.nth, r.how) for r in A.choose(candidates, spark.createDataFrame(list(decisions), "key int, field string, selected_id string, accepted boolean")).collect()}
    assert choose((1, "f", "b", True), (2, "f", None, True), (9, "f", "a", True)) == {1: ("b", 2, "decision"), 2: ("a", 1, "first"), 3: ("x", 2, "surest")}
    assert choose((1, "f", "zz", True), (3, "f", "x", True)) == {1: ("a", 1, "first"), 2: ("a", 1, "surest"), 3: ("x", 1, "decision")}
    assert choose((1, "f", "b", False))[1] == ("c", 3, "surest")


def test_checks_of_missing_values(spark):
    df = tender(spark, "НМЦК указана отдельно").withColumn("text", F.lit("НМЦК указана отдельно"))
    row = K.quality(facts(df, "basic")).first()
    assert row.quality_score == 0 and [(q.field, q.reason) for q in row.quality][0] == ("nmck", "parse_failed") and row.quality[0].warning.endswith("Фрагмент: НМЦК указана отдельно")
    null = F.lit(None).cast("double")
    assert one(spark, e=K.listed_errors(null, F.lit(0), F.lit(10.5))).e == ["payment_terms_days missing or out of range", "execution_days missing or out of range", "penalty_percent_per_day missing or out of range"]
    assert one(spark, e=K.listed_errors(F.lit(365), F.lit(5000), F.lit(10))).e == []


def test_history_deletes_and_empties_months(spark, tmp_path):
    rows = [(1, 7, "2024-01-05", 1.0), (2, 8, "2024-01-06", None), (3, 7, "2024-02-01", 2.0), (4, None, "2024-03-01", 3.0), (5, 8, "2024-04-01", 4.0)]
    df = spark.createDataFrame(rows, "id long, user_id long, day string, roi double").withColumn("created_at", F.to_timestamp("day"))
    path = f"file://{tmp_path}/history"
    store.append(df, path)
    april = (tmp_path / "history/month=2024-04").stat().st_mtime_ns
    gone = store.delete(spark, path, spark.createDataFrame([(7,), (7,), (None,), (99,)], "user_id long"))
    assert sorted(map(tuple, gone.collect())) == [("2024-01", 2, 1), ("2024-02", 1, 1)]
    assert sorted((r.id, r.roi) for r in store.read(spark, path).collect()) == [(2, 0.0), (4, 3.0), (5, 4.0)]
    assert not (tmp_path / "history/month=2024-02").exists() and (tmp_path / "history/month=2024-04").stat().st_mtime_ns == april
    assert store.delete(spark, path, spark.createDataFrame([(8, 4)], "user_id long, id long")).count() == 0
    assert store.delete(spark, path, spark.createDataFrame([(8, 5)], "user_id long, id long")).count() == 1
    store.write_failures(store.failures(spark.createDataFrame([(1, "m", 100, 100.5, 3, None)], "k int, mode string, truth_nmck int, found_nmck double, truth_d int, found_d int")), f"{tmp_path}/report")
    assert spark.read.json(f"{tmp_path}/report").first().failed == "d"
    assert one(spark, j=store.as_json({"a": F.lit(None).cast("int"), "b": F.lit("x")})).j == '{"a":null,"b":"x"}'


def test_options(spark):
    spark.conf.set("bidlens.test.a", "12")
    spark.conf.set("bidlens.test.b", "viele")
    assert [int_option(spark, f"bidlens.test.{x}", 5) for x in "abc"] == [12, 5, 5]
