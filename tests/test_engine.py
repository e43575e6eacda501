"""Goldens and determinism of the tender engine, and every query against its SQL on the smallest tables."""

import os
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from bidlens.functions import numbers as N
from bidlens.functions import text as T
from bidlens.operators import layout as L
from bidlens.operators import mining as M
from bidlens.plans import queries as Q
from bidlens.plans.analyze import analyze, facts, gate, traps
from bidlens.sources import documents as D
from bidlens.streaming.analysis import analyze_stream, append_analyses, drop_user

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUICK = [n for n in Q.SQL if not n.startswith(("analyze", "facts", "eval", "audit", "rerun", "quality", "snippet"))] + ["facts_basic", "analyze_ranked", "snippet_merge_basic"]


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def tender(spark, text):
    return spark.createDataFrame([(1, text, 100.0, 12.0)], "k long, text string, cost_price double, planned_margin_percent double")


@pytest.mark.parametrize(
    "text,value",
    [("7 752 436,93 руб.", 7752436.93), ("5.000.000", 5e6), ("5,000,000.50", 5000000.5), ("цена 1 200 000 ₽", 1.2e6), ("нет", None), ("", None), ("12,5", 12.5), ("1.234", 1234.0)],
)
def test_money(spark, text, value):
    assert one(spark, v=N.parse_money(F.lit(text))).v == value


def test_numbers(spark):
    row = one(
        spark,
        a=N.parse_percent(F.lit("0,1 %")), b=N.parse_percent(F.lit("пять 5 процентов")), c=N.parse_days(F.lit("7 рабочих дней")), d=N.parse_date_range(F.lit("с 01.02.2024 по 11/02/24")), e=N.parse_date_range(F.lit("31.02.2024 - 01.03.2024")),
        f=N.parse_date(F.lit("3 марта 2024")), g=N.to_calendar(F.lit(7)), h=N.format_rub(F.lit(1234567.5)), i=N.format_rub(F.lit(None).cast("double")), j=N.parse_money_scaled(F.lit("1,5 млн руб")), k=N.safe_bool(F.lit(" Да ")), l=N.json_in_text(F.lit('x {"a": 1} y'), "a int"),
    )
    assert (row.a, row.b, tuple(row.c), row.d, row.e, str(row.f), row.g) == (0.1, 5.0, (7, "working"), 10, None, "2024-03-03", 10)
    assert (row.h, row.i, row.j, row.k, row.l.a) == ("1 234 568 ₽", "—", 1.5e6, True, 1)


def test_text(spark):
    row = one(spark, a=T.normalize_text(F.lit(" a \t b\r\n\r\n\r\n\r\nc – d\x00 ")), b=T.find_all(F.lit("ОПЛАТА и оплата"), T.quoted("оплата")), c=T.cuts(F.lit("abcdefghij"), 4, 1), d=T.count_hits(F.lit("ab ab b"), ["ab", "b"]))
    assert row.a == "a b\n\nc - d"
    assert [(m.start, m.end) for m in row.b] == [(0, 6), (9, 15)]
    assert [c.text for c in row.c] == ["abcd", "defg", "ghij"]
    assert row.d == 5


CONTRACT = "Оплата производится в течение 7 рабочих дней после подписания документа о приемке. Аванс не предусмотрен. Пеня рассчитывается в размере 1/300 ключевой ставки за каждый день просрочки. Штраф составляет 1%, не более 5000 руб. и не менее 1000 руб., согласно постановлению 1042."
PRICE = "Начальная (максимальная) цена контракта составляет 752 183,09 руб."


def test_evidence_golden(spark):
    text = f"===== FILE contract.txt =====\n{CONTRACT}\n\n===== FILE nmck.txt =====\n{PRICE}\n\n"
    row = facts(tender(spark, text), "evidence").first()
    assert (row.nmck, row.payment_terms_days, row.advance_percent) == (752183.09, 10, 0.0)
    assert (row.penalty.denominator, row.penalty.fine, row.penalty.fine_min, row.penalty.fine_max, row.penalty.decree) == (300, 1.0, 1000.0, 5000.0, "1042")


def test_evidence_without_price(spark):
    row = analyze(tender(spark, "Оплата производится в течение 7 рабочих дней. Аванс не предусмотрен. Срок поставки 30 календарных дней."), "evidence").first()
    assert (row.nmck, row.safe_cost, row.roi_percent, row.cash_gap) == (None, None, None, None)
    assert row.verdict == "Недостаточно данных для финансовой оценки" and row.payment_terms_days == 10 and row.execution_days == 30


def test_sections_gate_and_traps(spark):
    full = "НМЦК по извещению: 1 500 000 руб. Оплата в течение 30 дней. Срок поставки 15 дней. Ответственность: неустойка 0.1%."
    row = gate(facts(tender(spark, full), "basic")).first()
    assert row.has_price_section and row.has_payment_section and row.has_execution_section and row.has_liability_section
    long = gate(facts(tender(spark, full + " Дополнение." * 400), "basic")).first()
    assert not long.is_partial and long.can_compute
    contract = gate(facts(tender(spark, "Оплата в течение 20 дней. Неустойка 0.1%."), "basic")).first()
    assert contract.is_partial and not contract.can_compute
    trap = "Оплата производится после полной поставки. Поставка партиями по заявке заказчика. Поставщик обязан иметь товар на складе."
    assert all(one(spark, **traps(F.lit(trap), "ranked")))


@pytest.mark.parametrize("variant", ["basic", "ranked", "evidence"])
def test_odd_texts_and_determinism(spark, variant):
    rows = [(1, None), (2, ""), (3, PRICE), (4, "НМЦК " * 50), (5, "x" * 5000), (3, PRICE)]
    table = spark.createDataFrame([(k, t, None if k == 4 else 10.0, 12.0) for k, t in rows], "k long, text string, cost_price double, planned_margin_percent double")
    got = analyze(table, variant)
    assert got.count() == 6 and got.filter("nmck is not null").count() == 2
    assert got.exceptAll(analyze(table.repartition(3), variant)).isEmpty()


def test_layout(spark):
    words = [(0.0, 0.0, 20.0, 10.0, "a"), (22.0, 1.0, 40.0, 10.0, "b"), (100.0, 0.0, 120.0, 10.0, "c"), (0.0, 30.0, 20.0, 40.0, "d")]
    df = spark.createDataFrame([([dict(zip(("x0", "y0", "x1", "y1", "word"), w, strict=True)) for w in words],)], "words array<struct<x0:double,y0:double,x1:double,y1:double,word:string>>")
    rows = df.select(L.rows_of(F.col("words"), F.lit(842.0)).alias("rows"))
    assert rows.select(L.text_of(F.col("rows"), F.lit(595.0)).alias("t")).first().t == "a b\tc\nd"
    assert not rows.select(L.is_table(F.col("rows"), F.lit(595.0)).alias("t")).first().t
    grid = [dict(x0=float(c * 100), y0=float(r * 20), x1=float(c * 100 + 50), y1=float(r * 20 + 10), word="w") for r in range(5) for c in range(3)]
    table = spark.createDataFrame([(grid,)], df.schema).select(L.rows_of(F.col("words"), F.lit(842.0)).alias("rows"))
    assert table.select(L.is_table(F.col("rows"), F.lit(595.0)).alias("t")).first().t


def workbook(path):
    sheet = '<worksheet xmlns="m"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row><c r="A2" t="s"><v>2</v></c><c r="C2"><v>1500000</v></c></row><row/></sheetData></worksheet>'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="m" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Sheet1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="m"><si><t>Поле</t></si><si><t>Значение</t></si><si><t>НМЦК</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", sheet)


def test_documents(spark, tmp_path):
    (tmp_path / "a.csv").write_text("field;value\nnmck;1500000\n")
    (tmp_path / "b.txt").write_bytes("Оплата".encode("cp1251"))
    (tmp_path / "c.txt").write_text("﻿текст  тут")
    (tmp_path / "d.xls").write_bytes(b"\xd0\xcf")
    (tmp_path / "e.doc").write_bytes(("слово " * 30).encode())
    (tmp_path / "f.exe").write_bytes(b"MZ")
    workbook(tmp_path / "g.xlsx")
    with zipfile.ZipFile(tmp_path / "h.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document><w:p><w:r><w:t>один &amp; два</w:t><w:tab/><w:t xml:space="preserve">три</w:t></w:r></w:p><w:p><w:t>далее</w:t></w:p></w:document>')
    files = D.scan_folder(spark, str(tmp_path))
    got = {r.name: r for r in D.document_texts(files).collect()}
    assert got["a.csv"].text == "field | value\nnmck | 1500000"
    assert got["b.txt"].text == "Оплата" and got["c.txt"].text.endswith("текст тут")
    assert got["d.xls"].error == "Legacy XLS is not supported" and got["f.exe"].error and got["a.csv"].error is None
    assert got["g.xlsx"].text == "[SHEET] Sheet1\nПоле | Значение\nНМЦК | | 1500000"
    assert got["h.docx"].text == "один & два три\nдалее"
    assert got["e.doc"].text.startswith("слово слово")
    refused = D.check_packages(files.withColumn("p", F.lit(1)), "p").first().refused
    assert refused == ["unsupported_type"]
    valid = [D.valid_input(F.lit(t), F.lit(10.0), F.lit(m), F.lit(None).cast("string")) for t, m in ((" " * 60, 15.0), ("x" * 60, 101.0), ("x" * 60, 15.0))]
    assert list(one(spark, a=valid[0], b=valid[1], c=valid[2])) == [False, False, True]


def test_stream_and_sink(spark, tmp_path):
    table = tender(spark, PRICE)
    table.write.parquet(f"{tmp_path}/in")
    analyze_stream(spark, f"{tmp_path}/in", table.schema.simpleString().removeprefix("struct<")[:-1].replace(":", " "), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    append_analyses(analyze(table, "ranked"), f"{tmp_path}/out")
    stored = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(r.variant for r in stored.collect()) == ["basic", "ranked"]
    rest, gone = drop_user(spark.createDataFrame([(1, 5), (2, 6), (3, None)], "id long, user_id long"), 5)
    assert gone == 1 and rest.count() == 2


def plain(row):
    return tuple(None if v is None or v != v else round(float(v), 6) if isinstance(v, float) else str(v) for v in row)


@pytest.mark.parametrize("name", QUICK)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = Q.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = con.execute(f"select {', '.join(columns)} from ({Q.SQL[name]})").fetchall()
    assert sorted(map(str, map(plain, got.select(*columns).collect()))) == sorted(map(str, map(plain, want)))


def test_entry_without_llm():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert os.path.exists(SF)


def test_candidates_are_deduped_and_capped(spark):
    """Of equal values one, the surest first, and no more than the variant keeps."""
    amounts = [f"{n} 000 000 руб." for n in range(11, 25)]
    text = "НМЦК: 11 000 000 руб. " + "; ".join(amounts) + ". Цена контракта " + "; ".join(amounts)
    df = spark.createDataFrame([(text,)], "text string").withColumn("s", F.array(F.struct(F.lit(0).alias("offset"), F.col("text").alias("snippet"))))
    basic, ranked, evidence = df.select(M.price_basic(F.col("text"), F.col("s"), F.array(F.struct(F.lit(0).alias("start"), F.lit(None).cast("string").alias("file")))), M.price_ranked(F.col("text"), F.col("s")), M.price_evidence(F.col("s"))).first()
    assert len(basic) == M.MOST_BASIC == len({c["value"] for c in basic})
    assert len(ranked) == M.MOST_RANKED == len({(c["value"], c["offset"]) for c in ranked})
    assert len(evidence) == M.MOST_EVIDENCE
    assert [c["rank"] for c in basic] == sorted(c["rank"] for c in basic)
    assert [(c["rank"], c["offset"], c["id"]) for c in ranked] == sorted((c["rank"], c["offset"], c["id"]) for c in ranked)


def test_context_under_a_small_cap(spark):
    """The piece that goes over the cap is cut and ends the context."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    spark.conf.set("bidlens.context.cap", "1700")
    try:
        got = sorted(map(tuple, Q.QUERIES["context_budget"](spark, SF).select("doc_id", "n_chars", "text_sha256").collect()))
    finally:
        spark.conf.unset("bidlens.context.cap")
    want = con.execute(f"select doc_id, n_chars, text_sha256 from ({Q.SQL['context_budget'].replace('20000', '1700')}) order by 1").fetchall()
    assert got == want and max(n for _, n, _ in got) > 1600
