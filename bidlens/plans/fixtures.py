"""Tender texts and their truth by formula in the order key; the same SQL runs in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bidlens.sources.tables import spread, table

TENDER_SQL = """
SELECT k, mode, nmck, execution_days, payment_terms_days, contract_security_percent, bid_security_percent,
 advance_percent, penalty_txt, is_trap, has_vague_acceptance_terms,
 CASE WHEN NOT is_trap THEN concat(
 'Предмет закупки: поставка офисной мебели.', chr(10), chr(10),
 'Начальная (максимальная) цена контракта: ', nmck, ' рублей.', chr(10), chr(10),
 'Срок исполнения контракта - не позднее ', execution_days, ' календарных дней с даты заключения контракта.', chr(10), chr(10),
 'Оплата производится в течение ', payment_terms_days, ' календарных дней после подписания акта приемки.', chr(10), chr(10),
 'Авансовый платеж предусмотрен: ', advance_percent, '%.', chr(10), chr(10),
 'Обеспечение исполнения контракта - ', contract_security_percent, '% от цены контракта.', chr(10),
 'Обеспечение заявки - ', bid_security_percent, '% от цены контракта.', chr(10), chr(10),
 penalty_sentence)
ELSE concat(
 'Предмет закупки: поставка и ввод в эксплуатацию оборудования.', chr(10), chr(10),
 'Начальная (максимальная) цена контракта: ', nmck, ' рублей.', chr(10), chr(10),
 'Срок исполнения контракта - не позднее ', execution_days, ' календарных дней с даты заключения контракта.', chr(10), chr(10),
 'Поставка партиями по заявкам заказчика.', chr(10),
 'Поставщик обязан иметь товар на складе.', chr(10), chr(10),
 'Оплата производится в течение ', payment_terms_days, ' календарных дней после полной поставки.', chr(10), chr(10),
 CASE WHEN has_vague_acceptance_terms THEN concat('Решение о приемке принимается по усмотрению заказчика.', chr(10), chr(10)) ELSE '' END,
 'Авансовый платеж: ', advance_percent, '%.', chr(10), chr(10),
 'Обеспечение исполнения контракта - ', contract_security_percent, '% от цены контракта.', chr(10),
 'Обеспечение заявки - ', bid_security_percent, '% от цены контракта.', chr(10), chr(10),
 penalty_sentence) END AS text
FROM (SELECT b.*, CASE k % 4
  WHEN 0 THEN concat('За каждый день просрочки начисляется пеня ', penalty_txt, '%/день.')
  WHEN 1 THEN concat('Пеня составляет ', penalty_txt, '% за каждый день просрочки. Штраф 5%.')
  WHEN 2 THEN concat('Неустойка ', penalty_txt, '% в день, но не более 10%.')
  ELSE 'Пеня начисляется в размере 1/300 ключевой ставки за каждый день просрочки. Штраф 1%, не менее 1000 руб. и не более 5000 руб. (постановление 1042).' END AS penalty_sentence
      FROM (SELECT k,
CASE k % 3 WHEN 0 THEN 'safe' WHEN 1 THEN 'trap' ELSE 'hidden_loss' END AS mode,
(5 + (k * 7919) % 76) * 1000000 AS nmck,
CASE WHEN k % 3 = 0 THEN 45 + (k * 31) % 76 ELSE 30 + (k * 31) % 61 END AS execution_days,
CASE k % 3 WHEN 0 THEN 10 + (k * 17) % 21 WHEN 1 THEN 20 + (k * 17) % 41 ELSE 60 END AS payment_terms_days,
CASE k % 3 WHEN 0 THEN 5 + 5 * ((k * 13) % 2) WHEN 1 THEN 10 + 5 * ((k * 13) % 4) ELSE 25 END AS contract_security_percent,
CASE WHEN k % 3 = 0 THEN (k * 11) % 4 ELSE CASE (k * 11) % 3 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 5 END END AS bid_security_percent,
CASE k % 3 WHEN 0 THEN 10 * (1 + (k * 5) % 4 % 3) WHEN 1 THEN CASE (k * 5) % 4 WHEN 3 THEN 10 ELSE 0 END ELSE 0 END AS advance_percent,
CASE k % 3 WHEN 0 THEN CASE (k * 7) % 4 WHEN 0 THEN '0.02' WHEN 1 THEN '0.03' WHEN 2 THEN '0.05' ELSE '0.1' END
           WHEN 1 THEN CASE (k * 7) % 4 WHEN 0 THEN '0.1' WHEN 1 THEN '0.2' WHEN 2 THEN '0.3' ELSE '0.4' END
           ELSE '0.4' END AS penalty_txt,
(k % 3 <> 0) AS is_trap,
(k % 3 <> 0 AND (k * 7) % 10 < 6) AS has_vague_acceptance_terms
            FROM (SELECT o_orderkey AS k FROM orders) a) b) c
"""

#: Ten kinds of corpora by k % 10: files with equal and with different prices, texts without section words, values on
#: lines of their own, date spans, shares, values out of range, nothing, words without values, a long one.
_FILLER = "repeat('Общие положения и определения. ', 12)"
_PARTS = ", ".join(f"chr(10), 'Раздел {j}. Оплата этапа. ', {_FILLER}" for j in range(1, 9))
MIXED_SQL = f"""
SELECT k, kind, n, d, w, m, CASE kind
 WHEN 0 THEN concat('===== FILE 1/2: a.txt (.txt) =====', chr(10), 'НМЦК: ', n, ' 000 000 руб.', chr(10), 'Срок поставки ', d, ' рабочих дней.', chr(10), chr(10),
  '===== FILE 2/2: b.txt (.txt) =====', chr(10), 'Цена контракта: ', n, ' 000 000 руб.', chr(10), 'Оплата в течение ', w, ' рабочих дней.')
 WHEN 1 THEN concat('===== FILE 1/2: a.txt (.txt) =====', chr(10), 'НМЦК: ', n, ' 000 000 руб.', chr(10), chr(10),
  '===== FILE 2/2: b.txt (.txt) =====', chr(10), 'НМЦК: ', n + 1, ' 000 000 руб. Неустойка 0,', w, '% за каждый день просрочки.')
 WHEN 2 THEN concat('По извещению: ', n, ' 000 000 руб. Работы выполнить в течение ', d, ' дней с даты договора.')
 WHEN 3 THEN concat('НМЦК ', m, ' млн руб.', chr(10), {_FILLER}, chr(10), 'Оплата', chr(10), 'срок ', m, ' рабочих дней.', chr(10), {_FILLER}, chr(10), 'Поставка', chr(10), 'в срок до ', m, ' суток.', chr(10), {_FILLER}, chr(10), 'Пеня', chr(10), '0,', m, '% в сутки.')
 WHEN 4 THEN concat('НМЦК: ', n, ' 000 000 руб. Срок исполнения контракта: с 01.02.2024 по ', lpad(CAST(1 + w % 28 AS STRING), 2, '0'), '.03.2024.', chr(10), 'Оплата до ', w, ' календарных дней.')
 WHEN 5 THEN concat('Аванс 30% в течение 5 рабочих дней.', chr(10), 'Окончательный расчет 70% в течение ', w, ' рабочих дней после приемки.', chr(10), 'НМЦК: ', n, ' 000 000 руб.')
 WHEN 6 THEN 'НМЦК: 50 руб. Срок исполнения 9000 дней. Оплата в течение 400 дней. Пеня 15% за каждый день.'
 WHEN 7 THEN CASE WHEN k % 20 = 7 THEN ' ' END
 WHEN 8 THEN 'НМЦК указана в приложении. Оплата по счету. Поставка по графику. Пеня по закону.'
 ELSE concat('Штраф 7%. Аванс не предусмотрен. Оплата в течение ', w, ' рабочих дней после поставки.', {_PARTS}) END AS text
FROM (SELECT o_orderkey AS k, o_orderkey % 10 AS kind, 5 + (o_orderkey * 7919) % 76 AS n, 1 + (o_orderkey * 31) % 60 AS d, 1 + (o_orderkey * 17) % 30 AS w, 1 + o_orderkey % 9 AS m FROM orders) a
"""


def _of_orders(spark: SparkSession, sf_dir: str, sql: str, kept: dict[str, str] | None = None) -> DataFrame:
    """The SQL over the orders; columns of the orders can be kept beside their key under new names, so that none is joined back."""
    kept = kept or {}
    # Keys are dealt out before texts are made of them: work a row is much, bytes a row are few.
    keys = spread(table(spark, sf_dir, "orders").select("o_orderkey", *kept.values()))
    beside = "".join(f", {name}" for name in kept)
    inner = "".join(f", {column} AS {name}" for name, column in kept.items())
    sql = sql.replace("SELECT k,", f"SELECT k{beside},").replace("SELECT o_orderkey AS k FROM", f"SELECT o_orderkey AS k{inner} FROM")
    return spark.sql(sql.replace("FROM orders", "FROM {orders}"), orders=keys)


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus of one of ten kinds for each order, with the numbers in it."""
    return _of_orders(spark, sf_dir, MIXED_SQL)


def tenders(spark: SparkSession, sf_dir: str, only: DataFrame | None = None, kept: dict[str, str] | None = None) -> DataFrame:
    """A tender for each order, with columns of the order by new name; with `only`, which has a column k, for those orders alone."""
    if only is None:
        return _of_orders(spark, sf_dir, TENDER_SQL, kept)
    keys = table(spark, sf_dir, "orders").select("o_orderkey")
    keys = keys.join(only, keys["o_orderkey"] == only["k"], "left_semi")
    keys = keys.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_orderkey")
    return spark.sql(TENDER_SQL.replace("FROM orders", "FROM {orders}"), orders=keys)
