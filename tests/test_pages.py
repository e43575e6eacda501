"""Pages cut from a document's words without a shuffle."""

from pyspark.sql import functions as F

import __spark_entry__
from bidlens.operators import layout as L


def test_pages_need_no_shuffle(spark):
    plan = __spark_entry__.queries()["pdf_rows_text"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan


def test_pages_hold_the_words_laid_out(spark):
    texts = [None, "", " ", "a", " a b ", " ".join(f"w{i}" for i in range(400)), " ".join(f"w{i}" * (i % 7) for i in range(401)), " ".join(f"w{i}" for i in range(1000))]
    docs = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "doc_id long, text string")
    words = L.layout_words(docs)
    one = sorted(map(tuple, L.page_texts(words).collect()))
    assert one == sorted(map(tuple, L.texts_of_pages(L.layout_pages(docs)).collect()))
    placed = L.layout_pages(docs).select("doc_id", "page", F.explode("words").alias("w")).select("doc_id", "page", "w.*")
    assert sorted(map(tuple, placed.collect())) == sorted(map(tuple, words.select(*placed.columns).collect()))
