"""Words are found by parting the text at them, and a text is normalised once for all its sections."""

import pytest
from pyspark.sql import functions as F

from bidlens.functions import text as T
from bidlens.operators import retrieval as V


@pytest.mark.parametrize("word", ["а", "аа", ".*", r"\E", r"\Q", r"a\Eb", "￿", "$0", "нет", ""])
def test_find_word_takes_a_word_as_it_is(spark, word):
    texts = ["", "аааа", r"\E.*\Qa\Eb.*", "￿а￿￿", "$0 нет $0", "\U0001f600а.*"]
    want = []
    for text in texts:
        at, found = text.find(word) if word else -1, []
        while at >= 0:
            found.append(at)
            at = text.find(word, at + len(word))
        want.append(found)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    got = df.select("i", T.find_word(F.col("t"), word).alias("one"), T.find_word(F.col("t"), F.lit(word)).alias("two")).orderBy("i").collect()
    assert [r.one for r in got] == [r.two for r in got] == want


def test_context_normalises_once(spark):
    plan = spark.range(1).select(V.context(F.concat(F.lit("Оплата "), F.col("id").cast("string"))).alias("t"))._jdf.queryExecution().optimizedPlan().toString()
    # The letter is exchanged once, not once a section.
    assert plan.count("ё") == 1
