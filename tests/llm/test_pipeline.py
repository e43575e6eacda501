"""The corpus pipeline over a small folder: planted cases go, clean documents stay."""

import random

import corpus_pipeline

from tests.llm.test_operators import prose


def test_pipeline(spark, tmp_path):
    rng = random.Random(3)
    item = prose(900, 30)
    rows = [(i, prose(i, 80)) for i in range(200)]
    rows += [(300, rows[5][1]), (301, rows[6][1] + " extra"), (302, prose(400, 60) + " " + item), (303, prose(401, 60) + " vile scoundrel")]
    labelled = [(1000 + i, prose(1000 + i, 30) + (" vile scoundrel" if i % 3 == 0 else "")) for i in range(300)]
    labels = [(i, 1, int(i % 3 == 1)) for i, _ in labelled]
    assert [t for i, t in labelled if "vile" in t and (i % 3 == 1)]
    every = rows + labelled
    rng.shuffle(every)
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in every], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().collect()}
    assert set(range(200)) <= kept
    assert not kept & {300, 301, 302, 303}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "packing"]
