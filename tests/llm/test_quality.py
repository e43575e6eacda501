"""Quality: statistics and trees by hand, held-out accuracy, awkward tables."""

import random
import zlib

import numpy as np
import pyarrow as pa

from bidlens.llm import quality

SCHEMA = "doc_id long, text string, score double, quality int, x string"
VOCAB = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in ("n", "r", "st", "é")]


def sentence(rng, n):
    return " ".join(rng.choice(VOCAB) for _ in range(n)).capitalize() + "."


def good(rng):
    return "\n".join(sentence(rng, rng.randrange(4, 20)) for _ in range(rng.randrange(1, 20)))


def bad(rng):
    kind = rng.randrange(3)
    if kind == 0:
        return good(rng).upper().replace(" ", "!! ")
    if kind == 1:
        return good(rng) + "\n" + f"{rng.choice(VOCAB)} " * rng.randrange(40, 80)
    return " | ".join(rng.choice(VOCAB) + rng.choice(["###", "&&&", ""]) for _ in range(80))


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_held_out_accuracy_and_no_leak(spark):
    rng = random.Random(5)
    rows = [(i, (good if i % 4 else bad)(rng), 0.0, 9, "x") for i in range(1500)] + [(None, good(rng), 0.0, 9, "x")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(1500)], "doc_id long, quality int")
    got = quality.rate_quality(df, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and held(r.doc_id)) for r in got)
    out = [r for r in got if r.held_out]
    assert np.mean([r.predicted == int(r.doc_id % 4 > 0) for r in out]) > 0.97
    # Labels of the fold held out may say anything.
    other = spark.createDataFrame([(i, int((i % 4 > 0) ^ held(i))) for i in range(1500)], "doc_id long, quality int")
    assert {(r.doc_id, r.score) for r in quality.rate_quality(df, other).collect()} == {(r.doc_id, r.score) for r in got}


def test_awkward_tables(spark):
    rows = [(1, None), (1, None), (2, ""), (3, " \n\t "), (4, "😀" * 10), (5, "x" * 2_500_000), (None, "a b"), (6, "\n\nline\n")]
    df = spark.createDataFrame([(i, t, 0.0, 9, "x") for i, t in rows], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.rate_quality(df, none).collect()} == {0.5}
    odd = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (3, 1), (77, 1)], "doc_id long, quality int")
    got = quality.rate_quality(df, odd).collect()
    assert len(got) == len(rows) and quality.rate_quality(df.limit(0), odd).count() == 0


def test_statistics_of_a_text_do_not_depend_on_its_neighbours():
    rng = random.Random(2)
    texts = [good(rng), "", bad(rng), " \n ", "AB ab 12 12 12!\n\nAB ab", (good(rng) + "\n") * 4000, bad(rng), None]
    together = quality.statistics(pa.array(texts))
    alone = np.vstack([quality.statistics(pa.array([t], pa.string())) for t in texts])
    assert len(texts[5].encode()) > quality.PART and (together == alone).all()
    sums, worst = quality._measure(np.frombuffer(b"AB ab 12 12 12!\n\nAB ab", np.uint8), np.array([0, 22]))
    named = dict(zip(quality._SUMS, sums[0, len(quality._CLASSES) :], strict=True))
    want = {"bytes": 22, "words": 7, "word_bytes": 15, "word_squares": 33, "short": 7, "long": 0, "shouted": 2, "bare": 3, "echoes": 3, "distinct": 3, "lines": 2, "distinct_lines": 2, "capital_lines": 2, "ended_lines": 1}
    assert named == want
    assert dict(zip(quality._WORST, worst[0], strict=True)) == {"upper": 4 / 22, "loud": 1 / 22, "symbol": 0, "bar": 0, "digit": 6 / 22, "echo": 3 / 7, "repeat": 1 - 3 / 7, "bare": 3 / 7}


def test_flat_trees_against_walking_each_one():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 5))
    x[:, 4] = 1.0  # a statistic that never varies is never split on
    label = ((x[:, 0] > 0.2) ^ (x[:, 1] > 0)).astype(float)
    forest = quality.fit(x, label, trees=12, depth=3)
    for row, score in zip(x[:50], quality.probability(x[:50], forest), strict=True):
        margin = forest.base
        for t in range(12):
            k = 0
            while k < 7:
                k = 2 * k + (2 if row[forest.feature[t, k]] > forest.threshold[t, k] else 1)
            margin += forest.leaf[t, k - 7]
        assert abs(score - 1 / (1 + np.exp(-margin))) < 1e-12
    assert ((quality.probability(x, forest) >= 0.5) == label).mean() > 0.95
    assert not ((forest.feature == 4) & np.isfinite(forest.threshold)).any()
