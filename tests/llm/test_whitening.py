"""Whitening against another eigensolver and exact integers."""

import math

import numpy as np
import pytest

from bidlens.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n int, component string, deviation string"


def table(spark, vectors, parts=3):
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], 1, "c", "d") for i, v in vectors]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def by_hand(vectors):
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, v in vectors], object)
    n, s = len(x), x.sum(0)
    y = (n * x - s).astype(float) / n
    values, u = np.linalg.eigh(y.T @ y / n)
    values, u = values[::-1][:8], u[:, ::-1][:, :8]
    return [int(sum(v * v for v in n * row - s)) for row in x], (y @ u) / np.sqrt(values), values / np.trace(y.T @ y / n)


def test_whitened_rows(spark):
    rng = np.random.default_rng(4)
    mixed = rng.normal(size=(700, 12)) @ np.diag(np.linspace(0.2, 3, 12)) @ rng.normal(size=(12, 12)) * 0.05
    vectors = [(k, v.astype(np.float32)) for k, v in enumerate(mixed)] + [(1000 + k, mixed[3].astype(np.float32)) for k in range(300)]
    broken = [(5000, None), (5001, []), (5002, [None] * 12), (5003, [math.nan] + [0.0] * 11), (5004, [math.inf] + [0.0] * 11), (5005, [1.0] * 11)]
    got = whitening.whiten(table(spark, vectors + broken)).collect()
    deviation, whitened, explained = by_hand(vectors)
    assert len(got) == 8 * len(vectors)
    rows = sorted(got, key=lambda r: (r.vec_id, r.component))
    assert [r.component for r in rows[:8]] == list(range(1, 9))
    mine = np.array([r.whitened for r in rows]).reshape(-1, 8)
    sign = np.sign((mine * whitened).sum(0))
    assert np.abs(mine * sign - whitened).max() < 1e-9
    assert [int(r.deviation) for r in rows[::8]] == deviation and {r.n for r in rows} == {1000}
    assert np.allclose([r.explained for r in rows[:8]], explained, rtol=1e-12)
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-9


def test_rank_below_eight_and_tables_without_result(spark):
    flat = [(k, [k % 7 / 8, k % 5 / 8, (k % 7 + k % 5) / 8, 0.5]) for k in range(70)]
    got = whitening.whiten(table(spark, flat)).collect()
    assert {r.component for r in got} == {1, 2} and len(got) == 140 and abs(sum({r.component: r.explained for r in got}.values()) - 1) < 1e-12
    for vectors in ([], [(1, [0.5, 0.5])], [(1, [0.5, 0.5])] * 9, [(1, None)], [(1, [])]):
        out = whitening.whiten(table(spark, vectors))
        assert out.count() == 0 and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitening.whiten(table(spark, [(None, [0.0, 1.0]), (None, [1.0, 0.0])])).count() == 2


def test_huge_entries(spark):
    # Beside the first entry the second is less than rounding, so there is one component.
    got = whitening.whiten(table(spark, [(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 2.0])])).collect()
    assert len(got) == 3 and all(math.isfinite(r.whitened) for r in got)
    x = np.array([[2**40 + 100_000, 100_000], [-(2**40) + 100_000, 101_024], [100_000, 102_048]], object)
    want = {k + 1: int(sum(v * v for v in 3 * row - x.sum(0))) for k, row in enumerate(x)}
    assert {r.vec_id: int(r.deviation) for r in got} == want


@pytest.mark.parametrize("size", [1, 2, 5, 33])
def test_cholesky_and_jacobi(size):
    rng = np.random.default_rng(size)
    a = rng.normal(size=(size, max(1, size - 2))) * 10.0 ** rng.integers(-6, 3, size=(1, max(1, size - 2)))
    v = a @ a.T
    factor = whitening.pivoted_cholesky(v)
    assert factor.shape[1] <= max(1, size - 2) + 1 and np.abs(factor @ factor.T - v).max() <= 1e-12 * np.trace(v)
    values, u = whitening.one_sided_jacobi(factor)
    assert np.allclose(u.T @ u, np.eye(len(values)), atol=1e-12)
    assert np.allclose(values, np.linalg.eigvalsh(v)[::-1][: len(values)], atol=1e-12 * np.trace(v))


def test_gram_of_large_integers_is_exact():
    rng = np.random.default_rng(0)
    y = rng.integers(-(2**41), 2**41, size=(700, 3))
    want = y.astype(object).T @ y.astype(object)
    assert (whitening.exact_gram(y) == want).all()
