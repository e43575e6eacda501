"""Embedding whitening: pivoted Cholesky of the centred scatter, one-sided Jacobi on its factor.

Entries become integers, so counts, sums and the scatter are exact, whatever the order in which tasks
add them up. Two aggregations over all rows give the covariance, a dimensions x dimensions matrix that
the driver decomposes; a third measures the whitened rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: An entry c counts as floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Scaled entries beyond this count as this, so that all sums fit in 38 digits.
LARGEST = 1 << 40
#: Rows of vectors that are worked on at once.
ROWS = 1024
_EXACT = 1 << 53


class Whitener(NamedTuple):
    """n rows, the integer centre and the remainder of their sum, components as columns, eigenvalues, trace."""

    n: int
    centre: np.ndarray
    rest: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float


def integers(column: pa.Array, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors count (whole, finite, of so many dimensions), and their entries as integers."""
    kept = np.zeros(len(column), bool)
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    some = np.flatnonzero(sizes == dimensions)
    values = column.take(pa.array(some)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(some), dimensions)
    whole = np.isfinite(values).all(axis=1)
    kept[some[whole]] = True
    with np.errstate(over="ignore"):
        scaled = np.floor(SCALE * values[whole])
    return kept, np.clip(scaled, -LARGEST, LARGEST).astype(np.int64) + SHIFT


def exact_gram(y: np.ndarray) -> np.ndarray:
    """y.T @ y as Python integers. Floats are multiplied where no sum can pass 2^53; larger numbers are split in two."""
    most = int(np.abs(y).max()) if y.size else 0
    if most * most * len(y) < _EXACT:
        z = y.astype(float)
        return (z.T @ z).astype(np.int64).astype(object)
    if len(y) > 256:
        return exact_gram(y[:256]) + exact_gram(y[256:])
    high = y >> 21
    low = (y - (high << 21)).astype(float)
    high = high.astype(float)
    both = (high.T @ low).astype(np.int64).astype(object)
    return ((high.T @ high).astype(np.int64).astype(object) << 42) + ((both + both.T) << 21) + (low.T @ low).astype(np.int64).astype(object)


def _blocks(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    for batch in batches:
        for k in range(0, len(batch), ROWS):
            part = batch.slice(k, ROWS)
            yield part, part.column(at)


def dimension_sums(vectors: DataFrame) -> DataFrame:
    """Rows size, place, n, total: by length of vector, how many count and the exact sum of each entry."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for _, column in _blocks(batches, 0):
            for size in np.unique(column.value_lengths().drop_null().to_numpy()):
                kept, x = integers(column, int(size))
                if kept.any():
                    one = found.setdefault(int(size), [0, 0])
                    one[0] += int(kept.sum())
                    one[1] = one[1] + x.sum(axis=0).astype(object)  # ROWS entries up to 2^41 fit in 64 bits
        for size, (n, total) in found.items():
            places = max(size, 1)
            total = total if size else np.array([0], object)
            yield pa.RecordBatch.from_arrays([pa.array([size] * places, pa.int32()), pa.array(range(places), pa.int32()), pa.array([n] * places, pa.int64()), pa.array([str(v) for v in total])], ["size", "place", "n", "total"])

    rows = vectors.mapInArrow(add, "size int, place int, n long, total string")
    return rows.groupBy("size", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).cast("string").alias("total"))


def scatter(vectors: DataFrame, centre: np.ndarray) -> np.ndarray:
    """The exact sum over all rows of (x - centre)(x - centre)^T, as Python integers."""
    size = len(centre)
    sent = vectors.sparkSession.sparkContext.broadcast(centre)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, column in _blocks(batches, 0):
            kept, x = integers(column, size)
            if kept.any():
                more = exact_gram(x - sent.value)
                total = more if total is None else total + more
        if total is not None:
            a, b = np.triu_indices(size)
            yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array([str(v) for v in total[a, b]])], ["a", "b", "total"])

    rows = vectors.mapInArrow(add, "a int, b int, total string")
    cells = rows.groupBy("a", "b").agg(F.sum(F.col("total").cast("decimal(38,0)")).cast("string").alias("total")).toArrow()
    out = np.zeros((size, size), object)
    for a, b, value in zip(*(cells[name].to_pylist() for name in ("a", "b", "total")), strict=True):
        out[a, b] = out[b, a] = int(value)
    return out


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """L with v = L L^T, its rows in v's order; columns stop where nothing but rounding is left."""
    size = len(v)
    rest, factor = v.copy(), np.zeros((size, size))
    least = max(np.diag(v).max(initial=0.0), 0.0) * size * np.finfo(float).eps
    for k in range(size):
        pivot = int(np.diag(rest).argmax())
        if rest[pivot, pivot] <= least:
            return factor[:, :k]
        factor[:, k] = rest[:, pivot] / np.sqrt(rest[pivot, pivot])
        rest = rest - np.outer(factor[:, k], factor[:, k])
        rest[pivot] = rest[:, pivot] = 0.0
    return factor


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of factor @ factor.T.

    Columns are rotated in pairs until all are orthogonal: then a column's squared norm is an
    eigenvalue and the column itself, normalised, a component. In a round all columns are paired at
    once, like players of a tournament, so a round is a few operations on whole arrays.
    """
    u = factor.copy()
    columns = u.shape[1]
    players = list(range(columns + columns % 2))
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(len(players) - 1):
            half = len(players) // 2
            pairs = [(min(a, b), max(a, b)) for a, b in zip(players[:half], players[half:][::-1], strict=True) if max(a, b) < columns]
            if pairs:
                a, b = (np.array(x) for x in zip(*pairs, strict=True))
                one, two = u[:, a], u[:, b]
                aa, bb, ab = (one**2).sum(0), (two**2).sum(0), (one * two).sum(0)
                near = np.abs(ab) / np.maximum(np.sqrt(aa * bb), np.finfo(float).tiny)
                worst = max(worst, float(near.max()))
                turn = near > 1e-16
                with np.errstate(divide="ignore", invalid="ignore"):
                    zeta = np.where(turn, (bb - aa) / (2 * ab), 0.0)
                    t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
                t = np.where(turn, t, 0.0)
                c = 1 / np.hypot(1.0, t)
                s = c * t
                u[:, a], u[:, b] = c * one - s * two, s * one + c * two
            players = [players[0], players[-1], *players[1:-1]]
        if worst < 4 * np.finfo(float).eps:
            break
    norms = np.sqrt((u**2).sum(0))
    order = np.argsort(-norms, kind="stable")
    order = order[norms[order] > 0]
    return norms[order] ** 2, u[:, order] / norms[order]


def fit(vectors: DataFrame, most_components: int = 8) -> Whitener | None:
    """The whitener of a one-column table of vectors; None if no vector counts.

    Vectors are centred on the nearest integer to their mean before they are multiplied; what is left,
    under half a unit, is taken off in exact arithmetic.
    """
    sums = dimension_sums(vectors).persist()
    try:
        most = sums.filter("place = 0").orderBy(F.desc("n"), F.desc("size")).first()
        if most is None or most["size"] == 0:
            return None
        n, size = int(most["n"]), int(most["size"])
        rows = sums.filter(F.col("size") == size).orderBy("place").toArrow()
    finally:
        sums.unpersist()
    total = np.array([int(v) for v in rows["total"].to_pylist()], object)
    centre = np.array([(2 * int(v) + n) // (2 * n) for v in total], np.int64)
    rest = total - n * centre.astype(object)
    # n^2 times the covariance, exactly; each entry is rounded once, when it becomes a float.
    exact = n * scatter(vectors, centre) - np.outer(rest, rest)
    v = np.array([[int(x) / (n * n) for x in row] for row in exact], float)
    trace = float(np.trace(v))
    values, components = one_sided_jacobi(pivoted_cholesky(v))
    values, components = values[:most_components], components[:, :most_components]
    return Whitener(n, centre, np.array([int(x) for x in rest], np.int64), components, values, trace)


def _project(x: np.ndarray, model: Whitener) -> np.ndarray:
    return (((x - model.centre) - model.rest / model.n) @ model.components) / np.sqrt(model.eigenvalues)


def _deviations(x: np.ndarray, model: Whitener) -> list[int]:
    """Exact sums over the dimensions of (n x - S)^2."""
    d = x - model.centre
    most = model.n * (int(np.abs(d).max(initial=0)) + 1)
    if most * most * d.shape[1] < 1 << 62:
        return ((model.n * d - model.rest) ** 2).sum(axis=1).tolist()
    return [sum(v * v for v in row) for row in (model.n * d.astype(object) - model.rest.astype(object)).tolist()]


def identity_error(vectors: DataFrame, model: Whitener) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity, measured over all rows."""
    k = len(model.eigenvalues)
    sent = vectors.sparkSession.sparkContext.broadcast(model)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k + 1))
        for _, column in _blocks(batches, 0):
            w = _project(integers(column, len(model.centre))[1], sent.value)
            w = np.column_stack([w, np.ones(len(w))])
            total += w.T @ w
        a, b = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(a.ravel().astype(np.int32)), pa.array(b.ravel().astype(np.int32)), pa.array(total.ravel())], ["a", "b", "total"])

    cells = vectors.mapInArrow(add, "a int, b int, total double").groupBy("a", "b").agg(F.sum("total").alias("total")).toArrow()
    total = np.zeros((k + 1, k + 1))
    total[cells["a"].to_numpy(), cells["b"].to_numpy()] = cells["total"].to_numpy()
    mean = total[:k, k] / model.n
    return float(np.abs(total[:k, :k] / model.n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(docs: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most_components: int = 8) -> DataFrame:
    """One row per vector that counts and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Null vectors and those with null or non-finite entries don't count. Neither do vectors of another
    length than most have (of lengths equally frequent the larger counts): they share no covariance.
    Components number from 1 by falling eigenvalue, up to the rank that doubles show: with one vector, or
    equal ones only, there are none and so no rows, as with an empty table. Repeated rows count and appear
    each time; ids may be null. `deviation` is decimal(38,0), null beyond that. An entry that scales beyond
    2^40 counts as 2^40.
    """
    vectors = docs.select(F.col(vector_col).cast("array<double>").alias("vector"))
    kind = docs.select(F.col(id_col).alias("vec_id")).schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation string, whitened double, explained double, identity_error double"
    model = fit(vectors, most_components)
    as_decimal = F.expr("try_cast(deviation AS decimal(38,0))").alias("deviation")
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    if model is None or not len(model.eigenvalues):
        return docs.sparkSession.createDataFrame([], schema).select(*(as_decimal if name == "deviation" else name for name in names))
    error = identity_error(vectors, model)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    k, explained = len(model.eigenvalues), model.eigenvalues / model.trace

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, column in _blocks(batches, 1):
            kept, x = integers(column, len(sent.value.centre))
            many = len(x)
            which = pa.array(np.repeat(np.flatnonzero(kept), k))
            deviation = pa.array([str(v) for v in _deviations(x, sent.value)], pa.string()).take(pa.array(np.repeat(np.arange(many), k)))
            columns = [batch.column(0).take(which), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), many)), pa.array(np.full(many * k, sent.value.n)), deviation]
            columns += [pa.array(_project(x, sent.value).ravel()), pa.array(np.tile(explained, many)), pa.array(np.full(many * k, error))]
            yield pa.RecordBatch.from_arrays(columns, names)

    out = docs.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")).mapInArrow(rows, schema)
    return out.select(*(as_decimal if name == "deviation" else name for name in names))
