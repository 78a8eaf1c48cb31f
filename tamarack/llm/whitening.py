"""Whitening of embeddings by spectral divide and conquer.

Entries become whole numbers; the covariance is taken over the distinct vectors,
centred before it is multiplied, as partial sums of one matrix per task. On the
driver (a matrix of the vectors' length, nothing that grows with the rows) the
polar factor of the covariance minus a shift, found by the QR-based dynamically
weighted Halley iteration, gives the projectors on the subspaces above and below
the shift; each half is split again until single components are left. The first
few components and the mean then go to all tasks, which whiten every row.

Defined results: rows whose vector is null, empty or holds null or non-finite
entries are left out; vectors of each length are whitened for themselves;
repeated rows are whitened each for itself and count once in the fit; components
whose variance is nothing but rounding are left out, so a single distinct vector
gives no rows; equal eigenvalues give any orthonormal components of theirs,
the same for all rows; whole numbers beyond 64 bits are held at its ends, and a
deviation beyond 64 bits is null; an empty table gives an empty result; of the
columns only id and vector are read, so other names do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.session import stored

#: Entries are multiplied by this and rounded down; components returned.
SCALE, COMPONENTS = 256, 4
#: Eigenvalues up to this share of the trace are rounding.
ROUNDING = 1e-12

_EPS = float(np.finfo(float).eps)
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


# --- spectral divide and conquer ---------------------------------------------------------


def polar_factor(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix: its sign. QDWH in its QR form, from the smallest lower bound."""
    m = len(a)
    x, low = a / np.linalg.norm(a), _EPS
    for _ in range(30):
        d = np.cbrt(4 * (1 - low**2) / low**4)
        h = np.sqrt(1 + d) + np.sqrt(8 - 4 * d + 8 * (2 - low**2) / (low**2 * np.sqrt(1 + d))) / 2
        p, q = (h - 1) ** 2 / 4, h + (h - 1) ** 2 / 4 - 1
        both = np.linalg.qr(np.vstack([np.sqrt(q) * x, np.eye(m)]))[0]
        new = p / q * x + (h - p / q) / np.sqrt(q) * both[:m] @ both[m:].T
        new = (new + new.T) / 2
        low, moved, x = min(1.0, low * (h + p * low**2) / (1 + q * low**2)), np.linalg.norm(new - x), new
        if abs(1 - low) < 10 * _EPS and moved < np.cbrt(_EPS):
            break
    return x


def _halves(a: np.ndarray, shift: float) -> tuple[np.ndarray, int]:
    """An orthonormal basis whose first columns span the subspace above the shift, and their number."""
    m = len(a)
    above = (polar_factor(a - shift * np.eye(m)) + np.eye(m)) / 2
    k = int(round(np.trace(above)))
    if not 0 < k < m:
        return np.eye(m), k
    start = np.random.default_rng(m).standard_normal((m, k))
    basis = np.linalg.qr(above @ np.linalg.qr(above @ start)[0])[0]
    return np.linalg.qr(np.hstack([basis, np.eye(m) - basis @ basis.T]))[0][:, :m], k


def components_of(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All eigenvalues and, as columns, unit eigenvectors of a symmetric matrix, largest first."""
    whole = np.linalg.norm(a)

    def split(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m = len(part)
        mean = np.trace(part) / m
        if m == 1 or np.linalg.norm(part - mean * np.eye(m)) <= 4 * _EPS * whole:
            return np.diag(part).copy(), np.eye(m)
        for shift in (float(np.median(np.diag(part))), mean, mean * (1 + 1e-3) + 1e-3 * _EPS * whole, mean * (1 - 1e-3)):
            basis, k = _halves(part, shift)
            turned = basis.T @ part @ basis
            if 0 < k < m and np.linalg.norm(turned[k:, :k]) <= 1e3 * m * _EPS * whole:
                break
        else:  # the shifts hit eigenvalues: a plain rotation of the largest entry outside the diagonal, then on
            off = np.abs(np.triu(part, 1))
            i, j = np.unravel_index(np.argmax(off), off.shape)
            angle = np.arctan2(2 * part[i, j], part[i, i] - part[j, j]) / 2
            turn = np.eye(m)
            turn[[i, i, j, j], [i, j, i, j]] = np.cos(angle), -np.sin(angle), np.sin(angle), np.cos(angle)
            values, vectors = split(turn.T @ part @ turn)
            return values, turn @ vectors
        turned = (turned + turned.T) / 2
        parts = [(basis[:, own], split(turned[own, own])) for own in (slice(0, k), slice(k, m))]
        return np.concatenate([v for _, (v, _) in parts]), np.hstack([b @ w for b, (_, w) in parts])

    values, vectors = split((a + a.T) / 2)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


# --- over the table ----------------------------------------------------------------------


class Whitening(NamedTuple):
    """What all tasks get: sums and number of the distinct vectors, and a column per component."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float


def whole_vectors(rows: DataFrame, id_column: str, vector_column: str, scale: int = SCALE) -> DataFrame:
    """``vec_id`` and ``x`` (whole numbers) of the rows that take part."""
    vector = F.col(vector_column).cast("array<double>")
    proper = F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False)))
    kept = rows.filter(vector.isNotNull() & (F.size(vector) > 0) & proper)
    # held at the ends of 64 bits before the cast
    x = F.transform(vector, lambda c: F.floor(F.least(F.greatest(c * scale, F.lit(-9.2e18)), F.lit(9.2e18))).cast("long"))
    return kept.select(F.col(id_column).cast("long").alias("vec_id"), x.alias("x"))


def _sums(fit: DataFrame, size: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sums per dimension."""
    total = [F.sum(F.col("x")[i].cast("decimal(38,0)")) for i in range(size)]
    found = fit.agg(F.count("*"), *total).first()
    return found[0], [int(s) for s in found[1:]]


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n with one rounding for the mean's whole part and one for the rest."""
    whole = np.array([s // n for s in sums], object)
    rest = np.array([(s % n) / n for s in sums])
    if np.abs(x).max(initial=0) < 1 << 61 and max(map(abs, whole), default=0) < 1 << 61:
        return (x - whole.astype(np.int64)).astype(float) - rest
    return (x.astype(object) - whole).astype(float) - rest


def _matrix(x: pa.Array, size: int) -> np.ndarray:
    return x.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def scatter(fit: DataFrame, n: int, sums: list[int], columns: np.ndarray) -> np.ndarray:
    """Covariance of the centred vectors times ``columns``, divisor n: a matrix per task, added up by entry."""
    size, width = columns.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            y = _centred(_matrix(batch.column(0), size), n, sums) @ columns
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(range(width * width), pa.int32()), pa.array(total.ravel())], ["entry", "value"])

    entries = fit.select("x").mapInArrow(partial, "entry int, value double").groupBy("entry").agg(F.sum("value").alias("value"))
    out = np.zeros(width * width)
    for entry, value in entries.collect():  # width * width numbers, whatever the input
        out[entry] = value
    return out.reshape(width, width) / n


def fitted(fit: DataFrame, size: int, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of distinct vectors ``x`` of one length."""
    n, sums = _sums(fit, size)
    covariance = scatter(fit, n, sums, np.eye(size))
    trace = float(np.trace(covariance))
    if not trace > 0:
        return None
    values, vectors = components_of(covariance)
    kept = int((values[:components] > ROUNDING * trace).sum())
    return Whitening(n, sums, vectors[:, :kept], values[:kept], trace)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum of (n x - S)^2, exact; plain 64-bit arithmetic where it suffices."""
    most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) * n + max(map(abs, sums))
    if most**2 * x.shape[1] < 1 << 63:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    totals = ((n * x.astype(object) - np.array(sums, object)) ** 2).sum(axis=1)
    return [t if t < 1 << 63 else None for t in totals]


def _whitened(rows: DataFrame, size: int, model: Whitening, error: float) -> DataFrame:
    columns, share = model.components / np.sqrt(model.eigenvalues), model.eigenvalues / model.trace
    k = len(share)

    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = batch.column(0), _matrix(batch.column(1), size)
            y = _centred(x, model.n, model.sums) @ columns
            many = len(x)
            row = pa.array(np.repeat(np.arange(many), k))
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(row),
                    pa.array(np.tile(np.arange(1, k + 1), many), pa.int32()),
                    pa.array(np.full(many * k, model.n), pa.int64()),
                    pa.array(_deviations(x, model.n, model.sums), pa.int64()).take(row),
                    pa.array(y.ravel()),
                    pa.array(np.tile(share, many)),
                    pa.array(np.full(many * k, error)),
                ],
                [field.split()[0] for field in SCHEMA.split(", ")],
            )

    return rows.mapInArrow(whiten, SCHEMA)


def whitened(
    embeddings: DataFrame,
    components: int = COMPONENTS,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    scale: int = SCALE,
) -> DataFrame:
    """A row per vector and component: see ``SCHEMA``."""
    rows = whole_vectors(embeddings, id_column, vector_column, scale)
    fit = stored(rows.select("x").distinct(), "whiten-fit")
    size: Column = F.size("x")
    found = []
    for (length,) in fit.select(size.alias("length")).distinct().orderBy("length").collect():  # a row per vector length
        own = fit.filter(size == length)
        model = fitted(own, length, components)
        if model is None or not len(model.eigenvalues):
            continue
        identity = scatter(own, model.n, model.sums, model.components / np.sqrt(model.eigenvalues))
        error = float(np.abs(identity - np.eye(len(identity))).max())
        found.append(_whitened(rows.filter(size == length), length, model, error))
    if not found:
        return embeddings.sparkSession.createDataFrame([], SCHEMA)
    return reduce(DataFrame.unionByName, found)
