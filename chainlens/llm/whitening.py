"""Whitening of embeddings by a pivoted Cholesky factor and one-sided Jacobi rotations (operator 12).

Vectors become whole numbers, ``floor(64 * c) + 1000000`` an entry, so counts,
sums and the scatter are exact whatever the order of addition.  The scatter of
the distinct vectors is centred before anything is multiplied: entries are
taken from the rounded mean, and what rounding left over is settled in whole
numbers.  Tasks send one partial sum for each pair of dimensions; what reaches
the driver is one number for each pair, whatever the number of rows.

On the driver the d x d scatter is factored as ``P L L' P'`` with the largest
remaining pivot first; the factor has a column for each pivot above rounding
error.  Plane rotations of pairs of columns of ``L`` then make all columns
orthogonal.  Their squared norms are the eigenvalues, the normalised columns,
with rows put back in place, the components.  Eigenvalues are found from the
factor itself, so small ones keep their relative accuracy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainlens.llm.common import staged

SCALE, SHIFT = 64, 1_000_000
#: Entries beyond this are taken as this, so that they fit a long.
LARGEST = 1 << 61
#: Bits of a limb: a product of two and the sum of 8,192 such are exact as doubles.
LIMB_BITS, LIMB_ROWS = 20, 1 << 13
MAX_COMPONENTS = 16


def as_matrix(column: pa.Array) -> np.ndarray:
    """Vectors of equal length, as a matrix of longs."""
    width = len(column[0]) if len(column) else 0
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def scaled(batch: pa.RecordBatch) -> pa.RecordBatch:
    """``id, x`` of the vectors without null or non-finite entries; empty vectors have no entries and go too."""
    ids, vectors = batch.columns
    sizes = np.nan_to_num(vectors.value_lengths().to_numpy(zero_copy_only=False), nan=0).astype(np.int64)
    flat = vectors.flatten()
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
    ends = np.cumsum(sizes)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    good = (sizes > 0) & (bad[ends] == bad[ends - sizes])
    taken = values[np.repeat(good, sizes)]
    whole = np.clip(np.floor(SCALE * taken), -LARGEST, LARGEST).astype(np.int64) + SHIFT
    offsets = np.concatenate([[0], np.cumsum(sizes[good])]).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [ids.filter(pa.array(good)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(whole))], names=["vec_id", "x"]
    )


def whole_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, x``: the vectors that take part, staged."""
    source = rows.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector"))
    id_type = source.schema["vec_id"].dataType.simpleString()

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield scaled(batch)

    vectors = staged(source.mapInArrow(convert, f"vec_id {id_type}, x array<long>"), "whole_vectors")
    # vectors of a length that is not the table's own take no part; a row per length reaches the driver
    lengths = vectors.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(2).collect()
    return vectors.where(F.size("x") == lengths[0]["d"]) if len(lengths) > 1 else vectors


def exact_products(centred: np.ndarray) -> np.ndarray:
    """``centred' @ centred`` of longs as Python whole numbers, by products of limbs that doubles hold exactly."""
    d = centred.shape[1]
    total = np.zeros((d, d), object)
    top = int(np.abs(centred).max(initial=0))
    limbs = max(1, -(-top.bit_length() // LIMB_BITS))
    sign, size = np.sign(centred), np.abs(centred)
    parts = [(sign * ((size >> (LIMB_BITS * k)) & ((1 << LIMB_BITS) - 1))).astype(float) for k in range(limbs)]
    for a in range(0, len(centred), LIMB_ROWS):
        for i, p in enumerate(parts):
            for j, q in enumerate(parts):
                product = (p[a : a + LIMB_ROWS].T @ q[a : a + LIMB_ROWS]).astype(np.int64)
                total += product.astype(object) << (LIMB_BITS * (i + j))
    return total


def _sums(fit: DataFrame) -> tuple[int, list[int]]:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, totals = 0, None
        for batch in batches:
            x = as_matrix(batch.column(0))
            if len(x):
                # halves of 32 bits, so that no sum of a batch can overflow
                part = ((x >> 32).sum(0).astype(object) << 32) + (x & 0xFFFFFFFF).sum(0).astype(object)
                n, totals = n + len(x), part if totals is None else totals + part
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(-1, len(totals)), pa.int32()), pa.array([str(n), *map(str, totals)])], names=["i", "total"]
            )

    rows = fit.mapInArrow(add, "i int, total string").groupBy("i").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    found = {r["i"]: int(r["total"]) for r in rows.collect()}
    return found.pop(-1, 0), [found[i] for i in range(len(found))]


def _scatter(fit: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """``n * n`` times the covariance, exactly."""
    centre = [(2 * s + n) // (2 * n) for s in sums]
    middle = np.array(centre, np.int64)
    d = len(sums)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((d, d), object)
        for batch in batches:
            if batch.num_rows:
                totals += exact_products(as_matrix(batch.column(0)) - middle)
        i, j = np.triu_indices(d)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(map(str, totals[i, j]))], names=["i", "j", "total"]
        )

    rows = fit.mapInArrow(add, "i int, j int, total string").groupBy("i", "j").agg(
        F.sum(F.col("total").cast("decimal(38,0)")).alias("total")
    )
    rest = [s - n * c for s, c in zip(sums, centre, strict=True)]
    out = np.zeros((d, d), object)
    for r in rows.collect():
        i, j = r["i"], r["j"]
        out[i, j] = out[j, i] = n * int(r["total"]) - rest[i] * rest[j]
    return out


def pivoted_cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(L, order)``: ``a[order][:, order] = L @ L.T`` with a column of ``L`` for each pivot above rounding error."""
    a = a.copy()
    d = len(a)
    order, factor = np.arange(d), np.zeros((d, d))
    least = d * np.finfo(float).eps * max(a.diagonal().max(initial=0.0), 0.0)
    for k in range(d):
        pivot = k + int(np.argmax(a.diagonal()[k:]))
        if not a[pivot, pivot] > least:
            return factor[:, :k], order
        swap, back = [k, pivot], [pivot, k]
        a[swap], order[swap], factor[swap] = a[back], order[back], factor[back]
        a[:, swap] = a[:, back]
        factor[k, k] = sqrt(a[k, k])
        factor[k + 1 :, k] = a[k + 1 :, k] / factor[k, k]
        a[k + 1 :, k + 1 :] -= np.outer(factor[k + 1 :, k], factor[k + 1 :, k])
    return factor, order


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """Rotate pairs of columns until all are orthogonal to rounding error."""
    u = np.asfortranarray(factor.copy())
    r = u.shape[1]
    tiny = np.finfo(float).eps
    for _ in range(sweeps):
        turned = False
        for p in range(r - 1):
            for q in range(p + 1, r):
                x, y = u[:, p], u[:, q]
                xx, yy, xy = x @ x, y @ y, x @ y
                if abs(xy) <= tiny * sqrt(xx * yy):
                    continue
                turned = True
                zeta = (yy - xx) / (2 * xy)
                t = (1 if zeta >= 0 else -1) / (abs(zeta) + sqrt(1 + zeta * zeta))
                c = 1 / sqrt(1 + t * t)
                u[:, p], u[:, q] = c * x - c * t * y, c * t * x + c * y
        if not turned:
            break
    return u


def principal_components(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues above rounding error, falling, and unit eigenvectors as columns; the entry of largest size is positive."""
    if not len(covariance):
        return np.zeros(0), np.zeros((0, 0))
    factor, order = pivoted_cholesky(covariance)
    turned = one_sided_jacobi(factor)
    norms = np.sqrt((turned * turned).sum(0))
    by_size = np.argsort(-norms, kind="stable")
    components = np.empty_like(turned)
    components[order] = turned / norms
    components = components[:, by_size]
    largest = np.abs(components).argmax(0)
    components *= np.where(components[largest, np.arange(len(by_size))] < 0, -1.0, 1.0)
    return norms[by_size] ** 2, components


@dataclass
class Whitening:
    """What a fit gives; ``components`` has a column for each eigenvalue kept."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    components: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``n * x - S`` as whole numbers: longs where they fit."""
        top = int(np.abs(x).max(initial=0)) * self.n + max(map(abs, self.sums), default=0)
        if top < 1 << 62:
            return x * self.n - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def apply(self, x: np.ndarray) -> np.ndarray:
        return (self.centred(x) / self.n).astype(float) @ (self.components / np.sqrt(self.eigenvalues))

    def deviation(self, x: np.ndarray) -> list[int]:
        away = self.centred(x)
        top = int(np.abs(away).max(initial=0))
        if away.dtype == object or top * top * max(1, x.shape[1]) >= 1 << 62:
            return (away.astype(object) ** 2).sum(1).tolist()
        return (away * away).sum(1).tolist()


def fit_whitening(vectors: DataFrame, most: int = MAX_COMPONENTS) -> Whitening:
    """Fit on each distinct vector of ``vectors(x)`` once; rows may repeat as often as they like."""
    # equal vectors are combined in the tasks that read them, so a very common one travels once a task
    fit = staged(vectors.select("x").distinct(), "distinct_vectors")
    n, sums = _sums(fit)
    if not n:
        return Whitening(0, [], np.zeros(0), np.zeros((0, 0)), np.zeros(0))
    scatter = _scatter(fit, n, sums)
    covariance = np.array([[float(Fraction(int(v), n * n)) for v in row] for row in scatter])
    values, components = principal_components(covariance)
    trace = float(Fraction(int(sum(scatter.diagonal())), n * n))
    kept = min(most, len(values))
    model = Whitening(n, sums, values[:kept], components[:, :kept], values[:kept] / trace if trace else values[:kept])
    model.identity_error = _identity_error(fit, model)
    return model


def _identity_error(fit: DataFrame, model: Whitening) -> float:
    """Largest entry of the covariance of the whitened fit list minus the identity, measured on the list."""
    k = len(model.eigenvalues)
    if not k:
        return 0.0
    i, j = np.triu_indices(k)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, square = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            if batch.num_rows:
                w = model.apply(as_matrix(batch.column(0)))
                total += w.sum(0)
                square += w.T @ w
        sums = np.concatenate([total, square[i, j]])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), pa.array(sums)], names=["slot", "total"])

    rows = fit.mapInArrow(add, "slot int, total double").groupBy("slot").agg(F.sum("total").alias("total"))
    found = {r["slot"]: r["total"] for r in rows.collect()}
    mean = [found[s] / model.n for s in range(k)]
    return max(
        abs(found[k + s] / model.n - mean[a] * mean[b] - (1.0 if a == b else 0.0)) for s, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True))
    )


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = MAX_COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``, a row per vector and component.

    Vectors that are null or empty or hold null or non-finite entries take no
    part, nor do those whose length is not the most common one (the longer, of
    two equally common).  A null or repeated id is a row like any other.
    Entries beyond 2^61 / 64 count as that; a deviation that is no long stops
    the job with an error.  Directions without variance above rounding error
    have no component, so vectors that are all equal, and an empty table, give
    no rows.
    """
    vectors = whole_vectors(rows, id_col, vector_col)
    model = fit_whitening(vectors, most)
    id_type = vectors.schema["vec_id"].dataType.simpleString()
    k = len(model.eigenvalues)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not k:
                continue
            x = as_matrix(batch.column(1))
            r = len(x)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(np.arange(r), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), r)),
                    pa.array(np.full(r * k, model.n)),
                    pa.array(model.deviation(x), pa.int64()).take(pa.array(np.repeat(np.arange(r), k))),
                    pa.array(model.apply(x).reshape(-1)),
                    pa.array(np.tile(model.explained, r)),
                    pa.array(np.full(r * k, model.identity_error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return vectors.mapInArrow(
        project,
        f"vec_id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double",
    )
