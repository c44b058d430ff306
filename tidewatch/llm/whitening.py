"""Embedding whitening: exact covariances by digit-slice GEMM, then an eigendecomposition.

Components become integers. Sums are made exactly, and all vectors are moved by the floored means, which are integers
too. Moved vectors are split into limbs of LIMB bits, so that the float64 products of two limb matrices of ROWS rows
stay below 2 ** 53 and BLAS adds them up without rounding. Products of limbs are put together as big integers, a row of
them per task, and merged by Spark's sums in two halves of 64 bits. What the floored mean leaves over is then taken
off exactly. Only the finished covariance is rounded: nothing is lost to the offset or to the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import vectors as vec
from tidewatch.llm.common import bounded_batches, written

#: 2 ** (2 * (LIMB - 1)) * ROWS stays below 2 ** 53, with limbs between -2 ** (LIMB - 1) and 2 ** (LIMB - 1).
LIMB, ROWS = 20, 8192
#: Up to so many dimensions eigenvectors are found by Jacobi's rotations in extended precision.
JACOBI_DIMS = 256
#: Eigenvalues up to here of the largest one are zero but for rounding.
ZERO = 1e-17
_SUMS = pa.list_(pa.decimal128(38, 0))


def limbs(y: np.ndarray) -> list[np.ndarray]:
    """Signed digits of 64-bit integers to the base 2 ** LIMB, lowest first, as doubles; as many as the largest needs."""
    out = []
    while not out or y.any():
        low = ((y + (1 << (LIMB - 1))) & ((1 << LIMB) - 1)) - (1 << (LIMB - 1))
        out.append(low.astype(np.float64))
        y = (y - low) >> LIMB
    return out


def products(y: np.ndarray) -> np.ndarray:
    """y.T @ y as Python integers, for rows of 64-bit integers below 2 ** 62."""
    total = np.zeros((y.shape[1], y.shape[1]), dtype=object)
    for at in range(0, len(y), ROWS):
        digits = limbs(y[at : at + ROWS])
        for i, a in enumerate(digits):
            for j, b in enumerate(digits[: i + 1]):
                whole = (a.T @ b).astype(np.int64).astype(object)
                total += (whole if i == j else whole + whole.T) << (LIMB * (i + j))
    return total


def _decimals(values: list[int]) -> pa.Array:
    return pa.array([[Decimal(v) for v in values]], _SUMS)


def summed(kept: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Number of vectors, and the exact sum of each dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dims, dtype=object)
        for batch in batches:
            x = vec.unpacked(batch.column("x"), "<i8", dims)
            n += len(x)
            total += (x >> 32).sum(axis=0).astype(object) * (1 << 32) + (x & 0xFFFFFFFF).sum(axis=0).astype(object)
        yield pa.RecordBatch.from_arrays([_decimals([n, *total])], ["sums"])

    flat = _merged(kept.select("x").mapInArrow(add, "sums array<decimal(38,0)>"), dims + 1)
    return flat[0], flat[1:]


def _merged(partial: DataFrame, size: int) -> list[int]:
    """Sums over all tasks of the numbers at each place: `size` rows return."""
    out = [0] * size
    for r in partial.select(F.posexplode("sums").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[r["at"]] = int(r["v"])
    return out


def scatter(kept: DataFrame, dims: int, n: int, sums: list[int]) -> list[list[int]]:
    """n * n times the covariance, exactly: n * (sum of products of moved vectors) - products of what is left of the sums."""
    means = [s // n for s in sums]
    shared = kept.sparkSession.sparkContext.broadcast(np.array(means, dtype=np.int64))  # dims
    upper = np.triu_indices(dims)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims), dtype=object)
        for batch in batches:
            total += products(vec.unpacked(batch.column("x"), "<i8", dims) - shared.value)
        flat = total[upper].tolist()
        yield pa.RecordBatch.from_arrays([_decimals([v >> 64 for v in flat] + [v & ((1 << 64) - 1) for v in flat])], ["sums"])

    flat = _merged(kept.select("x").mapInArrow(add, "sums array<decimal(38,0)>"), 2 * len(upper[0]))
    half, left = len(upper[0]), [s - n * m for s, m in zip(sums, means, strict=True)]
    out = [[0] * dims for _ in range(dims)]
    for i, j, high, low in zip(*upper, flat[:half], flat[half:], strict=True):
        out[i][j] = out[j][i] = n * ((high << 64) + low) - left[i] * left[j]
    return out


def eigen(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix in extended precision.

    Jacobi's rotations, dims / 2 of them at once, keep small eigenvalues apart from large ones better than a
    decomposition of the rounded matrix would.
    """
    dims = len(covariance)
    if dims > JACOBI_DIMS:
        e, v = np.linalg.eigh(covariance.astype(np.float64))
    else:
        a, v = covariance.copy(), np.eye(dims, dtype=covariance.dtype)
        ring = list(range(dims + dims % 2))
        for _ in range(30):
            turned = False
            for _ in range(len(ring) - 1):
                pairs = [(min(p, q), max(p, q)) for p, q in zip(ring[: len(ring) // 2], ring[: len(ring) // 2 - 1 : -1], strict=True) if max(p, q) < dims]
                ring = [ring[0], ring[-1], *ring[1:-1]]
                p, q = np.array(pairs, dtype=np.int64).reshape(-1, 2).T
                apq, app, aqq = a[p, q], a[p, p], a[q, q]
                on = np.abs(apq) > np.finfo(a.dtype).eps * np.sqrt(np.abs(app * aqq))
                if not on.any():
                    continue
                turned, p, q, apq, app, aqq = True, p[on], q[on], apq[on], app[on], aqq[on]
                theta = (aqq - app) / (2 * apq)
                t = np.where(theta < 0, -1, 1) / (np.abs(theta) + np.hypot(theta, 1))
                c = 1 / np.hypot(t, 1)
                s = t * c
                for m in (a, v):
                    left, right = m[:, p].copy(), m[:, q].copy()
                    m[:, p], m[:, q] = c * left - s * right, s * left + c * right
                top, low = a[p, :].copy(), a[q, :].copy()
                a[p, :], a[q, :] = c[:, None] * top - s[:, None] * low, s[:, None] * top + c[:, None] * low
                a[p, q] = a[q, p] = 0
            if not turned:
                break
        e = np.diag(a)
    order = np.argsort(-e, kind="stable")
    return e[order].astype(np.float64), v[:, order].astype(np.float64)


def extended(v: Fraction) -> np.longdouble:
    high = float(v)
    return np.longdouble(high) + np.longdouble(float(v - Fraction(high)))


def deviations(y: np.ndarray, n: int, left: list[int]) -> pa.Array:
    """Sum over dimensions of (n * y - left) ** 2, exactly; null where 64 bits don't hold it. y: vectors moved by the floored means."""
    most = n * (int(np.abs(y).max(initial=0)) + 1)
    if max(1, y.shape[1]) * most * most < 1 << 62:
        z = n * y - np.array(left, dtype=np.int64)
        return pa.array((z * z).sum(axis=1))
    z = n * y.astype(object) - np.array(left, dtype=object)
    return pa.array([int(d) if d < 1 << 63 else None for d in (z * z).sum(axis=1)], pa.int64())


def whiten(vectors: DataFrame, scale: int = 64, offset: int = 1_000_000, components: int = 32, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """For each usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null, empty, hold null or non-finite components, components of 2 ** 61 / scale or more, or are of another than
    the most common length (the longer of two as common) have no rows. There are as many components as dimensions, up
    to `components`. Along a component without variance whitened is 0; such components don't count for
    identity_error. A deviation beyond 64 bits is null. Repeated rows count each for itself, a null vec_id stays
    null, extra columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    none = spark.createDataFrame([], schema)
    dims = vec.common_length(vectors, embedding)
    if not dims:
        return none
    kept = written(vec.scaled(vectors, embedding, dims, scale, [F.col(vec_id).cast("long").alias("vec_id")], "vec_id long"), "scaled")
    n, sums = summed(kept, dims)
    if not n:  # all components too large
        return none
    spread = scatter(kept, dims, n, sums)
    trace = sum(spread[i][i] for i in range(dims))
    covariance = np.array([[extended(Fraction(v, n * n)) for v in row] for row in spread], dtype=np.longdouble)
    e, axes = eigen(covariance)
    k = min(components, dims)
    explained = [max(float(v), 0.0) * (n * n) / trace if trace else 0.0 for v in e[:k]]
    alive = e[:k] > ZERO * max(e[0], 0.0)
    turn = np.where(alive, axes[:, :k] / np.sqrt(np.where(alive, e[:k], 1.0)), 0.0)
    means = [s // n for s in sums]
    left = [s - n * m for s, m in zip(sums, means, strict=True)]
    shared = spark.sparkContext.broadcast((np.array(means, dtype=np.int64), np.array([float(Fraction(v, n)) for v in left]), turn))  # dims x components

    def project(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        moved, rest, turn = shared.value
        y = vec.unpacked(column, "<i8", dims) - moved
        return y, (y - rest) @ turn

    def total(centre: np.ndarray | None) -> np.ndarray:
        """Sums of whitened vectors, or of products of those that are moved by `centre`; components x components numbers return at most."""

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made = np.zeros(k if centre is None else k * k)
            for batch in batches:
                w = project(batch.column("x"))[1]
                made += w.sum(axis=0) if centre is None else ((w - centre).T @ (w - centre)).ravel()
            yield pa.RecordBatch.from_arrays([pa.array([made.tolist()])], ["sums"])

        rows = kept.select("x").mapInArrow(add, "sums array<double>").select(F.posexplode("sums").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").collect()
        return np.array([r["v"] for r in rows]) / n

    off = np.abs(total(total(None)).reshape(k, k) - np.eye(k))
    identity_error = float(off[np.ix_(alive, alive)].max(initial=0.0))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                y, w = project(batch.column("x"))
                each = pa.array(np.repeat(np.arange(len(y)), k))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(y))), pa.array(np.full(len(y) * k, n)), deviations(y, n, left).take(each), pa.array(w.ravel()), pa.array(np.tile(explained, len(y))), pa.array(np.full(len(y) * k, identity_error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return kept.mapInArrow(emit, schema)
