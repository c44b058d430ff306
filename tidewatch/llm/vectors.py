"""Vectors with finite components as rows of integers, for the operators that compute with them exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Scaled components stay below this, so that they and their differences are 64-bit integers.
LARGEST = float(1 << 61)


def usable(vector: Column) -> Column:
    """Whether an array<double> has components, none of them null, NaN or infinite."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))


def common_length(vectors: DataFrame, embedding: str) -> int:
    """The most common length of usable vectors (the longer of two as common), 0 if there are none."""
    x = F.col(embedding).cast("array<double>")
    lengths = vectors.where(usable(x)).groupBy(F.size(x).alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).limit(1)
    return next((r["dims"] for r in lengths.collect()), 0)


def scaled(vectors: DataFrame, embedding: str, dims: int, scale: int, keep: list[Column], kept: str) -> DataFrame:
    """`keep` (columns, of the types `kept`) and x: floor(scale * component) as little-endian 64-bit integers, for vectors of this length.

    Vectors that are null, of another length, or hold null, non-finite or too large components are left out.
    """
    names = [f.split()[0] for f in kept.split(", ")]

    def scale_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
            with np.errstate(over="ignore", invalid="ignore"):
                q = np.floor(x * scale)
                on = (np.abs(q) < LARGEST).all(axis=1)  # false for NaN, which nulls are here
            some = batch.filter(pa.array(on))
            yield pa.RecordBatch.from_arrays([*(some.column(c) for c in names), packed(q[on].astype("<i8"))], [*names, "x"])

    x = F.col(embedding).cast("array<double>")
    right = vectors.where(F.size(x) == dims).select(*keep, x.alias("vector"))
    return right.mapInArrow(scale_down, f"{kept}, x binary")


def packed(rows: np.ndarray) -> pa.Array:
    """The bytes of each row of a matrix."""
    rows = np.ascontiguousarray(rows)
    width = rows.dtype.itemsize * rows.shape[1]
    offsets = np.arange(len(rows) + 1, dtype=np.int64) * width
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)]).cast(pa.binary())


def unpacked(column: pa.Array, kind: str, width: int) -> np.ndarray:
    """The matrix whose rows' bytes a binary column (without nulls) holds."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(-1, width)
