"""Vector codes: parts of vectors stand for their nearest codebook entries, fitted by Yinyang Lloyd on integers.

Components become integers, vectors are cut into parts, and each part position has a codebook. A round assigns every part
to its nearest entry and then replaces each entry by the floored mean of its parts. Entries are clustered into groups
once. A part keeps, for each group, a lower bound on its distance to the group's entries but the one that it is assigned
to; when entries move, the bound falls by the group's largest move. A part's distance to its own entry is taken
anew in each round, and only groups whose bound doesn't exceed it are scanned. Scanned distances are whole numbers (by
BLAS where every sum stays below 2 ** 53, else in wider integers), so that ties are decided by numbers, not by rounding:
equal distances go to the lower index. A group is skipped only if its bound, rounded down, lies above a distance rounded up.

Each round writes codes and bounds to the shared folder and the sums of each entry's parts beside them, one row a task;
what returns to the driver is the size of the codebooks. The round before is deleted when its successor is complete.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import vectors as vec
from tidewatch.llm.common import bounded_batches, shared_dir, written

#: Entries of a group, about.
GROUP = 16
#: Rows that one step compares.
ROWS = 4096
#: Labels up to here are broadcast with their sums; more are shuffled, each to SALTS places.
BROADCAST_LABELS, SALTS = 100_000, 16
#: Relative rounding that bounds give way for, many times over.
SLACK = 1e-6
_EXACT = 1 << 53


@dataclass
class Codebook:
    """Entries (integers) of one part position, their groups, and how far the groups' entries moved at most in the last round."""

    entries: np.ndarray
    groups: list[np.ndarray]
    moved: np.ndarray


def squared(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all points to all entries, exact: 64-bit integers, or Python's where those don't suffice."""
    dims = max(1, points.shape[1])
    most = max((int(np.abs(a).max()) for a in (points, entries) if a.size), default=0)
    if 4 * dims * most * most < _EXACT:  # products, norms and their sums are whole doubles
        p, e = points.astype(np.float64), entries.astype(np.float64)
        return ((p * p).sum(axis=1)[:, None] - 2.0 * (p @ e.T) + (e * e).sum(axis=1)[None, :]).astype(np.int64)
    if 4 * dims * most * most >= 1 << 62:
        points, entries = points.astype(object), entries.astype(object)
    return np.stack([((points - e) ** 2).sum(axis=1) for e in entries], axis=1)


def own_distance(points: np.ndarray, entries: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Squared distance of each point to its own entry, exact."""
    most = max((int(np.abs(a).max()) for a in (points, entries) if a.size), default=0)
    if 4 * max(1, points.shape[1]) * most * most >= 1 << 62:
        points, entries = points.astype(object), entries.astype(object)
    return ((points - entries[code]) ** 2).sum(axis=1)


def root(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64))


def grouped(entries: np.ndarray) -> list[np.ndarray]:
    """Indexes of entries by a few rounds of plain k-means around evenly spaced ones; every index is in one group."""
    n = max(1, len(entries) // GROUP)
    x = entries.astype(np.float64)
    centres = x[np.arange(n) * len(x) // n]
    for _ in range(5):
        near = ((x[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.stack([x[near == g].mean(axis=0) if (near == g).any() else centres[g] for g in range(n)])
    return [np.flatnonzero(near == g) for g in range(n)]


def assign(points: np.ndarray, book: Codebook, code: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Nearest entries by group bounds: new codes, new bounds (points x groups), squared distances, distances taken.

    code and bounds are those before the entries moved as book.moved says; bounds of -inf have every group scanned.
    """
    own = own_distance(points, book.entries, code)
    best, new, bounds = own.copy(), code.copy(), bounds.astype(np.float64) - book.moved[None, :]
    reach = root(own) * (1 + SLACK)
    open_ = bounds * (1 - SLACK) <= reach[:, None]  # bounds below 0 are open in any case
    seen, taken = [], len(points)
    for g, members in enumerate(book.groups):
        rows = np.flatnonzero(open_[:, g]) if len(members) else np.zeros(0, np.int64)
        if not len(rows):
            seen.append(None)
            continue
        d = squared(points[rows], book.entries[members])
        taken += d.size
        first = d.argmin(axis=1)  # the lowest index of equal ones: members ascend
        low = d[np.arange(len(rows)), first]
        nearer = (low < best[rows]) | ((low == best[rows]) & (members[first] < new[rows]))
        best[rows[nearer]], new[rows[nearer]] = low[nearer], members[first[nearer]]
        seen.append((rows, d))
    of = np.zeros(len(book.entries), np.int64)
    for g, members in enumerate(book.groups):
        of[members] = g
        if seen[g] is None:
            continue
        rows, d = seen[g]
        d = root(d)
        d[new[rows, None] == members[None, :]] = np.inf  # a bound leaves out the part's own entry
        bounds[rows, g] = d.min(axis=1)
    left = np.flatnonzero((new != code) & ~open_[np.arange(len(code)), of[code]])  # the entry left joins its group's bound
    bounds[left, of[code[left]]] = np.minimum(bounds[left, of[code[left]]], root(own[left]))
    return new, bounds, best, taken


def _down(bounds: np.ndarray) -> np.ndarray:
    """In single precision, not above."""
    return np.nextafter(bounds.astype(np.float32), np.float32(-np.inf))


def cut(dims: int, parts: int) -> list[tuple[int, int]]:
    """First and last position of each part; as even as can be where dims isn't a multiple."""
    at = [dims * k // parts for k in range(parts + 1)]
    return list(zip(at, at[1:], strict=False))


def first_books(kept: DataFrame, dims: int, parts: int, entries: int) -> list[Codebook]:
    """Codebooks of the vectors with the smallest vec_ids (nulls last; of equal ids the smaller bytes first)."""
    rows = kept.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()  # as many as entries
    x = np.frombuffer(b"".join(r["x"] for r in rows), "<i8").reshape(-1, dims)
    out = []
    for a, b in cut(dims, parts):
        groups = grouped(x[:, a:b])
        out.append(Codebook(x[:, a:b].copy(), groups, np.zeros(len(groups))))
    return out


def replaced(book: Codebook, counts: list[int], sums: list[list[int]]) -> Codebook:
    """Entries by the floored means of their parts; unused ones stay."""
    entries = np.array([[s // n for s in total] if n else old for n, total, old in zip(counts, sums, book.entries.tolist(), strict=True)], dtype=np.int64).reshape(book.entries.shape)
    way = np.array([sum((a - b) ** 2 for a, b in zip(new, old, strict=True)) for new, old in zip(entries.tolist(), book.entries.tolist(), strict=True)], dtype=np.float64)
    far = np.sqrt(way) * (1 + SLACK)
    return Codebook(entries, book.groups, np.array([far[g].max(initial=0.0) for g in book.groups]))


def _totals(points: np.ndarray, code: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts and sums of the parts of each entry, as Python integers."""
    order = np.argsort(code, kind="stable")
    counts = np.bincount(code, minlength=n)
    sums = np.zeros((n, points.shape[1]), dtype=object)
    used = np.flatnonzero(counts)
    if points.size:
        wide = int(np.abs(points).max()) * len(points) >= 1 << 62
        sums[used] = np.add.reduceat(points[order].astype(object) if wide else points[order], (np.cumsum(counts) - counts)[used], axis=0).astype(object)
    return counts.astype(object), sums


def _pass(state: DataFrame, books: list[Codebook], dims: int, last: bool) -> DataFrame:
    """One assignment of every part. `last`: vec_id, label, code, error; else the state for the next round and, in one more row a task, sums.

    A sums row has for each part first the counts of all entries and then their components' sums.
    """
    spark = state.sparkSession
    shared = spark.sparkContext.broadcast(books)  # parts x entries
    places, n = cut(dims, len(books)), len(books[0].entries)
    groups = sum(len(b.groups) for b in books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        totals = [[np.zeros(n, dtype=object), np.zeros((n, b - a), dtype=object)] for a, b in places]
        some = False
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch, some = whole.slice(at, ROWS), True
                x = vec.unpacked(batch.column("x"), "<i8", dims)
                code = vec.unpacked(batch.column("code"), "<u2", len(books)).astype(np.int64)
                bounds = vec.unpacked(batch.column("bounds"), "<f4", groups)
                made, g = [], 0
                for k, (book, (a, b)) in enumerate(zip(books, places, strict=True)):
                    made.append(assign(x[:, a:b], book, code[:, k], bounds[:, g : g + len(book.groups)])[:3])
                    g += len(book.groups)
                    if not last:
                        counts, sums = _totals(x[:, a:b], made[-1][0], n)
                        totals[k][0] += counts
                        totals[k][1] += sums
                codes = np.stack([c for c, _, _ in made], axis=1)
                if last:
                    error = sum(d.astype(object) for _, _, d in made)
                    fits = [int(e) if e < 1 << 63 else None for e in error]
                    hexed = [row.tobytes().hex() for row in codes.astype(np.uint8 if n <= 256 else ">u2")]
                    yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(hexed, pa.string()), pa.array(fits, pa.int64())], ["vec_id", "label", "code", "error"])
                else:
                    held = np.concatenate([_down(d) for _, d, _ in made], axis=1)
                    yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("x"), vec.packed(codes.astype("<u2")), vec.packed(held.astype("<f4")), pa.nulls(batch.num_rows, _SUMS)], _STATE_NAMES)
        if some and not last:
            flat = [Decimal(int(v)) for counts, sums in totals for v in [*counts, *sums.ravel()]]
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.string()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.array([flat], _SUMS)], _STATE_NAMES)

    return state.mapInArrow(run, "vec_id long, label string, code string, error long" if last else _STATE)


_STATE_NAMES = ["vec_id", "label", "x", "code", "bounds", "sums"]
_STATE = "vec_id long, label string, x binary, code binary, bounds binary, sums array<decimal(38,0)>"
_SUMS = pa.list_(pa.decimal128(38, 0))


def _delete(spark: SparkSession, path: str) -> None:
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


def fit(kept: DataFrame, dims: int, parts: int, entries: int, rounds: int) -> tuple[list[Codebook], DataFrame]:
    """Codebooks after all rounds, and the state (codes and bounds) that a last assignment starts from.

    kept: vec_id, label, x (dims integers as bytes), at least one row.
    """
    spark = kept.sparkSession
    books = first_books(kept, dims, parts, entries)
    n, groups = len(books[0].entries), sum(len(b.groups) for b in books)
    nothing = F.lit(np.full(groups, -np.inf, "<f4").tobytes())
    state = kept.select("vec_id", "label", "x", F.lit(bytes(2 * parts)).alias("code"), nothing.alias("bounds"))
    before = None
    for k in range(rounds):
        path = shared_dir(spark, f"codes{k}")
        _pass(state, books, dims, last=False).write.parquet(path)
        table = spark.read.schema(_STATE).parquet(path)
        flat = table.where("sums IS NOT NULL").select(F.posexplode("sums").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).collect()  # the codebooks' size
        total = [0] * len(flat)
        for r in flat:
            total[r["at"]] = int(r["v"])
        at = 0
        for p, (a, b) in enumerate(cut(dims, parts)):
            counts, at = total[at : at + n], at + n
            sums, at = [total[at + i * (b - a) : at + (i + 1) * (b - a)] for i in range(n)], at + n * (b - a)
            books[p] = replaced(books[p], counts, sums)
        state = table.where("x IS NOT NULL").drop("sums")
        if before:
            _delete(spark, before)
        before = path
    return books, state


def digest(books: list[Codebook]) -> str:
    """SHA-256 of all entries' components by part, entry and position, in decimal, joined by commas."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.entries.ravel().tolist()).encode()).hexdigest()


def code_report(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """One row per usable vector: vec_id, code (hex), error, label_error, codebooks_sha256.

    Vectors that are null, empty, hold null or non-finite components, components of 2 ** 61 / scale or more, or are of another than
    the most common length (the longer of two as common) have no row. Parts are as even as can be where their number
    doesn't divide the length. Repeated rows count each for itself; null vec_ids come after all others where the
    first codebook is chosen, equal ids by their vectors' bytes. Fewer vectors than entries make smaller codebooks. An
    error beyond 64 bits is null and adds nothing to its label's. Null labels are one label. Extra columns are
    ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    dims = vec.common_length(vectors, embedding)
    none = spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    if not dims:
        return none
    keep = [F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label")]
    kept = written(vec.scaled(vectors, embedding, dims, scale, keep, "vec_id long, label string"), "scaled")
    if kept.isEmpty():  # all components too large
        return none
    books, state = fit(kept, dims, parts, entries, rounds)
    coded = written(_pass(state, books, dims, last=True), "coded").withColumns({"known": F.col("label").isNotNull(), "label": F.coalesce("label", F.lit(""))})
    by_label = written(coded.groupBy("known", "label").agg(F.try_sum("error").alias("label_error")), "by_label")
    if by_label.count() <= BROADCAST_LABELS:
        named = coded.join(F.broadcast(by_label), ["known", "label"])
    else:
        salted = by_label.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        named = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int")).join(salted, ["known", "label", "salt"])
    return named.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
