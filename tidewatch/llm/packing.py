"""Best-fit packing of tokenised documents into sequences of fixed capacity by large-item matching.

Items longer than a third of the capacity (large) pair greedily, at most two to a sequence: from the longest down, each
takes the longest partner that still fits. Shorter items go from the longest down into the tightest gap that holds
them. Both steps work on the number of items of each length, at most one entry per length from 1 to the capacity, so
the plan has a size bound set by the capacity alone, however many documents there are. Spark counts lengths, numbers
the items within each length, and looks up every item's place in the plan.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import bounded_batches, slices, trimmed, written
from tidewatch.llm.tokens import STEP, encoder

#: Items are numbered within (length, lane), so that a length with most of the items is spread over tasks.
LANES = 512

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, text: str = "text", keep: tuple[str, ...] = (), held: int | None = None) -> DataFrame:
    """Tokenise every text (null: empty), append end_id, cut what exceeds `capacity`; the first piece takes the remainder.

    One row per piece: doc_id, piece, start, length, ids_crc32, and the columns of `keep`, none of which may have one of
    these names or those that pack adds. held: pre-tokens that a worker remembers, by default as many as tokens.CACHE_PIECES.
    """
    if clash := {*keep} & {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}:
        raise ValueError(f"rename before packing: {sorted(clash)}")
    bounded_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, held)
        for whole in batches:
            for batch in slices(whole, "__text", STEP):
                ids, at = enc.encode(batch.column("__text"), end_id)
                n = np.diff(at)
                number = -(-n // capacity)
                row = np.repeat(np.arange(len(n)), number)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
                head = (n - (number - 1) * capacity)[row]
                start = np.where(piece == 0, 0, head + (piece - 1) * capacity)
                length = np.where(piece == 0, head, capacity)
                first, view = 4 * (at[row] + start), memoryview(ids.view(np.uint8))
                crc = [zlib.crc32(view[x:y]) for x, y in zip(first.tolist(), (first + 4 * length).tolist(), strict=True)]
                of_row = pa.array(row)
                kept = [batch.column(k).take(of_row) for k in range(2, batch.num_columns)]
                made = [batch.column(0).take(of_row), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), *kept]
                yield pa.RecordBatch.from_arrays(made, ["doc_id", "piece", "start", "length", "ids_crc32", *keep])

    chosen = docs.select(F.col("doc_id").cast("long"), F.col(text).cast("string").alias("__text"), *keep)
    extra = "".join(f", `{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    return chosen.mapInArrow(trimmed(cut), PIECES + extra)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Where the items of each length go: rows (length, first, stop, sequence, each, offset).

    Items first <= rank < stop of a length lie in the sequences from `sequence` on, `each` to a sequence, from `offset`.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    taken: dict[int, int] = defaultdict(int)
    rows: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # gap: runs (first sequence, sequences, offset)
    sequences = 0

    def put(length: int, first: int, bins: int, each: int, offset: int, items: int) -> None:
        rows.append((length, taken[length], taken[length] + items, first, each, offset))
        taken[length] += items

    def leave(gap: int, first: int, bins: int, offset: int) -> None:
        if gap and bins:
            gaps[gap].append((first, bins, offset))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large[-1]
        fit = bisect.bisect_right(large, capacity - a) - 1
        b = large[fit] if fit >= 0 else None
        bins = left[a] if b is None else left[a] // 2 if a == b else min(left[a], left[b])
        if b is None or not bins:  # no partner, or one item whose only partner is its like
            bins, b = left[a], None
        put(a, sequences, bins, 2 if a == b else 1, 0, bins * (2 if a == b else 1))
        left[a] -= bins * (2 if a == b else 1)
        if b is not None and a != b:
            put(b, sequences, bins, 1, a, bins)
            left[b] -= bins
            if not left[b]:
                large.remove(b)
        leave(capacity - a - (b or 0), sequences, bins, a + (b or 0))
        sequences += bins
        if not left[a]:
            large.pop()

    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        for gap in sorted(g for g in gaps if g >= n):
            runs, each = gaps.pop(gap), gap // n
            while runs and left[n]:
                first, bins, offset = runs.pop()
                full = min(bins, left[n] // each)
                if full:
                    put(n, first, full, each, offset, full * each)
                    left[n] -= full * each
                    leave(gap - each * n, first, full, offset + each * n)
                if full < bins and left[n]:  # fewer than fill one sequence of this run
                    put(n, first + full, 1, left[n], offset, left[n])
                    leave(gap - left[n] * n, first + full, 1, offset + left[n] * n)
                    left[n], full = 0, full + 1
                if full < bins:
                    runs.append((first + full, bins - full, offset))
            if runs:
                gaps[gap].extend(runs)
            if not left[n]:
                break
        each = capacity // n
        full, rest = divmod(left[n], each)
        for bins, k in ((full, each), (1, rest)):
            if bins and k:
                put(n, sequences, bins, k, 0, bins * k)
                leave(capacity - k * n, sequences, bins, k * n)
                sequences += bins
        left[n] = 0
    return rows


def pack(items: DataFrame, capacity: int) -> DataFrame:
    """Add sequence_id and offset to items that have doc_id, piece, ids_crc32 and length (1 to capacity).

    items must be a written table: it is read more than once. Repeated rows are items of their own; which of two
    equal rows takes which place does not show. An empty table gives an empty one.
    """
    spark = items.sparkSession
    lane = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(LANES)).cast("int")
    laned = items.withColumn("__lane", lane)
    lanes = laned.groupBy("length", "__lane").count()  # capacity x LANES rows at most
    before = F.sum("count").over(Window.partitionBy("length").orderBy("__lane").rowsBetween(Window.unboundedPreceding, -1))
    bases = lanes.select("length", "__lane", F.coalesce(before, F.lit(0)).alias("__base"))
    counts = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    if any(not 1 <= n <= capacity for n in counts):
        raise ValueError("an item's length must lie from 1 to the capacity")
    rows = plan(counts, capacity)
    places = spark.createDataFrame(rows, "__length long, __first long, __stop long, __sequence long, __each long, __at long")
    rank = F.row_number().over(Window.partitionBy("length", "__lane").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = laned.withColumn("__rank", rank.cast("long") - 1).join(bases, ["length", "__lane"]).withColumn("__rank", F.col("__rank") + F.col("__base"))
    if len(rows) < 50 * capacity:  # holds for any plan: each step ends a length or a run
        places = F.broadcast(places)
    fits = (F.col("length") == F.col("__length")) & (F.col("__rank") >= F.col("__first")) & (F.col("__rank") < F.col("__stop"))
    k = F.col("__rank") - F.col("__first")
    return ranked.join(places, fits).select(
        *items.columns,
        (F.col("__sequence") + F.floor(k / F.col("__each"))).cast("long").alias("sequence_id"),
        (F.col("__at") + k % F.col("__each") * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048, text: str = "text", keep: tuple[str, ...] = (), held: int | None = None) -> DataFrame:
    """Tokenise and pack whole documents; one row per piece.

    A null or empty text is one item, the end id alone. Null and repeated doc_ids stay, each row is packed. Extra
    columns are ignored unless named in `keep`. An empty table gives an empty result.
    """
    return pack(written(pieces(docs, tokenizer, end_id, capacity, text, keep, held), "pieces"), capacity)
