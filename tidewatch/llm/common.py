"""Helpers that the corpus operators share: written tables, bounded Arrow batches, text hashing."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from tidewatch.sources.shared import shared_dir, written  # noqa: F401  for the operators beside this module

#: Bytes of text that one Arrow batch or one vectorised step holds (a longer single text is a step of its own).
BATCH_BYTES = 2 << 20

_U = np.uint64


def bounded_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Let Arrow batches end after so many bytes, so that a task's Python memory doesn't follow the length of texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


_caches: dict[str, list[dict]] = {}


def cache(owner: str) -> dict:
    """A table that a worker process keeps from task to task, until it works for another owner."""
    made: dict = {}
    _caches.setdefault(owner, []).append(made)
    return made


def claim(owner: str) -> None:
    """Called where a task starts: what the worker kept for other owners goes, and its memory is given back."""
    dropped = [c for name, held in _caches.items() if name != owner for c in held if c]
    for c in dropped:
        c.clear()
    if dropped:
        gc.collect()
        give_back()


def give_back() -> None:
    """Memory that the allocators hold and nothing uses goes back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the worker gives back its free memory: while the JVM works, idle workers hold little."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string column, nulls as empty texts, and the offsets (n + 1) of its texts."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    n = len(column)
    at = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(batch: pa.RecordBatch, column: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of at most `most` bytes of text and 30,000 rows each, or one row."""
    _, at = text_bytes(batch.column(column))
    start, n = 0, batch.num_rows
    while start < n:
        stop = max(start + 1, min(int(np.searchsorted(at, at[start] + most, side="right")) - 1, start + 30_000))
        yield batch.slice(start, stop - start)
        start = stop


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes every output bit."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(33)
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


def _byte_codes() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))


def _fold_ascii() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
PUNCTUATION = np.zeros(256, dtype=bool)
PUNCTUATION[list(b".,;:!?")] = True
LOWER = _fold_ascii()
_CODES, _CODES_LOWER = _byte_codes(), _byte_codes()[LOWER]
_BASE = 0x9E3779B97F4A7C15 | 1
_powers = np.ones(1, dtype=_U)


def _power(n: int) -> np.ndarray:
    """base ** 0 .. base ** n, modulo 2 ** 64."""
    global _powers
    if len(_powers) <= n:
        grown = np.full(max(n + 1, 1 << 16), _BASE, dtype=_U)
        grown[0] = 1
        _powers = np.multiply.accumulate(grown)
    return _powers


def word_spans(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of texts laid end to end: starts, ends and text number of each."""
    n = len(raw)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~SPACE[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = at[1:-1]
    cut = cut[cut < n]
    first[cut] |= inside[cut]
    last = inside.copy()  # last byte of a word
    last[:-1] &= ~inside[1:] | first[1:]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(at, start, side="right") - 1


def words(raw: np.ndarray, at: np.ndarray, lower: bool = True, trim: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of texts laid end to end: starts, ends, text number and 64-bit hash of each.

    The hash is a polynomial over random byte codes, taken from one running sum for all words; `lower` folds A-Z, `trim`
    leaves off one punctuation mark at the end of a longer word.
    """
    n = len(raw)
    start, end, text = word_spans(raw, at)
    if not n:
        return start, end, text, np.zeros(0, _U)
    if trim:
        end = end - (PUNCTUATION[raw[end - 1]] & (end - start > 1))
    power = _power(n)
    total = np.zeros(n + 1, dtype=_U)
    np.cumsum((_CODES_LOWER if lower else _CODES)[raw] * power[n - 1 :: -1][:n] if n else raw, out=total[1:])
    # what a word adds, moved to one place: the sum over i of code[i] * base ** (end - 1 - i), times base ** (n - end) so far
    span = total[end] - total[start]
    return start, end, text, mix(span * _inverse(n)[n - end] + (end - start).astype(_U))


_inverses = np.ones(1, dtype=_U)


def _inverse(n: int) -> np.ndarray:
    """base ** -0 .. base ** -n, modulo 2 ** 64."""
    global _inverses
    if len(_inverses) <= n:
        grown = np.full(max(n + 1, 1 << 16), pow(_BASE, -1, 1 << 64), dtype=_U)
        grown[0] = 1
        _inverses = np.multiply.accumulate(grown)
    return _inverses
