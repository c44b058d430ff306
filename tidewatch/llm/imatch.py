"""Document fingerprints by I-Match.

Terms are the words of a text, A-Z in lower case, without a punctuation mark at the end. The lexicon is every term whose
document frequency lies in a band: common words say nothing, rare ones change with every edit. A document keeps its
distinct terms in the lexicon, sorted, and hashes them; then it does so again for many randomised subsets of the lexicon,
from a quarter of its terms down to a thousandth. A small edit spares the hashes of most small subsets, so the share of
equal hashes tells how alike two documents are.

The band is a share of the documents, so the lexicon holds at most (mean distinct terms of a document) / LEAST terms,
whatever the number of documents; it is broadcast as sorted 40-bit numbers after a check of that size. The band never
moves with the corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import BATCH_BYTES, bounded_batches, claim, mix, slices, text_bytes, words

#: The band: document frequency over number of documents, and at least two documents.
LEAST, MOST = 1 / 1000, 1 / 50
#: Terms broadcast at most (8 bytes each). By the bound above, more would need documents of 32,000 distinct terms on average.
LEXICON_TERMS = 32_000_000
#: Subsets of the lexicon: (one in so many terms, number of subsets).
SUBSETS = ((4, 4), (16, 8), (64, 24), (256, 32), (1024, 32))
_BITS = 40
_U = np.uint64


def terms(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct terms of texts laid end to end (below 2 ** 24 texts): text number and 40-bit term number, sorted by both."""
    _, _, owner, code = words(raw, at, trim=True)
    key = np.unique((owner.astype(_U) << _U(_BITS)) | (code >> _U(64 - _BITS)))
    return (key >> _U(_BITS)).astype(np.int64), key & _U((1 << _BITS) - 1)


def lexicon(docs: DataFrame, text: str = "text", least: float = LEAST, most: float = MOST) -> np.ndarray:
    """Sorted terms whose document frequency lies in the band, over all documents."""
    bounded_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("imatch")
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            t, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(t.astype(np.int64)), pa.array(n.astype(np.int64))], ["term", "n"])

        for whole in batches:
            for batch in slices(whole, "text"):
                _, t = terms(*text_bytes(batch.column("text")))
                held.append(t)
                size += len(t)
                if size > 6_000_000:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    n_docs = docs.count()
    chosen = docs.select(F.col(text).cast("string").alias("text"))
    df = chosen.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    inside = df.where((F.col("n") >= max(2.0, least * n_docs)) & (F.col("n") <= max(2.0, most * n_docs))).select("term")
    found = inside.limit(LEXICON_TERMS + 1).toArrow().column("term").to_numpy()
    if len(found) > LEXICON_TERMS:
        raise ValueError(f"the band holds over {LEXICON_TERMS} terms; give a narrower one")
    return np.sort(found.astype(_U))


def fingerprints(texts: list[str], known: np.ndarray) -> list[str]:
    """A fingerprint for each text: 16 digits for the whole lexicon, then 4 for each subset, 0000 where it has no term.

    A text without a term in the lexicon is taken by all its terms. A text without terms has zeros only.
    """
    raw, at = text_bytes(pa.array(texts, pa.large_string()))
    owner, term = terms(raw, at)
    n = len(texts)
    place = np.searchsorted(known, term)
    inside = np.zeros(len(term), dtype=bool)
    inside[place < len(known)] = known[place[place < len(known)]] == term[place < len(known)]
    without = np.bincount(owner[inside], minlength=n) == 0
    kept = inside | without[owner]
    owner, term = owner[kept], term[kept]
    rank = np.arange(len(term)) - np.searchsorted(owner, owner)  # place among the document's sorted terms
    whole = np.zeros(n, _U)
    np.add.at(whole, owner, mix(mix(term + _U(1)) + rank.astype(_U)))
    columns, k = [], 0
    spread = mix(term + _U(1))
    for one_in, subsets in SUBSETS:
        for _ in range(subsets):
            k += 1
            odd = int(mix(np.array([k], _U))[0]) | 1
            drawn = spread * _U(odd)
            on = drawn < _U((1 << 64) // one_in)
            part = np.zeros(n, _U)
            np.add.at(part, owner[on], mix(drawn[on]))  # a sum over the sorted distinct terms
            columns.append(np.where(part == 0, 0, part % _U(0xFFFF) + _U(1)))
    tail = np.stack(columns, axis=1).astype(">u2") if columns else np.zeros((n, 0), ">u2")
    head = whole.astype(">u8")
    return [head[i : i + 1].tobytes().hex() + tail[i].tobytes().hex() for i in range(n)]


def likeness(a: str, b: str) -> float:
    """The share of equal hashes among the subsets in which either has a term; 1 for equal fingerprints."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(s[16:]), ">u2") for s in (a, b))
    some = (x > 0) | (y > 0)
    return float(((x == y) & some).sum() / some.sum()) if some.any() else 0.0


def edited(text: str, following: str) -> str:
    """The last half of a text's code points (rounded down) replaced by the first as many, or all, of another."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame, rows: int = 256) -> DataFrame:
    """(block, tail, doc_id, text) so that each block, sorted by tail, doc_id descending, holds every row's next row.

    Documents run by descending doc_id, null ids last, equal ids by a hash of the text; after the last comes the first.
    Blocks are ranges of doc_id, `rows` documents each or, if fewer, 64 for each of the session's shuffle partitions;
    each also gets the first rows of the block that follows, marked as its tail.
    """
    spark = docs.sparkSession
    most_blocks = 64 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = min(most_blocks, max(1, base.count() // rows))
    cuts = []
    if n > 1:
        shares = [i / n for i in range(1, n)]
        cuts = base.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, shares)), F.lit(20 * n)).alias("q")).first()["q"] or []
    splits = [-float("inf"), *sorted({float(x) for x in cuts}), float("inf")]
    placed = base.withColumns({"__id": F.col("doc_id").cast("double"), "__block": F.lit(0.0)})
    if len(splits) > 2:
        number = Bucketizer(splits=splits, inputCol="__id", outputCol="__block", handleInvalid="keep")
        placed = number.transform(placed.drop("__block"))
    placed = placed.withColumn("block", F.when(F.col("doc_id").isNull(), -1).otherwise(F.col("__block").cast("int"))).drop("__id", "__block")
    tops = sorted(((r["block"], r["top"]) for r in placed.groupBy("block").agg(F.max("doc_id").alias("top")).collect()), reverse=True)  # most_blocks rows at most
    if not tops:
        return placed.select("block", F.lit(False).alias("tail"), "doc_id", "text")
    sends = [(block, top, tops[i - 1][0]) for i, (block, top) in enumerate(tops)]
    table = F.broadcast(spark.createDataFrame(sends, "of int, top long, sends int"))
    first = F.col("doc_id").eqNullSafe(F.col("top"))
    here = F.struct(F.col("block"), F.lit(False).alias("tail"))
    there = F.struct(F.col("sends").alias("block"), F.lit(True).alias("tail"))
    both = placed.join(table, placed["block"] == table["of"]).withColumn("to", F.explode(F.when(first, F.array(here, there)).otherwise(F.array(here))))
    return both.select(F.col("to.block").alias("block"), F.col("to.tail").alias("tail"), "doc_id", "text")


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """Fingerprint every text and its edited text: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.

    A null text is an empty one. Rows with equal or null doc_ids each get a row. In an empty table there is nothing to
    return; a single document follows itself. Extra columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(lexicon(docs))
    order = [F.col("block"), F.col("tail"), F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    rows = with_next(docs).repartition("block").sortWithinPartitions(*order)

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("imatch")
        run: list[tuple[int | None, str]] = []  # rows of one block; the last waits for its next
        size, now, over = 0, None, False

        def flush() -> pa.RecordBatch:
            ids, texts = [d for d, _ in run], [t for _, t in run]
            changed = [edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
            prints = fingerprints(texts + changed, known.value)
            own, new = prints[: len(texts)], prints[len(texts) :]
            m = len(changed)
            cols = [
                pa.array(ids[:m], pa.int64()), pa.array([len(t) for t in texts[:m]], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
                pa.array(own[:m], pa.string()), pa.array(new, pa.string()), pa.array([likeness(a, b) for a, b in zip(own, new, strict=False)], pa.float64()),
                pa.array([likeness(a, b) for a, b in zip(own, own[1:], strict=False)], pa.float64()),
            ]
            return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        for batch in batches:
            for block, tail, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("block", "tail", "doc_id", "text")), strict=True):
                if block != now:
                    run, size, now, over = [], 0, block, False
                if over:  # further tail rows
                    continue
                run.append((doc_id, text))
                size += len(text)
                if tail or size > BATCH_BYTES // 2:
                    if len(run) > 1:
                        yield flush()
                    run, size, over = run[-1:], len(text), tail

    return rows.mapInArrow(report, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
