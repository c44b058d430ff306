"""A hidden Markov language model over whole texts.

Tokens are the words of a text (A-Z in lower case) and one end. A word belongs to a class: words that make up at least
1 / FREQUENT of all training tokens to classes by their hash, other words to classes by their last letters, the end to
its own. The latent states emit classes, and a class emits its words by their training counts, with one more count for
each word and one for all unknown ones. So the number of parameters is set by the classes, and the vocabulary, which
grows with the corpus, only takes part in a shuffle that adds up each word's count over all blocks.

A block is a few MB of texts with its own dictionary, sorted by word hash. Dictionaries are cut at the same hashes into
parts; all blocks' pieces of a part meet in one task, of bounded size as a word is once in a block, which adds up the
words' training counts and sends each block's piece its sums back. Baum-Welch: every partition runs the scaled
forward-backward recursion over its blocks, each text from its first token to its last, and returns expected counts,
which Spark adds up; every round runs over all training documents. Scores come from the scaled forward recursion over
every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import LOWER, bounded_batches, claim, mix, slices, text_bytes, words, written

STATES = 8
FREQUENT = 50_000
BY_ENDING, BY_HASH = 1 << 12, 1 << 14
CLASSES = BY_ENDING + BY_HASH + 1
END_CLASS = CLASSES - 1
END_HASH = -0x1E5D7A3B9C2F4D61
#: Rounds of Baum-Welch, each over all training documents.
ROUNDS = 6
#: Tokens whose texts take their steps together; a step costs less the more texts share it.
TOKENS_AT_ONCE = 1_500_000
#: Steps from one token to the next that are added up at once, in double precision.
MOVES_AT_ONCE = 1 << 14
#: Text of a block; its dictionary takes part in the shuffle once.
BLOCK_BYTES = 8 << 20
#: Dictionary entries that meet in one task, about.
PART_WORDS = 1 << 20
PRIOR = 20.0
#: No move is less likely than about this.
LEAST_MOVE = 1e-6
#: Steps between two scalings of a recursion.
EVERY = 4
_U = np.uint64

BLOCK = "block long, doc_ids array<long>, held array<boolean>, lengths binary, tokens binary, hashes binary, kinds binary, train binary, n_train long, n_words long"
READY = "block long, doc_ids array<long>, held array<boolean>, lengths binary, classes binary, n_known array<long>, base array<double>, within array<double>"


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the doc_id as text leaves 2 modulo 7 (a null doc_id: no)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _squeeze(x: np.ndarray, kind: str = "<u4") -> bytes:
    """Numbers as zstandard of their byte planes."""
    import zstandard

    planes = np.ascontiguousarray(x.astype(kind)).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _expand(data: bytes, kind: str = "<u4") -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def endings(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A class number for each word from its last three bytes, four if the last is no letter."""
    low = LOWER[raw].astype(np.uint32)
    last = low[end - 1]
    letter = ((last >= 97) & (last <= 122)) | (last >= 128)
    code = last.astype(_U)
    for k in (2, 3, 4):
        there = (end - k >= start) & ~letter if k == 4 else end - k >= start
        code = code << _U(8) | np.where(there, low[np.maximum(end - k, 0)], 0).astype(_U)
    return (mix(code) % _U(BY_ENDING)).astype(np.int32)


def blocks(docs: DataFrame, text: str = "text") -> DataFrame:
    """Texts as blocks of token numbers, each block with its dictionary and the dictionary's counts in training documents."""
    bounded_batches(docs.sparkSession, BLOCK_BYTES)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("hmm")
        k, part = 0, TaskContext.get().partitionId()
        for whole in batches:
            for batch in slices(whole, "text", BLOCK_BYTES):
                raw, at = text_bytes(batch.column("text"))
                start, end, owner, code = words(raw, at)
                n = batch.num_rows
                lengths = np.bincount(owner, minlength=n) + 1
                stops = np.cumsum(lengths)
                seq = np.full(int(stops[-1]), END_HASH, dtype=np.int64).view(_U)
                place = np.arange(len(code)) + owner
                seq[place] = code
                kind = np.full(len(seq), END_CLASS, dtype=np.int32)
                kind[place] = endings(raw, start, end)
                uniq, first, token = np.unique(seq, return_index=True, return_inverse=True)
                held = batch.column("held").to_numpy(zero_copy_only=False).astype(bool)
                train = np.bincount(token[~np.repeat(held, lengths)], minlength=len(uniq))
                cols = [
                    [part * (1 << 32) + k], [batch.column("doc_id").to_pylist()], [held.tolist()], [lengths.astype("<u4").tobytes()], [_squeeze(token)],
                    [uniq.astype("<u8").tobytes()], [_squeeze(kind[first], "<u2")], [_squeeze(train)], [int(train.sum())], [len(uniq)],
                ]
                types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), *[pa.binary()] * 5, pa.int64(), pa.int64()]
                names = ["block", "doc_ids", "held", "lengths", "tokens", "hashes", "kinds", "train", "n_train", "n_words"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)
                k += 1

    chosen = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held"), F.col(text).cast("string").alias("text"))
    return chosen.mapInArrow(build, BLOCK)


def classes_of(hashes: np.ndarray, kinds: np.ndarray, c: np.ndarray, n_train: int) -> np.ndarray:
    """The class of each word: frequent ones by their hash, others as their kind says."""
    by_hash = BY_ENDING + (hashes % _U(BY_HASH)).astype(np.int64)
    return np.where(kinds == END_CLASS, END_CLASS, np.where((c > 0) & (c * FREQUENT >= n_train), by_hash, kinds)).astype(np.int64)


def counted(table: DataFrame, n_train: int, n_words: int) -> DataFrame:
    """Rows (block, part, counts, classes): corpus counts and classes of a block's words, by parts of its dictionary.

    A row without a block, for each part, holds its words' totals by class instead: class, tokens, distinct known words.
    """
    parts = max(1, -(-n_words // PART_WORDS))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                block, *data = (batch.column(c)[at].as_py() for c in ("block", "hashes", "kinds", "train"))
                hashes, kinds, train = np.frombuffer(data[0], "<u8"), _expand(data[1], "<u2"), _expand(data[2])
                cut = np.searchsorted(((hashes >> _U(32)) * _U(parts)) >> _U(32), np.arange(parts + 1).astype(_U)).tolist()
                some = [(p, a, b) for p, (a, b) in enumerate(zip(cut, cut[1:], strict=False)) if a < b]
                cols = [[block] * len(some), [p for p, _, _ in some], [hashes[a:b].tobytes() for _, a, b in some], [_squeeze(kinds[a:b], "<u2") for _, a, b in some], [_squeeze(train[a:b]) for _, a, b in some]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), *[pa.binary()] * 3), strict=True)], ["block", "part", "hashes", "kinds", "train"])

    def add(key: tuple, group: pa.Table) -> pa.Table:
        pieces = [np.frombuffer(x.as_buffer(), "<u8") for x in group.column("hashes")]
        kinds, train = (np.concatenate([_expand(x.as_py(), k) for x in group.column(c)]) for c, k in (("kinds", "<u2"), ("train", "<u4")))
        hashes = np.concatenate(pieces)
        _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        c = np.bincount(which, weights=train).astype(np.int64)[which]  # sums of whole numbers below 2 ** 53 are exact
        cls = classes_of(hashes, kinds, c, n_train)
        n, v = np.bincount(cls[first], weights=c[first], minlength=CLASSES).astype(np.int64), np.bincount(cls[first][c[first] > 0], minlength=CLASSES)
        some = np.flatnonzero(v)
        cuts = np.cumsum([0, *map(len, pieces)]).tolist()
        back = [(_squeeze(c[a:b], "<u8"), _squeeze(cls[a:b], "<u2")) for a, b in zip(cuts, cuts[1:], strict=False)]
        totals = (np.concatenate([n[some], v[some]]).astype("<i8").tobytes(), some.astype("<u4").tobytes())
        blocks, counts, classes = [*group.column("block").to_pylist(), None], *zip(*back, totals, strict=True)
        return pa.table({"block": pa.array(blocks, pa.int64()), "part": pa.array([key[0].as_py()] * len(blocks), pa.int64()), "counts": pa.array(counts, pa.binary()), "classes": pa.array(classes, pa.binary())})

    dealt = table.select("block", "hashes", "kinds", "train").mapInArrow(deal, "block long, part long, hashes binary, kinds binary, train binary")
    return dealt.groupBy("part").applyInArrow(add, "block long, part long, counts binary, classes binary")


def class_totals(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Training tokens and distinct known words of each class; CLASSES rows return."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, CLASSES), np.int64)
        for batch in batches:
            for x, k in zip(batch.column("counts"), batch.column("classes"), strict=True):
                total[:, np.frombuffer(k.as_buffer(), "<u4")] += np.frombuffer(x.as_buffer(), "<i8").reshape(2, -1)
        at = np.flatnonzero(total[1])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[0, at]), pa.array(total[1, at])], ["k", "n", "v"])

    n, v = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    each = counts.where("block IS NULL").select("counts", "classes").mapInArrow(add, "k int, n long, v long")
    for r in each.groupBy("k").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        n[r["k"]], v[r["k"]] = r["n"], r["v"]
    return n, v


def prepared(table: DataFrame, counts: DataFrame, n: np.ndarray, v: np.ndarray) -> DataFrame:
    """Blocks as class numbers, with what of each document's scores doesn't hang on the states."""
    shared = table.sparkSession.sparkContext.broadcast((n, v))  # CLASSES numbers each
    total, distinct = int(n.sum()), int(v.sum())

    def ready(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_class = (shared.value[0] + shared.value[1] + 1).astype(float)
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                lengths = np.frombuffer(row.column("lengths")[0].as_buffer(), "<u4").astype(np.int64)
                token, pieces = _expand(row.column("tokens")[0].as_py()), row.column("pieces")[0].as_py()
                c = np.concatenate([_expand(p["counts"], "<u8") for p in pieces]).astype(np.int64)
                k = np.concatenate([_expand(p["classes"], "<u2") for p in pieces])
                first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
                sums = [np.add.reduceat(x[token], first) for x in ((c > 0).astype(np.int64), np.log10((c + 1) / (total + distinct + 1)), np.log10((c + 1) / of_class[k]))]
                types = [pa.int64(), pa.float64(), pa.float64()]
                made = [pa.array([_squeeze(k[token])], pa.binary()), *(pa.array([x], pa.list_(t)) for x, t in zip(sums, types, strict=True))]
                yield pa.RecordBatch.from_arrays([*(row.column(x) for x in ("block", "doc_ids", "held", "lengths")), *made], ["block", "doc_ids", "held", "lengths", "classes", "n_known", "base", "within"])

    pieces = counts.where("block IS NOT NULL").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("part", "counts", "classes"))).alias("pieces"))  # a block's own dictionary
    return table.select("block", "doc_ids", "held", "lengths", "tokens").join(pieces, "block").mapInArrow(ready, READY)


@dataclass
class Model:
    start: np.ndarray  # states
    move: np.ndarray  # states x states
    emit: np.ndarray  # classes x states


def by_time(seq: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences laid end to end, turned to time order: the order of sequences (longest first), the number alive at each step, the items."""
    order = np.argsort(-lengths, kind="stable")
    long_first = lengths[order]
    alive = np.searchsorted(-long_first, -np.arange(1, long_first[0] + 1), side="right") if len(lengths) else np.zeros(0, np.int64)
    begin = np.concatenate([[0], np.cumsum(alive)])
    rank = np.empty(len(lengths), np.int64)
    rank[order] = np.arange(len(lengths))
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    t = np.arange(len(seq)) - np.repeat(first, lengths)
    out = np.empty_like(seq)
    out[begin[t] + np.repeat(rank, lengths)] = seq
    return order, alive, out


def forward(model: Model, seq: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """log10 probability of each class sequence, by the scaled forward recursion in double precision.

    Rows are scaled every EVERY steps and where a sequence ends; in between they stay far within a double's range.
    """
    order, alive, items = by_time(seq, lengths)
    total, at, alpha = np.zeros(len(lengths)), 0, None
    steps = alive.tolist()
    for t, (m, more) in enumerate(zip(steps, [*steps[1:], 0], strict=True)):
        e = model.emit[items[at : at + m]]
        alpha = (model.start[None, :] if alpha is None else alpha[:m] @ model.move) * e
        if t % EVERY == 0:
            scale = alpha.sum(axis=1)
            alpha /= scale[:, None]
            total[:m] += np.log(scale)
        if more < m:
            total[more:m] += np.log(alpha[more:].sum(axis=1))
        at += m
    out = np.empty(len(lengths))
    out[order] = total
    return out / np.log(10)


def expectations(model: Model, seq: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected starts, moves and emissions (classes x states) over class sequences: scaled forward-backward.

    Emissions are scaled to a largest of 1 for each token, rows of both recursions every EVERY steps; the state
    probabilities of each token, and of each token with the one before, are then brought to a sum of 1.
    """
    _, alive, items = by_time(seq, lengths)
    begin = np.concatenate([[0], np.cumsum(alive)]).tolist()
    last = len(alive) - 1
    start, move = model.start.astype(np.float32), model.move.astype(np.float32)
    back = np.ascontiguousarray(move.T)
    e = (model.emit / model.emit.max(axis=1, keepdims=True)).astype(np.float32)[items]
    alpha = np.empty_like(e)
    x = np.multiply(start, e[: begin[1]], out=alpha[: begin[1]])
    for t in range(1, last + 1):
        y = alpha[begin[t] : begin[t + 1]]
        np.matmul(x[: len(y)], move, out=y)
        y *= e[begin[t] : begin[t + 1]]
        if t % EVERY == 0:
            y /= y.sum(axis=1, keepdims=True)
        x = y
    w = e[begin[last] :]  # from here on e holds emission times what follows
    for t in range(last - 1, -1, -1):
        after = w @ back
        w = e[begin[t] : begin[t + 1]]
        y = w[: len(after)]
        y *= after
        if t % EVERY == 0:
            y /= y.sum(axis=1, keepdims=True)
    moves = np.zeros((len(start), len(start)))
    before = np.arange(begin[1], len(items)) - np.repeat(alive[:-1], alive[1:])  # each later token's predecessor
    ends = np.ones(len(items), dtype=bool)
    ends[before] = False
    for a in range(0, len(before), MOVES_AT_ONCE):
        here, to = before[a : a + MOVES_AT_ONCE], e[begin[1] + a : begin[1] + a + MOVES_AT_ONCE].astype(np.float64)
        state, rest = alpha[here].astype(np.float64), to @ model.move.T
        state /= (state * rest).sum(axis=1, keepdims=True)
        moves += state.T @ to  # in double precision: a sum over so many tokens must not hang on the order of its terms
        alpha[here] = state * rest
    alpha[ends] /= alpha[ends].sum(axis=1, keepdims=True)
    emitted = np.stack([np.bincount(items, weights=alpha[:, s], minlength=CLASSES) for s in range(len(start))], axis=1)
    return alpha[: begin[1]].sum(axis=0, dtype=np.float64), moves * model.move, emitted


def begin_model(n: np.ndarray, states: int, seed: int = 11) -> Model:
    """Uneven emissions around the classes' shares, and states that like to stay."""
    rng = np.random.default_rng(seed)
    share = (n + 1) / (n + 1).sum()
    emit = share[:, None] * rng.gamma(2.0, 0.5, (CLASSES, states))
    move = np.full((states, states), 0.1 / max(states - 1, 1)) + np.eye(states) * (0.9 - 0.1 / max(states - 1, 1)) if states > 1 else np.ones((1, 1))
    return Model(np.full(states, 1 / states), move, emit / emit.sum(axis=0))


def maximise(starts: np.ndarray, moves: np.ndarray, emitted: np.ndarray, share: np.ndarray) -> Model:
    """Parameters from expected counts; every state keeps PRIOR counts by the classes' shares, every move LEAST_MOVE."""
    emit = emitted + PRIOR * share[:, None]
    moves, starts = moves + 0.1 + LEAST_MOVE * moves.sum(axis=1, keepdims=True), starts + 0.1
    return Model(starts / starts.sum(), moves / moves.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def train(ready: DataFrame, n: np.ndarray, states: int = STATES) -> Model:
    """Baum-Welch: ROUNDS over all training documents."""
    spark = ready.sparkSession
    share = (n + 1) / (n + 1).sum()
    model = begin_model(n, states)
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast(model)  # classes x states

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            m = shared.value
            s = len(m.start)
            total = np.zeros((1 + s + CLASSES, s))
            some: list[tuple[np.ndarray, np.ndarray]] = []

            def add(some: list[tuple[np.ndarray, np.ndarray]]) -> None:
                a, b, c = expectations(m, *map(np.concatenate, zip(*some, strict=True)))
                total[0] += a
                total[1 : 1 + s] += b
                total[1 + s :] += c

            for batch in batches:
                for r in batch.to_pylist():
                    lengths = np.frombuffer(r["lengths"], "<u4").astype(np.int64)
                    on = ~np.array(r["held"], dtype=bool)
                    if on.any():
                        some.append((_expand(r["classes"])[np.repeat(on, lengths)], lengths[on]))
                    if sum(len(x) for x, _ in some) >= TOKENS_AT_ONCE:
                        add(some)
                        some = []
            if some:
                add(some)
            row, col = np.nonzero(total > 1e-9)
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int32()), pa.array(col, pa.int32()), pa.array(total[row, col])], ["row", "col", "x"])

        sums = ready.select("held", "lengths", "classes").mapInArrow(expect, "row int, col int, x double").groupBy("row", "col").agg(F.sum("x").alias("x")).toArrow()
        total = np.zeros((1 + states + CLASSES, states))
        total[sums.column("row").to_numpy(), sums.column("col").to_numpy()] = sums.column("x").to_numpy()
        model = maximise(total[0], total[1 : 1 + states], total[1 + states :], share)
        shared.unpersist()
    return model


def score_documents(docs: DataFrame, text: str = "text", states: int = STATES) -> DataFrame:
    """Score whole texts: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    base_score is the smoothed unigram score, score the model's log10 probability of the text. A null text is an empty
    one: its only token is the end. Rows with a null doc_id are scored and learnt from; repeated rows count as often as
    they occur; extra columns are ignored. An empty table gives an empty result.
    """
    table = written(blocks(docs, text), "blocks")
    sums = table.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_train", "n_words"))).first()
    n_train = sums["n_train"]
    counts = written(counted(table, n_train, sums["n_words"]), "counts")
    n, v = class_totals(counts)
    ready = written(prepared(table, counts, n, v), "ready")
    shared = docs.sparkSession.sparkContext.broadcast(train(ready, n, states))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                lengths = np.frombuffer(r["lengths"], "<u4").astype(np.int64)
                logs = forward(shared.value, _expand(r["classes"]), lengths)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["doc_ids"], pa.int64()), pa.array(r["held"], pa.bool_()), pa.array(lengths), pa.array(r["n_known"], pa.int64()), pa.array(r["base"], pa.float64()), pa.array(logs + np.array(r["within"]))],
                    ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
                )

    scored = ready.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score")
