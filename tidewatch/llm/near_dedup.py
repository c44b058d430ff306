"""Near-duplicate documents by ProbMinHash, banding and verification.

A text's five-word shingles are weighted 1 + ln(times). For each shingle a Poisson process, seeded by the shingle, sends
arrivals at the rate of its weight to random registers; each register keeps the shingle that arrives first. Drawing
stops for a shingle once its next arrival is later than the latest of the registers' first arrivals. Two signatures
agree in a register with the probability Jaccard similarity of the texts. A text that repeats shingles has a second
signature, with all weights 1, whose registers agree with the plain Jaccard similarity; where nothing repeats both are
the same. Equal texts form one class with one representative. Bands of registers put representatives into buckets; within a bucket each is compared to the bucket's
smallest member and to its neighbours by the next band, which is linear in the bucket whatever its size. Each pair is
verified on its shingles: it is linked if the probability Jaccard or the plain Jaccard of the shingle sets reaches the
threshold. Components of links are the groups of near duplicates. Rows that share a bucket with a group they are not in
are then compared to all of it, in tiles that give out links only: no pair that shares a bucket goes unverified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import bounded_batches, claim, mix, slices, text_bytes, trimmed, words, written
from tidewatch.llm.components import components

WORDS, BANDS, ROWS = 5, 25, 5
REGISTERS = BANDS * ROWS
#: Neighbours in a bucket are sought among about so many rows at a time.
NEIGHBOURS = 4096
#: Ids up to this number are broadcast as a filter (8 bytes each, checked by a count); beyond, the join shuffles.
BROADCAST_IDS = 2_000_000
#: Shingles that one side of a compared tile holds, in bytes.
TILE_BYTES = 2 << 20
_U = np.uint64
_PLACE = mix(np.arange(11, 11 + WORDS, dtype=_U)) | _U(1)
_BITS = 32


def shingles(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of texts laid end to end: text number, 32-bit hash and count, sorted by text and hash.

    A text of one to four words is one shingle; a text without words has none.
    """
    _, _, owner, code = words(raw, at)
    n_texts = len(at) - 1
    first = np.searchsorted(owner, np.arange(n_texts + 1))
    count = np.diff(first)
    if len(code) >= WORDS:
        n = len(code) - WORDS + 1
        h = np.zeros(n, dtype=_U)
        for k in range(WORDS):
            h += code[k : k + n] * _PLACE[k]
        inside = owner[:n] == owner[WORDS - 1 :]
        h, text = h[inside], owner[:n][inside]
    else:
        h, text = np.zeros(0, _U), np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < WORDS))
    if len(short):
        extra = np.array([np.sum(code[first[i] : first[i + 1]] * _PLACE[: count[i]]) + _U(count[i]) for i in short], dtype=_U)
        h, text = np.concatenate([h, extra]), np.concatenate([text, short])
    key = np.sort((text.astype(_U) << _U(_BITS)) | (mix(h) >> _U(64 - _BITS)))
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    begin = np.flatnonzero(new)
    return (key[begin] >> _U(_BITS)).astype(np.int64), key[begin] & _U((1 << _BITS) - 1), np.diff(np.append(begin, len(key)))


def weight(times: np.ndarray) -> np.ndarray:
    return 1 + np.log(times)


def signatures(text: np.ndarray, shingle: np.ndarray, w: np.ndarray, n_texts: int, registers: int = REGISTERS) -> np.ndarray:
    """ProbMinHash registers (n_texts x registers) of weighted shingles; rows of texts without shingles stay 0."""
    sig = np.zeros(n_texts * registers, dtype=_U)
    arrived = np.full(n_texts * registers, np.inf)
    when, turn = np.zeros(len(text)), 0
    while len(text):
        turn += 1
        draw = mix(shingle + _U(turn * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        when = when - np.log(((draw >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53) / w
        slot = text * registers + (mix(draw) % _U(registers)).astype(np.int64)
        np.minimum.at(arrived, slot, when)
        won = when == arrived[slot]
        sig[slot[won]] = shingle[won]
        latest = arrived.reshape(n_texts, registers).max(axis=1)
        live = when < latest[text]
        text, shingle, w, when = text[live], shingle[live], w[live], when[live]
    return sig.reshape(n_texts, registers)


def bands(sig: np.ndarray) -> np.ndarray:
    """One 64-bit number per band (n x BANDS), different from band to band."""
    place = mix(np.arange(101, 101 + ROWS, dtype=_U)) | _U(1)
    parts = sig.reshape(len(sig), BANDS, ROWS)
    total = np.zeros((len(sig), BANDS), dtype=_U)
    for k in range(ROWS):
        total += mix(parts[:, :, k]) * place[k]
    return mix(total + np.arange(BANDS, dtype=_U)[None, :] * _U(0x9E3779B97F4A7C15)).view(np.int64)


def buckets(owner: np.ndarray, h: np.ndarray, times: np.ndarray, n: int) -> list[tuple[list[int], list[int]]]:
    """For each text its distinct bands, and for each of them the next band: by weights, then by the set where it differs.

    A text without repeated shingles has the same signature either way, so one namespace of bands serves both.
    """
    by_weight = bands(signatures(owner, h, weight(times), n))
    repeats = np.bincount(owner[times > 1], minlength=n) > 0
    on = repeats[owner]
    place = np.cumsum(repeats) - 1
    by_set = bands(signatures(place[owner[on]], h[on], np.ones(on.sum()), int(repeats.sum()))) if on.any() else None
    filled = np.bincount(owner, minlength=n) > 0
    out = []
    for i in range(n):
        own: dict[int, int] = {}
        for row in (by_weight[i] if filled[i] else None, by_set[place[i]] if repeats[i] else None):
            if row is not None:
                for band, following in zip(row.tolist(), np.roll(row, -1).tolist(), strict=True):
                    own.setdefault(band, following)
        out.append((list(own), list(own.values())))
    return out


def sketch(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per row of docs: row_id, doc_id, text_key, bands, nexts, shingles and times (32-bit numbers, packed)."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("near_dedup")
        for whole in batches:
            for batch in slices(whole, "text"):
                n = batch.num_rows
                owner, h, times = shingles(*text_bytes(batch.column("text")))
                found = buckets(owner, h, times, n)
                low, at = h.astype("<u4"), np.searchsorted(owner, np.arange(n + 1))
                many = times.astype("<u4")
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c) for c in ("row_id", "doc_id", "text_key")),
                        *(pa.array([x[k] for x in found], pa.list_(pa.int64())) for k in (0, 1)),
                        pa.array([low[at[i] : at[i + 1]].tobytes() for i in range(n)], pa.binary()),
                        pa.array([many[at[i] : at[i + 1]].tobytes() for i in range(n)], pa.binary()),
                    ],
                    ["row_id", "doc_id", "text_key", "bands", "nexts", "shingles", "times"],
                )

    chosen = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long"), F.md5(F.col(text).cast("binary")).alias("text_key"), F.col(text).cast("string").alias("text"))
    return chosen.mapInArrow(trimmed(run), "row_id long, doc_id long, text_key string, bands array<long>, nexts array<long>, shingles binary, times binary")


def similar(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """The larger of the probability Jaccard of two weighted sets (sorted, distinct) and the Jaccard of the sets."""
    both, at_a, at_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    plain = len(both) / (len(a) + len(b) - len(both))
    if (wa == 1).all() and (wb == 1).all():
        return plain
    # for a shared element i: the sum over all j of max(wa[j] / wa[i], wb[j] / wb[i]), by ratios r[j] = wa[j] / wb[j] in order
    union = np.union1d(a, b)
    x, y = np.zeros(len(union)), np.zeros(len(union))
    x[np.searchsorted(union, a)], y[np.searchsorted(union, b)] = wa, wb
    with np.errstate(divide="ignore"):
        ratio = np.where(y > 0, x / np.where(y > 0, y, 1), np.inf)
    order = np.argsort(ratio, kind="stable")
    ys = np.concatenate([[0], np.cumsum(y[order])])
    xs = np.concatenate([[0], np.cumsum(x[order])])
    own = wa[at_a] / wb[at_b]
    k = np.searchsorted(ratio[order], own, side="right")  # up to k, y / wb[i] is the larger
    total = ys[k] / wb[at_b] + (xs[-1] - xs[k]) / wa[at_a]
    return max(plain, float(np.sum(1 / total)))


def verified(pairs: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """Of pairs (a, b) of row ids those whose shingles are similar enough."""
    ids = pairs.select(F.col("a").alias("row_id")).union(pairs.select("b")).distinct()
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    sets = sketches.select("row_id", "shingles", "times").join(ids, "row_id", "left_semi")
    side = lambda x: sets.select(F.col("row_id").alias(x), F.col("shingles").alias(f"s{x}"), F.col("times").alias(f"t{x}"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("near_dedup")
        for batch in batches:
            cols = [[np.frombuffer(x.as_buffer(), dtype="<u4") for x in batch.column(c)] for c in ("sa", "ta", "sb", "tb")]
            ok = [similar(a, weight(ta), b, weight(tb)) >= threshold for a, ta, b, tb in zip(*cols, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(trimmed(check), "a long, b long")


def tile_links(x: pa.Table, y: pa.Table, bucket: int, threshold: float) -> tuple[list[int], list[int]]:
    """Links between rows of x and of y in one bucket, for pairs of different components, in the least bucket they share.

    A row gets one link to each component at most: the others join nothing more. Shared weight is an upper bound of the
    probability Jaccard (an element adds at most its smaller share of the two totals), so only pairs that reach the
    threshold by it or by the plain Jaccard are compared in full.
    """
    sets = [np.frombuffer(v.as_buffer(), dtype="<u4") for v in y.column("shingles")]
    weights = [weight(np.frombuffer(v.as_buffer(), dtype="<u4")) for v in y.column("times")]
    size = np.array([len(v) for v in sets])
    at = np.concatenate([[0], np.cumsum(size)[:-1]])
    flat, share = np.concatenate(sets), np.concatenate([w / w.sum() for w in weights])
    ids, component, outside = (y.column(c).to_numpy() for c in ("row_id", "component", "outside"))
    listed = y.column("bands").combine_chunks()
    of_y, begin = listed.flatten().to_numpy(), np.diff(listed.offsets.to_numpy())
    begin = np.cumsum(begin) - begin
    found_a, found_b = [], []
    for i, x_bands in enumerate(x.column("bands").to_pylist()):
        me, mine = x.column("row_id")[i].as_py(), x.column("component")[i].as_py()
        least = np.minimum.reduceat(np.where(np.isin(of_y, x_bands), of_y, np.iinfo(np.int64).max), begin)
        wanted = (least == bucket) & (component != mine) & (~outside | (ids > me))  # a pair that shares several buckets is compared in the least
        if not wanted.any():
            continue
        own = np.frombuffer(x.column("shingles")[i].as_buffer(), dtype="<u4")
        w = weight(np.frombuffer(x.column("times")[i].as_buffer(), dtype="<u4"))
        place = np.minimum(np.searchsorted(own, flat), len(own) - 1)
        hit = own[place] == flat
        both = np.add.reduceat(hit.astype(np.int64), at)
        most = np.add.reduceat(np.where(hit, np.minimum(share, (w / w.sum())[place]), 0.0), at)
        plain = both / (size + len(own) - both)
        joined: set[int] = set()
        for j in np.flatnonzero(wanted & (np.maximum(plain, most) >= threshold - 1e-9)):
            if int(component[j]) not in joined and similar(own, w, sets[j], weights[j]) >= threshold:
                joined.add(int(component[j]))
                found_a.append(min(me, int(ids[j])))
                found_b.append(max(me, int(ids[j])))
    return found_a, found_b


def joined_up(labels: DataFrame, crowded: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """Components once all pairs that share a bucket but no component are verified too.

    What the linear pass leaves in a bucket is mostly one component and a few rows beside it. Each row outside the
    bucket's main component is compared to all rows of other components. Both sides are dealt into blocks of about
    TILE_BYTES, and a block of one side against a block of the other is a task's unit, whatever the bucket's size;
    only links leave it, no pairs.
    """
    of = labels.select(F.col("node").alias("row_id"), "component")
    known = crowded.select("bucket", "row_id").join(of, "row_id", "left").withColumn("component", F.coalesce("component", "row_id"))
    sizes = known.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("k")).where("k > 1").drop("k")
    rows = written(known.join(mixed, "bucket").select("bucket", "row_id", "component", (F.col("component") != F.col("main")).alias("outside")), "mixed")
    ids = rows.select("row_id").distinct()
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    sets = written(sketches.select("row_id", "bands", "shingles", "times").join(ids, "row_id", "left_semi"), "sets")
    sized = written(rows.join(sets.select("row_id", (F.octet_length("shingles") + F.octet_length("times")).alias("bytes")), "row_id"), "sized")
    blocks = lambda c: F.ceil(F.greatest(F.sum(c), F.lit(1)) / TILE_BYTES).cast("int")
    dealt = sized.groupBy("bucket").agg(blocks(F.when(F.col("outside"), F.col("bytes"))).alias("across"), blocks("bytes").alias("down"))
    placed = sized.drop("bytes").join(dealt, "bucket")
    block = lambda n: F.pmod(F.xxhash64("row_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asking = placed.where("outside").select("bucket", "row_id", "component", "outside", F.lit(True).alias("asks"), block("across").alias("i"), every("down").alias("j"))
    asked = placed.select("bucket", "row_id", "component", "outside", F.lit(False).alias("asks"), block("down").alias("j"), every("across").alias("i"))
    tiles = asking.unionByName(asked).join(sets, "row_id")

    def compare(key, tile):
        claim("near_dedup")
        asks = tile.column("asks")
        x, y = tile.filter(asks), tile.filter(pc.invert(asks))
        a, b = tile_links(x, y, key[0].as_py(), threshold) if x.num_rows and y.num_rows else ([], [])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    more = written(tiles.groupBy("bucket", "i", "j").applyInArrow(compare, "a long, b long"), "links")
    if more.isEmpty():
        return labels
    end = lambda c: of.select(F.col("row_id").alias(c), F.col("component").alias(f"c{c}"))
    between = more.join(end("a"), "a", "left").join(end("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    merged = components(between).select(F.col("node").alias("component"), F.col("component").alias("into"))
    ends = more.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    nodes = labels.unionByName(ends.join(labels, "node", "left_anti").withColumn("component", F.col("node")))
    return nodes.join(merged, "component", "left").select("node", F.coalesce("into", "component").alias("component"))


def near_duplicates(docs: DataFrame, threshold: float = 0.8, text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, text_key, class_id, component_id, kept.

    class_id is the smallest doc_id with the same text, component_id the smallest doc_id of its group of near duplicates,
    kept marks one row of each group. Null texts are alone, each kept; empty texts are equal texts. Texts without words
    are near nothing but equal ones. Repeated rows and null doc_ids (larger than any other) stay; a group of null
    doc_ids has null ids. Extra columns are ignored; an empty table gives an empty result.
    """
    sketches = written(sketch(docs, text), "sketch")
    rows = sketches.select("row_id", "doc_id", "text_key")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_id"))
    classes = written(rows.where("text_key IS NOT NULL").groupBy("text_key").agg(first.alias("first")).select("text_key", F.col("first.doc_id").alias("class_id"), F.col("first.row_id").alias("rep")), "classes")

    reps = classes.select(F.col("rep").alias("row_id"))
    each = F.explode(F.arrays_zip("bands", "nexts")).alias("e")
    members = written(sketches.join(reps, "row_id", "left_semi").select("row_id", each).select("row_id", F.col("e.bands").alias("bucket"), F.col("e.nexts").alias("next")), "bands")
    hubs = members.groupBy("bucket").agg(F.min("row_id").alias("hub"), F.count("*").alias("n")).where("n > 1")
    crowded = written(members.join(hubs, "bucket"), "crowded")
    # rows of a large bucket are dealt to runs of about NEIGHBOURS; what two runs part meets by the hub or in the second pass
    run = F.when(F.col("n") > NEIGHBOURS, F.pmod(F.xxhash64("next", "row_id"), F.ceil(F.col("n") / NEIGHBOURS))).otherwise(F.lit(0))
    near = Window.partitionBy("bucket", run).orderBy("next", "row_id")
    reached = crowded.select("row_id", F.array("hub", F.lag("row_id", 1).over(near), F.lag("row_id", 2).over(near)).alias("others"))
    tested = written(reached.select(F.explode("others").alias("o"), "row_id").where("o IS NOT NULL AND o <> row_id").select(F.least("o", "row_id").alias("a"), F.greatest("o", "row_id").alias("b")).distinct(), "pairs")
    found = components(verified(tested, sketches, threshold))
    found = joined_up(found, crowded, sketches, threshold).withColumnRenamed("node", "rep")
    grouped = classes.join(found, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    smallest = grouped.groupBy("component").agg(F.min(F.struct(F.col("class_id").isNull().alias("none"), "class_id", "rep")).alias("first"))
    named = grouped.join(smallest, "component").select("text_key", "class_id", F.col("first.class_id").alias("component_id"), F.col("first.rep").alias("keeper"))
    out = rows.where("text_key IS NOT NULL").join(named, "text_key").select("doc_id", "text_key", "class_id", "component_id", (F.col("row_id") == F.col("keeper")).alias("kept"))
    alone = rows.where("text_key IS NULL").select("doc_id", "text_key", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return out.unionByName(alone)


def deduplicate(docs: DataFrame, threshold: float = 0.8, text: str = "text") -> DataFrame:
    """The rows of docs without all but one of each group of near duplicates, with the columns of docs, whatever their names.

    Rows with a null text are alone and stay. Empty texts are one group. Of rows repeated whole one stays. Null doc_ids come after all
    others where one of a group is chosen. An empty table gives an empty one.
    """
    names = docs.columns
    plain = docs.toDF(*(f"_{k}" for k in range(len(names))))  # the names of docs can't clash with those used here
    doc_id, body = f"_{names.index('doc_id')}", f"_{names.index(text)}"
    found = written(near_duplicates(docs, threshold, text).where("text_key IS NOT NULL").select("doc_id", "text_key", "kept"), "groups")
    counted = found.groupBy("doc_id", "text_key").agg(F.count("*").alias("n"), F.max("kept").alias("kept"))
    keyed = plain.withColumn("key", F.md5(F.col(body).cast("binary")))

    def only(rows: DataFrame, which: DataFrame, how: str) -> DataFrame:
        which = which.select(F.col("doc_id").alias("of_doc"), F.col("text_key").alias("of_text"))
        if which.count() <= BROADCAST_IDS:
            which = F.broadcast(which)
        return rows.join(which, rows[doc_id].eqNullSafe(which["of_doc"]) & (rows["key"] == which["of_text"]), how)

    left = only(keyed, counted.where("NOT kept"), "left_anti")
    repeated = counted.where("kept AND n > 1")  # rows repeated whole: one stays
    if not repeated.isEmpty():
        left = only(left, repeated, "left_anti").unionByName(only(left, repeated, "left_semi").dropDuplicates([doc_id, "key"]))
    return left.drop("key").toDF(*names)
