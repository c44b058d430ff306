"""Near-duplicate embeddings by PCA-ordered tiled comparison.

Unit vectors are turned onto the principal axes of all vectors, so that leading coordinates carry most of a product.
Vectors are laid out by their first coordinate in tiles of bounded size. Two tiles meet unless their first coordinates
lie too far apart for the threshold. For two tiles the product of the leading coordinates is added up first, and what
the others can still add is bounded by the product of the suffix norms; the pair is given up when the sum can't reach
the threshold. Pairs that pass go on with more coordinates, and the last step is the cosine in double precision.

Equal vectors are one class with a count. A pair of tiles returns, for each vector with links, their number and one
vector that it is connected to, never the links themselves, so a large group of copies costs no more rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import bounded_batches, written
from tidewatch.llm.components import components

#: Vectors in a tile at most (two tiles and what is made of them are what a task holds), and at least; and how many tiles are wanted below
#: the limit, for enough pairs of them to go round. Every pair of tiles is shuffled, so the fewer there are the less is.
TILE, LEAST_TILE, TILES = 32_768, 1_024, 12
#: Products that one step of a comparison holds.
PRODUCTS = 1 << 22
LEADING = (16, 32)
#: What rounding of 32-bit products of unit vectors can add up to, many times over.
SLACK = 1e-4


def principal_axes(classes: DataFrame, dims: int) -> np.ndarray:
    """Axes (columns) of all unit vectors' second moments, largest first; sums are made in Spark, dims x dims numbers return."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            u = _unit(_rows(batch.column("vector"), dims))
            total += u.T @ u
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()])], ["m"])

    sums = classes.select("vector").mapInArrow(moments, "m array<double>").select(F.posexplode("m").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x")).collect()
    flat = np.zeros(dims * dims)
    for r in sums:
        flat[r["k"]] = r["x"]
    values, vectors = np.linalg.eigh(flat.reshape(dims, dims))
    return vectors[:, np.argsort(values)[::-1]]


def _rows(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True) if len(x) else x  # squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def connect(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node that each of n nodes reaches over links a, b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def compare(u: np.ndarray, v: np.ndarray, turned_u: np.ndarray, turned_v: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) with a cosine of at least `threshold`, a block at a time; `same`: u is v, i < j."""
    dims = u.shape[1]
    steps = [k for k in LEADING if k < dims]

    def lead(x: np.ndarray, k: int) -> np.ndarray:
        return np.concatenate([x[:, :k], np.sqrt((x[:, k:] ** 2).sum(axis=1, keepdims=True))], axis=1).astype(np.float32)

    us, vs = [lead(turned_u, k) for k in steps], [lead(turned_v, k) for k in steps]
    block = max(16, min(512, PRODUCTS // max(1, len(v))))
    for at in range(0, len(u), block):
        stop = min(at + block, len(u))
        first = at if same else 0
        if steps:
            reach = us[0][at:stop] @ vs[0][first:].T  # leading products, and the suffix norms' product as one more
            flat = np.flatnonzero(reach >= threshold - SLACK)
            i, j = flat // reach.shape[1] + at, flat % reach.shape[1] + first
        else:
            i, j = (x.ravel() for x in np.meshgrid(np.arange(at, stop), np.arange(first, len(v)), indexing="ij"))
        if same:
            i, j = i[i < j], j[i < j]
        for s in range(0, len(i), 1 << 16):
            ii, jj = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
            for x, y in zip(us[1:], vs[1:], strict=True):
                on = np.einsum("ij,ij->i", x[ii], y[jj]) >= threshold - SLACK
                ii, jj = ii[on], jj[on]
            on = np.einsum("ij,ij->i", u[ii], v[jj]) >= threshold
            if on.any():
                yield ii[on], jj[on]


def tile_size(n: int) -> int:
    """Vectors in a tile of n vectors."""
    return min(TILE, max(LEAST_TILE, -(-n // TILES)))


def _linked(classes: DataFrame, dims: int, threshold: float, kind: type = np.float64) -> DataFrame:
    """Rows (node, links, root) over the classes of one dimension: partial link counts and connections.

    kind: the type that holds the vectors' components without loss; tiles carry them in it.
    """
    spark = classes.sparkSession
    axes = spark.sparkContext.broadcast(principal_axes(classes, dims))  # dims x dims

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _rows(batch.column("vector"), dims)
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("n"), pa.array((_unit(x) @ axes.value[:, 0])), pa.array([v.tobytes() for v in x.astype(kind)], pa.binary())], ["node", "n", "y", "vector"])

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, part, k = [], TaskContext.get().partitionId(), 0

        def cut(rows: pa.Table) -> pa.RecordBatch:
            y = rows.column("y").to_numpy()
            data = b"".join(rows.column("vector").to_pylist())
            values = [part * (1 << 32) + k, float(y.min()), float(y.max()), rows.column("node").to_numpy().tobytes(), rows.column("n").to_numpy().tobytes(), data]
            types = (pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, types, strict=True)], ["tile", "low", "high", "nodes", "counts", "vectors"])

        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= size:
                rows = pa.Table.from_batches(held)
                yield cut(rows.slice(0, size))
                k, held = k + 1, rows.slice(size).to_batches()
        if sum(b.num_rows for b in held):
            yield cut(pa.Table.from_batches(held))

    placed = classes.mapInArrow(place, "node long, n long, y double, vector binary")
    count = classes.count()
    size = tile_size(count)
    laid = placed.repartitionByRange(max(1, -(-count // size)), "y").sortWithinPartitions("y", "node")
    tiles = written(laid.mapInArrow(tile, "tile long, low double, high double, nodes binary, counts binary, vectors binary"), "tiles")
    ends = tiles.select("tile", "low", "high")
    far = float(np.sqrt(2 - 2 * threshold)) + 1e-9
    bins = lambda margin: F.explode(F.sequence(F.floor(F.col("low") / far) - margin, F.floor(F.col("high") / far) + margin)).alias("bin")
    a, b = ends.select(bins(0), "*").toDF("bin", "a", "low_a", "high_a"), ends.select(bins(1), "*").toDF("bin", "b", "low_b", "high_b")
    close = (F.col("low_b") - F.col("high_a") <= far) & (F.col("low_a") - F.col("high_b") <= far)
    ordered = a.join(b, "bin").where(close).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))  # tiles, not vectors
    meet = written(ordered.distinct(), "meet")
    wanted = meet.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("tile"))
    cells = wanted.join(tiles, "tile").select("a", "b", "tile", "nodes", "counts", "vectors")

    def cell(table: pa.Table) -> pa.Table:
        rows = {r["tile"]: r for r in table.to_pylist()}
        one, two = (rows[table.column(c)[0].as_py()] for c in ("a", "b"))
        same = one is two
        get = lambda r: (np.frombuffer(r["nodes"], np.int64), np.frombuffer(r["counts"], np.int64), _unit(np.frombuffer(r["vectors"], kind).astype(float).reshape(-1, dims)))
        (nodes_u, n_u, u), (nodes_v, n_v, v) = get(one), get(two)
        links, edges = np.zeros(len(u) + len(v), np.int64), []
        shift = 0 if same else len(u)
        for i, j in compare(u, v, u @ axes.value, v @ axes.value, threshold, same):
            np.add.at(links, i, n_v[j])
            np.add.at(links, j + shift, n_u[i])
            root = connect(len(links), i, j + shift)
            moved = np.flatnonzero(root != np.arange(len(root)))
            edges.append((moved, root[moved]))
        if edges:
            root = connect(len(links), *(np.concatenate(x) for x in zip(*edges, strict=True)))
        on = np.flatnonzero(links)
        nodes = np.concatenate([nodes_u, nodes_v])
        return pa.table({"node": nodes[on], "links": links[on], "root": nodes[root[on]] if len(on) else nodes[on]})

    return cells.groupBy("a", "b").applyInArrow(cell, "node long, links long, root long")


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.95, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing. Only vectors of equal
    length link. Repeated rows are vectors of their own, equal to each other. component_id is the smallest vec_id that
    links reach; kept is vec_id = component_id. A null vec_id stays null and names no component of others. Extra columns
    are ignored; an empty table gives an empty result.
    """
    bounded_batches(vectors.sparkSession)
    x = F.col(embedding).cast("array<double>")
    kind = np.float32 if vectors.schema[embedding].dataType.elementType.typeName() == "float" else np.float64
    usable = F.coalesce((F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0), F.lit(False))
    key = [F.xxhash64(F.lit(salt), "vector").alias(f"key{salt}") for salt in (1, 2)]  # 128 bits stand for a vector in joins
    rows = vectors.select(F.monotonically_increasing_id().alias("row_id"), F.col(vec_id).cast("long").alias("vec_id"), F.when(usable, x).alias("vector"))
    rows = written(rows.select("*", *key), "vectors")
    grouped = rows.where("vector IS NOT NULL").groupBy("key1", "key2").agg(F.first("vector").alias("vector"), F.min("row_id").alias("node"), F.count("*").alias("n"), F.min("vec_id").alias("first"))
    classes = written(grouped, "classes")
    found = None
    for r in classes.select(F.size("vector").alias("dims")).distinct().collect():  # one row per length of vectors
        linked = _linked(classes.where(F.size("vector") == r["dims"]).select("node", "n", "vector"), r["dims"], threshold, kind)
        found = linked if found is None else found.unionByName(linked)
    alone = rows.where("vector IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if found is None:
        return alone.withColumn("kept", F.lit(True))
    found = written(found, "linked")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = classes.select("key1", "key2", "node", "n", "first").join(counts, "node", "left").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    every = named.join(smallest, "component").select("key1", "key2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    out = rows.where("vector IS NOT NULL").select("vec_id", "key1", "key2").join(every, ["key1", "key2"]).select("vec_id", "n_links", "component_id")
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("vec_id").isNull()))
