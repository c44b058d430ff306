"""Dark regions of a scene as pixel relations (r, c): closing, shape, outline, and the sea around them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.physics import db_to_linear
from tidewatch.operators import raster

SURROUND_PX = 8
# Length of outline that a border pixel stands for, by 1 + 2 x border pixels beside it + 10 x those across corners.
STEP_LENGTH = {5: 1.0, 7: 1.0, 15: 1.0, 17: 1.0, 25: 1.0, 27: 1.0, 21: math.sqrt(2), 33: math.sqrt(2), 13: (1 + math.sqrt(2)) / 2, 23: (1 + math.sqrt(2)) / 2}
_CROSS = [(-1, 0), (0, -1), (0, 1), (1, 0)]
_CORNERS = [(-1, -1), (-1, 1), (1, -1), (1, 1)]


def _moved(pixels: DataFrame, moves: list[tuple[int, int]], *keep: str) -> DataFrame:
    """Each pixel at each of some offsets from itself."""
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in moves))).alias("d")
    return pixels.select(*keep, "r", "c", each).select(*keep, (F.col("r") + F.col("d.dr")).alias("r"), (F.col("c") + F.col("d.dc")).alias("c"))


def closing(dark: DataFrame, pixels: DataFrame) -> DataFrame:
    """Dark pixels (r, c) with gaps of one pixel closed: grown by the 3 x 3 neighbourhood within the raster, then shrunk.

    pixels: the raster (r, c, land); land is never dark. What lies beyond the raster isn't dark, so dark pixels at its rim
    are lost, as those of a scene that is cut off.
    """
    around = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    rim = pixels.agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"))  # one row
    grown = _moved(dark, around).distinct().join(F.broadcast(rim)).where("r BETWEEN r0 AND r1 AND c BETWEEN c0 AND c1").select("r", "c")
    whole = _moved(grown, around).groupBy("r", "c").count().where(F.col("count") == len(around)).select("r", "c")
    return whole.hint("merge").join(pixels.where(~F.col("land")).select("r", "c"), ["r", "c"], "left_semi")


def border(region: DataFrame, key: str = "label") -> DataFrame:
    """Pixels (key, r, c) with one of their four neighbours outside of their region."""
    beside = _moved(region, _CROSS, key).groupBy(key, "r", "c").agg(F.count("*").alias("n"))
    return region.hint("merge").join(beside.where("n = 4"), [key, "r", "c"], "left_anti").select(key, "r", "c")


def outline(region: DataFrame, pixel_km: float, key: str = "label") -> DataFrame:
    """Perimeter (pixels), compactness 4 pi A / P squared (at most 1), box and box elongation, log10 of the area (km2)."""
    edge = border(region, key)
    near = lambda moves, name: _moved(edge, moves, key).groupBy(key, "r", "c").agg(F.count("*").alias(name))
    met = edge.hint("merge").join(near(_CROSS, "beside"), [key, "r", "c"], "left").join(near(_CORNERS, "across").hint("merge"), [key, "r", "c"], "left")
    code = 1 + 2 * F.coalesce("beside", F.lit(0)) + 10 * F.coalesce("across", F.lit(0))
    length = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in STEP_LENGTH.items() for x in kv)), code.cast("int")), F.lit(0.0))
    around = met.groupBy(key).agg(F.sum(length).alias("perimeter"))
    box = region.groupBy(key).agg(F.count("*").alias("pixels"), *(f(x).alias(f"{x}{n}") for x in ("r", "c") for n, f in ((0, F.min), (1, F.max))))
    p = F.when(F.col("perimeter") == 0, 1.0).otherwise(F.col("perimeter"))
    high, wide = F.col("r1") - F.col("r0") + 1, F.col("c1") - F.col("c0") + 1
    return box.join(around.hint("merge"), key).select(
        key, "pixels", p.alias("perimeter"), F.least(F.lit(1.0), 4 * math.pi * F.col("pixels") / (p * p)).alias("compactness"), "r0", "c0", "r1", "c1",
        (F.greatest(high, wide) / F.least(high, wide)).alias("box_elongation"), F.log10(F.greatest(F.col("pixels") * pixel_km * pixel_km, F.lit(1e-6))).alias("log_area"),
    )


def surroundings(region: DataFrame, sea: DataFrame, dark: DataFrame, key: str = "label", reach: int = SURROUND_PX) -> DataFrame:
    """Mean power of the sea up to `reach` steps around each region, and how much darker the region is.

    Other dark pixels don't count as sea, unless nothing else is there. sea: r, c, db. Null where no sea is around.
    """
    side = 64 - 2 * reach  # columns of a run: one long holds them and what lies `reach` columns to either side
    if side < 1:
        raise ValueError("a reach of at most 31 steps")
    bits = lambda name="c": F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(name, F.lit(side)).cast("int")))
    run = F.floor(F.col("c") / side).alias("run")
    own = region.groupBy(key, "r", run).agg(bits().alias("own"))
    left, right = (lambda x, n: F.shiftleft(x, n) if n else x), (lambda x, n: F.shiftrightunsigned(x, n) if n else x)
    # each row of a run, widened, reaches the rows around it: less far, the further they are
    wide, grown = left(F.col("own"), reach), []
    for n in range(reach + 1):
        ahead = [left(wide, k) for k in range(1, n + 1)] + [right(wide, k) for k in range(1, n + 1)]
        mask = wide
        for m in ahead:
            mask = mask.bitwiseOR(m)
        grown.append(mask.alias(f"m{n}"))
    masks = own.select(key, "r", "run", *grown)
    one = (1 << side) - 1
    parts = [F.struct((F.col("r") + dr).alias("r"), (F.col("run") + go).alias("run"), m.alias("ring")) for dr in range(-reach, reach + 1) for m0 in [F.col(f"m{reach - abs(dr)}")] for go, m in (
        (-1, left(m0.bitwiseAND(F.lit((1 << reach) - 1)), side - reach)), (0, right(m0, reach).bitwiseAND(F.lit(one))), (1, right(m0, reach + side)))]
    spread = masks.select(key, F.explode(F.array(*parts)).alias("p")).select(key, "p.*").where("ring <> 0")
    ring = spread.groupBy(key, "r", "run").agg(F.bit_or("ring").alias("ring"))
    asked = ring.unionByName(own.withColumnRenamed("own", "self"), allowMissingColumns=True).groupBy(key, "r", "run").agg(F.coalesce(F.max("ring"), F.lit(0).cast("long")).alias("ring"), F.coalesce(F.max("self"), F.lit(0).cast("long")).alias("self"))
    others = dark.select("r", "c").groupBy("r", run).agg(bits().alias("dark"))
    held = sea.select("r", run, F.struct(F.pmod("c", F.lit(side)).cast("int").alias("at"), db_to_linear(F.col("db")).alias("power")).alias("p")).groupBy("r", "run").agg(F.collect_list("p").alias("sea"))
    level = held.join(others.hint("merge"), ["r", "run"], "left").select("r", "run", "sea", F.coalesce("dark", F.lit(0).cast("long")).alias("dark"))
    met = asked.join(level.hint("merge"), ["r", "run"])
    on = lambda mask: F.filter("sea", lambda p: F.call_function("getbit", mask, p["at"]) == 1)
    total = lambda some: F.aggregate(some, F.lit(0.0), lambda t, p: t + F.coalesce(p["power"], F.lit(0.0)))
    valued = lambda some: F.size(F.filter(some, lambda p: p["power"].isNotNull()))
    around = F.col("ring").bitwiseAND(F.bitwise_not("self"))
    sums = met.select(key, on(around.bitwiseAND(F.bitwise_not("dark"))).alias("clear"), on(around).alias("any"), on(F.col("self")).alias("own"))
    mean = sums.groupBy(key).agg(*(x for n in ("clear", "any", "own") for x in ((F.sum(total(n)) / F.nullif(F.sum(valued(n)), F.lit(0))).alias(n), F.sum(F.size(n)).alias(f"{n}_pixels")))).where("own_pixels > 0")
    level = F.coalesce("clear", "any")
    return mean.select(key, (10 * F.log10(level)).alias("surround_db"), (F.col("own") / level).alias("damping_ratio"), F.coalesce("clear_pixels", F.lit(0)).cast("long").alias("clear_pixels"))


def extract(pixels: DataFrame, threshold: float, pixel_km: float, min_area_km2: float) -> DataFrame:
    """Every dark region of a scene that is large enough, with its measures; the largest first by area_km2.

    pixels: r, c, db, p (probability of oil), land. Threshold, closing, components of eight neighbours, area filter, shape
    from moments, outline, surroundings.
    """
    sea = pixels.where(~F.col("land"))
    dark = closing(sea.where(F.col("p") >= threshold).select("r", "c"), pixels)
    labelled = raster.components(dark)
    least = max(4, round(min_area_km2 / pixel_km**2))
    large = labelled.groupBy("label").count().where(F.col("count") >= least).select("label")
    region = labelled.hint("merge").join(large, "label", "left_semi")
    valued = region.hint("merge").join(pixels.select("r", "c", "db", "p"), ["r", "c"])
    shape = raster.regions(valued, pixel_km)
    trust = valued.groupBy("label").agg(F.avg("p").alias("mean_confidence"))
    more = outline(region, pixel_km).drop("pixels")
    # joined by shuffles throughout: what is read back is small on disk for the rows it holds, and would go through the driver
    around = surroundings(region, sea.select("r", "c", "db"), dark)
    return shape.join(more.hint("merge"), "label").join(around.hint("merge"), "label", "left").join(trust.hint("merge"), "label")


def trace(rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """The longest outline of a region's pixels at half height, as (row, col) vertices between pixels; the last is the first.

    Every square of four pixel centres that the outline crosses adds a step between the middles of two of its sides;
    steps keep the region on their left. Where two region pixels touch by a corner only, they are apart.
    """
    inside = set(zip(rows.tolist(), cols.tolist(), strict=True))
    step: dict[tuple[float, float], tuple[float, float]] = {}
    for r, c in {(r - a, c - b) for r, c in inside for a in (0, 1) for b in (0, 1)}:
        ul, ur, ll, lr = ((r + a, c + b) in inside for a in (0, 1) for b in (0, 1))
        top, left, right, bottom = (r, c + 0.5), (r + 0.5, c), (r + 0.5, c + 1), (r + 1, c + 0.5)
        corners = ((ul, top, left), (ll, left, bottom), (lr, bottom, right), (ur, right, top))
        if sum(x for x, _, _ in corners) == 2 and ul == lr:  # two that touch by a corner: a step round each
            for on, a, b in corners:
                if on:
                    step[a] = b
            continue
        # going round the square, the step leads from where the region ends to where it begins
        for (on, _, side), (after, _, _) in zip(corners, corners[1:] + corners[:1], strict=True):
            if not on and after:
                start = side
            if on and not after:
                end = side
        if 0 < sum(x for x, _, _ in corners) < 4:
            step[start] = end
    best: list[tuple[float, float]] = []
    while step:
        first, at = step.popitem()
        ring = [first]
        while at != first:
            ring.append(at)
            at = step.pop(at)
        best = ring if len(ring) > len(best) else best
    return np.array([*best, best[0]]) if best else np.zeros((0, 2))


def simplified(ring: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker: points nearer than `tolerance` to the line between kept ones are left out; the ends stay."""
    keep = np.zeros(len(ring), dtype=bool)
    keep[[0, -1]] = True
    todo = [(0, len(ring) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        p, d = ring[a + 1 : b] - ring[a], ring[b] - ring[a]
        size = np.hypot(*d)
        far = np.abs(p[:, 0] * d[1] - p[:, 1] * d[0]) / size if size > 0 else np.hypot(*p.T)
        k = int(far.argmax())
        if far[k] > tolerance:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return ring[keep]


def contours(region: DataFrame, box: tuple[float, float, float, float], rows: int, cols: int, tolerance: float = 1.5) -> DataFrame:
    """(label, wkt): each region's longest outline, simplified, in the scene's west, south, east, north; row 0 is north.

    A region's pixels meet in one task; their number is bounded by the scene's.
    """
    west, south, east, north = box

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ring = trace(pdf["r"].to_numpy(), pdf["c"].to_numpy())
        ring = simplified(ring, tolerance) if len(ring) > 8 else ring
        lon, lat = west + ring[:, 1] / max(cols - 1, 1) * (east - west), north - ring[:, 0] / max(rows - 1, 1) * (north - south)
        text = ", ".join(f"{x:.6f} {y:.6f}" for x, y in zip(lon, lat, strict=True))
        return pd.DataFrame({"label": [pdf["label"].iloc[0]], "vertices": [len(ring)], "wkt": [f"POLYGON (({text}))" if len(ring) > 3 else "POLYGON EMPTY"]})

    return region.select("label", "r", "c").groupBy("label").applyInPandas(run, "label long, vertices long, wkt string")


def pixel_window(box: Column, scene: tuple[float, float, float, float], rows: int, cols: int) -> Column:
    """An annotation's box (west, south, east, north as a struct) as rows and columns of a scene, north up; null below 4 pixels."""
    west, south, east, north = scene
    wide, high = max(east - west, 1e-9), max(north - south, 1e-9)
    whole = lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("int")  # noqa: E731  toward zero
    c0, c1 = (whole((box[x] - west) / wide * cols) for x in ("west", "east"))
    r0, r1 = (whole((1.0 - (box[x] - south) / high) * rows) for x in ("north", "south"))
    r0, r1 = F.greatest(F.lit(0), F.least(r0, r1)), F.least(F.lit(rows), F.greatest(r0, r1))
    c0, c1 = F.greatest(F.lit(0), F.least(c0, c1)), F.least(F.lit(cols), F.greatest(c0, c1))
    window = F.struct(r0.alias("r0"), c0.alias("c0"), r1.alias("r1"), c1.alias("c1"))
    return F.when((r1 - r0 >= 4) & (c1 - c0 >= 4), window)
