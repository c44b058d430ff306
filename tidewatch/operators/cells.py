"""Range joins on the sphere by equi-joins on grid cells.

Latitude is cut into bands of one height, each band into cells about as wide, so cells stay alike towards the poles and
close around the globe. A grid's level is the power of two, in km, of its bands' height. A target reaches a radius; it is
placed into the cells of the least level not below that radius which its circle can touch, nine at most. A point lies in
one cell of each level. So a pair meets once, if at all, and the number of pairs follows the area of each target's own
reach. Further equality keys, such as time slots, narrow the join before any distance is taken.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KM_PER_DEGREE = 6371.0088 * math.pi / 180.0
#: The column that holds a cell: level, band and number in the band in one long, so that a sort has one key to compare.
CELL = "__place"


def _height(level: Column) -> Column:
    return F.pow(F.lit(2.0), level) / KM_PER_DEGREE


def _around(band: Column, height: Column) -> Column:
    """Cells in a band, of the width of its height where it is narrowest."""
    far = F.least(F.greatest(F.abs(band), F.abs(band + 1)) * height, F.lit(90.0))
    return F.greatest(F.floor(360.0 * F.cos(F.radians(far)) / height), F.lit(1).cast("long"))


def _cell(level: Column, band: Column, cell: Column) -> Column:
    return (level.cast("long") * (1 << 20) + band + (1 << 19)) * (1 << 20) + cell


def covering(lon: Column, lat: Column, reach_km: Column, level: Column) -> Column:
    """The cells that a circle can touch, as an array."""
    height, reach = _height(level), reach_km / KM_PER_DEGREE
    wide = F.when(F.abs(lat) + reach >= 90.0, 180.0).otherwise(F.degrees(F.asin(F.least(F.sin(F.radians(reach)) / F.cos(F.radians(lat)), F.lit(1.0))))) + 1e-9
    bands = F.sequence(F.floor((lat - reach) / height - 1e-9), F.floor((lat + reach) / height + 1e-9))

    def row(band: Column) -> Column:
        n = _around(band, height)
        first = F.floor((lon - wide + 180.0) / 360.0 * n)
        last = F.least(F.floor((lon + wide + 180.0) / 360.0 * n), first + n - 1)
        return F.transform(F.sequence(first, last), lambda cell: _cell(level, band, F.pmod(cell, n)))

    return F.flatten(F.transform(bands, row))


def level_of(reach_km: Column, least: int, most: int) -> Column:
    """The level for a radius; radii beyond 2 ** most km don't belong here."""
    return F.least(F.greatest(F.ceil(F.log2(F.greatest(reach_km, F.lit(1e-3)))), F.lit(least)), F.lit(most)).cast("int")


def place_targets(targets: DataFrame, reach_km: Column, least: int, most: int, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Targets once for each cell that they reach; a null place or radius reaches nothing."""
    levelled = targets.withColumns({"__reach": reach_km, "__level": level_of(reach_km, least, most)})
    return levelled.withColumn(CELL, F.explode(covering(F.col(lon), F.col(lat), F.col("__reach"), F.col("__level")))).drop("__reach", "__level")


def place_points(points: DataFrame, levels: Column, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Points once for each of an array of levels."""
    each = points.withColumn("__level", F.explode(levels))
    banded = each.withColumn("__band", F.floor(F.col(lat) / _height(F.col("__level"))))
    n = _around(F.col("__band"), _height(F.col("__level")))
    cell = F.pmod(F.floor((F.col(lon) + 180.0) / 360.0 * n), n)
    return banded.withColumn(CELL, _cell(F.col("__level"), F.col("__band"), cell)).drop("__level", "__band")


def levels(least: int, most: int) -> Column:
    return F.array(*(F.lit(k) for k in range(least, most + 1)))


def levels_in_use(targets: DataFrame, reach_km: Column, least: int, most: int) -> Column:
    """The levels of these targets' radii (most - least + 1 rows at most return): points needn't lie in cells of any other."""
    used = targets.select(level_of(reach_km, least, most).alias("level")).where("level IS NOT NULL").distinct().collect()
    return F.array(*(F.lit(k) for k in sorted(r["level"] for r in used))).cast("array<int>")


def meet(points: DataFrame, targets: DataFrame, *keys: str) -> DataFrame:
    """Placed points and targets in the same cell, with equal `keys` (columns of both).

    Both sides are shuffled and sorted: Spark's estimate of a side's size doesn't see how often its rows were placed, so
    left to itself it would broadcast what fits no executor. Hot cells are split by adaptive execution.
    """
    return points.join(targets.hint("merge"), [CELL, *keys]).drop(CELL, *keys)


def slot(ts: Column, hours: int) -> Column:
    """The number of a timestamp's stretch of so many hours."""
    return F.floor(F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts) / F.lit(3600 * hours))
