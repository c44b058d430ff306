"""Wind and current fields: constant, synthetic and gridded ones, and their choice by settings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import joins
from tidewatch.sources.shared import written

Wind = Callable[[DataFrame], DataFrame]


def constant_wind(speed: float, direction: float) -> Wind:
    """The same wind everywhere: adds wind_ms, wind_deg, wind_source to points."""
    return lambda points: points.withColumns({"wind_ms": F.lit(float(speed)), "wind_deg": F.lit(float(direction)), "wind_source": F.lit("constant")})


def synthetic_wind(base: float = 5.0, swing: float = 2.0, degrees: float = 0.35) -> Wind:
    """A wavy wind over lon and lat, for demonstrations."""
    k = 2 * 3.141592653589793 / degrees

    def add(points: DataFrame) -> DataFrame:
        speed = F.greatest(F.lit(0.0), base + swing * F.sin(k * F.col("lon")) * F.cos(k * F.col("lat")))
        return points.withColumns({"wind_ms": speed, "wind_deg": F.lit(225.0), "wind_source": F.lit("synthetic")})

    return add


def table_wind(wind: DataFrame, key: str, id_col: str = "candidate_id", time: str = "observed", source: str = "table") -> Wind:
    """The wind nearest in time of the point's cell (`key`), from a table with key, ts, speed, direction; null where there is none."""

    def add(points: DataFrame) -> DataFrame:
        near = joins.asof_nearest(points.select(key, id_col, time), wind, key, time, "ts", ["speed", "direction"], id_col)
        found = near.select(id_col, F.col("speed").alias("wind_ms"), F.col("direction").alias("wind_deg"), F.lit(source).alias("wind_source"))
        return points.join(found, id_col, "left")

    return add


def wind_of(settings: dict, tables: dict[str, DataFrame] | None = None) -> Wind:
    """The wind that settings["wind"] names: constant (speed, direction), synthetic, or a table by its name and key."""
    wind = settings.get("wind", {})
    kind = wind.get("source", "synthetic")
    if kind == "constant":
        return constant_wind(wind["speed_ms"], wind["direction_deg"])
    if kind == "synthetic":
        return synthetic_wind()
    if tables and kind in tables:
        return table_wind(tables[kind], wind.get("key", "cell"), source=kind)
    raise ValueError(f"unknown wind source: {kind}")


def currents_of(settings: dict, spark: SparkSession, scene_id: str | None = None) -> dict:
    """What drift needs of settings["currents"]: constant (u, v), synthetic (eddy), or a grid (Parquet with t, i, j, u, v), by scene if per_scene is set."""
    currents = settings.get("currents", {})
    kind = currents.get("source", "synthetic")
    if kind == "constant":
        return {"u0": float(currents["u"]), "v0": float(currents["v"]), "eddy": False}
    if kind == "synthetic":
        return {"eddy": True}
    if kind == "grid":
        path = f"{currents['path'].rstrip('/')}/{scene_id}" if currents.get("per_scene") else currents["path"]
        return {"grid": spark.read.parquet(path)}
    raise ValueError(f"unknown current source: {kind}")


def sample(points: DataFrame, grid: DataFrame, axes: dict[str, tuple[float, float]], outside: str = "error") -> DataFrame:
    """u and v of a field in time at points (id, t, lon, lat): linear along t, lon and lat between the eight nodes around.

    grid: k, i, j, u, v; axes: start and step of t, lon and lat (a negative step for a descending axis). A point off the grid,
    or beside a node without a value, is an error or, with outside="null", has nulls. Nodes are put together as cells of eight, which
    a point meets in one join, as one row; weights of zero ask for no node.
    """
    names = {"t": "k", "lon": "i", "lat": "j"}
    place = {x: (F.col(x) - axes[x][0]) / axes[x][1] for x in names}
    corners = [(a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1)]
    known = grid.where("u IS NOT NULL AND v IS NOT NULL AND NOT isnan(u) AND NOT isnan(v)")
    spread = F.array(*(F.struct((F.col("k") - a).alias("__k"), (F.col("i") - b).alias("__i"), (F.col("j") - c).alias("__j"), F.lit(n).alias("n")) for n, (a, b, c) in enumerate(corners)))
    met = known.select(F.explode(spread).alias("c"), "u", "v", F.lit(1.0).alias("w")).select("c.*", "u", "v", "w")
    cells = met.groupBy("__k", "__i", "__j").agg(*(F.coalesce(F.max(F.when(F.col("n") == n, F.col(x))), F.lit(0.0)).alias(f"__{x}{n}") for n in range(8) for x in ("u", "v", "w")))
    placed = points.withColumns({f"__{names[x]}": F.floor(p) for x, p in place.items()} | {f"__{x}": p - F.floor(p) for x, p in place.items()})
    far = [F.col(f"__{x}") for x in names]

    def between(x: str, axis: int = 0, n: int = 0) -> Column:
        """Linear along the axes from this one on; a node without a value is zero, and so is its w."""
        if axis == 3:
            return F.col(f"__{x}{n}")
        return (1 - far[axis]) * between(x, axis + 1, n) + far[axis] * between(x, axis + 1, n + (4 >> axis))

    whole = placed.join(joins.bounded(written(cells, "cells"), 100_000), ["__k", "__i", "__j"], "left").select(*points.columns, *(between(x).alias(x) for x in ("u", "v")), F.coalesce(F.abs(between("w") - 1) < 1e-9, F.lit(False)).alias("inside"))
    if outside == "error":
        first = whole.where(~F.col("inside")).agg(F.min("id").alias("__first"))  # one row, so that every task names the same point
        refuse = F.when(F.col("__first").isNotNull(), F.raise_error(F.concat(F.lit("outside of the field: "), F.col("__first").cast("string"))).cast("double"))
        return whole.join(F.broadcast(first)).withColumns({x: F.coalesce(refuse, F.col(x)) for x in ("u", "v")}).drop("inside", "__first")
    return whole.withColumns({x: F.when(F.col("inside"), F.col(x)) for x in ("u", "v")}).drop("inside")
