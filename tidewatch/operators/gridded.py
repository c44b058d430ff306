"""Particles through gridded currents in time.

The field (nodes k, i, j along t, lon, lat) is cut into chunks of time and space. Particles meet the nodes of the chunk that
they are in, with a rim around it, and are moved on for as long as those nodes suffice; then they go to the next chunk
with the steps they have left. So a task holds one chunk, however large the grid and however long the way, and a chunk
with many particles is dealt to several tasks. Each round is written to the shared folder.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import drift
from tidewatch.sources.shared import written

#: Nodes of a chunk along t, lon and lat, particles that meet it in one task, and the current (m/s) that a rim must hold for a step.
CHUNK, PARTICLES, FASTEST = (6, 32, 32), 50_000, 10.0


@dataclass(frozen=True)
class Axis:
    """Evenly spaced nodes; a negative step for a descending axis."""

    start: float
    step: float
    nodes: int


def _noise(candidate: np.ndarray, pid: np.ndarray, left: np.ndarray, salt: int) -> np.ndarray:
    """A normal number for each particle and step, whatever task it is drawn in."""
    x = (candidate.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (pid.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (left.astype(np.uint64) << np.uint64(8))

    def uniform(k: int) -> np.ndarray:
        y = x + np.uint64(k * 0x9E37 + salt)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            y = (y ^ (y >> np.uint64(shift))) * np.uint64(factor)
        return ((y >> np.uint64(11)).astype(float) + 0.5) / 2.0**53

    return np.sqrt(-2 * np.log(uniform(1))) * np.cos(2 * np.pi * uniform(2))


def advect_field(particles: DataFrame, field: DataFrame, t: Axis, lon: Axis, lat: Axis, hours: float, dt: float, diffusion: float = 0.0) -> DataFrame:
    """Move particles by `hours` in steps of dt seconds (back if negative): candidate_id, pid, lon, lat, t, parked.

    particles: candidate_id, pid, lon, lat, t (hours), and if there are such columns wind_u, wind_v (LEEWAY of them is added).
    field: k, i, j, u, v; a node that is missing, null or NaN has no value. Linear along t, lon and lat. A particle that
    leaves the field, or comes beside a node without a value, is parked where it was. Horizontal diffusion (m2/s) is a
    random walk that is the same whatever chunks a particle passes.
    """
    axes, steps = (t, lon, lat), round(abs(hours) * 3600 / abs(dt))
    widest = max(abs(lat.start), abs(lat.start + lat.step * (lat.nodes - 1)))
    metres = (abs(lon.step) * drift.M_PER_DEGREE_LON * max(math.cos(math.radians(min(widest, 89.0))), 0.01), abs(lat.step) * drift.M_PER_DEGREE_LAT)
    rim = (math.ceil(abs(dt) / 3600 / abs(t.step)) + 1, *(math.ceil(abs(dt) * FASTEST / m) + 1 for m in metres))
    walk = math.sqrt(2 * diffusion * abs(dt))
    names = ("ck", "ci", "cj")
    at = [F.least(F.greatest(F.floor((F.col(c) - a.start) / a.step), F.lit(0)), F.lit(a.nodes - 1)) for c, a in zip(("t", "lon", "lat"), axes, strict=True)]
    chunk = [F.floor(x / n).cast("int").alias(c) for x, n, c in zip(at, CHUNK, names, strict=True)]

    def around(node: str, n: int, r: int):
        return F.explode(F.sequence(F.floor(F.greatest(F.col(node) - r, F.lit(0)) / n).cast("int"), F.floor((F.col(node) + r) / n).cast("int")))

    def run(key: tuple, points: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        low = [max(c * n - r, 0) for c, n, r in zip(key[:3], CHUNK, rim, strict=True)]
        high = [min((c + 1) * n + r, a.nodes) for c, n, r, a in zip(key[:3], CHUNK, rim, axes, strict=True)]
        table = np.full((2, *(max(b - a, 1) for a, b in zip(low, high, strict=True))), np.nan)
        own = nodes[(nodes["k"] < high[0]) & (nodes["i"] < high[1]) & (nodes["j"] < high[2])]
        k, i, j = (own[c].to_numpy(int) - a for c, a in zip("kij", low, strict=True))
        table[:, k, i, j] = own["u"].to_numpy(float), own["v"].to_numpy(float)
        x, y, h = (points[c].to_numpy(float).copy() for c in ("lon", "lat", "t"))
        left, parked = points["left"].to_numpy(int).copy(), np.zeros(len(points), dtype=bool)
        wind = [points[c].to_numpy(float) * drift.LEEWAY for c in ("wind_u", "wind_v")]
        ids, pids = points["candidate_id"].to_numpy(np.int64), points["pid"].to_numpy(np.int64)
        going = left > 0
        moved = np.zeros(len(points), dtype=bool)
        while going.any():
            on = np.flatnonzero(going)
            beyond = np.zeros(len(on), dtype=bool)  # asks for nodes that the field has, but not this task

            def velocity(px: np.ndarray, py: np.ndarray, ph: np.ndarray, on: np.ndarray = on, beyond: np.ndarray = beyond) -> tuple[np.ndarray, np.ndarray]:
                place = [(v - a.start) / a.step for v, a in zip((ph, px, py), axes, strict=True)]
                with np.errstate(invalid="ignore"):
                    first = [np.floor(p) for p in place]
                    there = np.logical_and.reduce([(f >= 0) & (f <= a.nodes - 2) for f, a in zip(first, axes, strict=True)])
                    here = there & np.logical_and.reduce([(f >= a) & (f + 1 < b) for f, a, b in zip(first, low, high, strict=True)])
                beyond |= there & ~here
                f = [x - a for x, a in zip(first, low, strict=True)] if here.all() else [np.where(here, x - a, 0) for x, a in zip(first, low, strict=True)]
                w = [p - x for p, x in zip(place, first, strict=True)]
                n, m = table.shape[2], table.shape[3]
                at = ((f[0] * n + f[1]) * m + f[2]).astype(np.intp)
                (c1, b1, a1), (c0, b0, a0) = w, [1 - x for x in w]
                corner = lambda t, k: t.take(at + k, mode="clip")
                line = lambda t, k: a0 * corner(t, k) + a1 * corner(t, k + 1)
                plane = lambda t, k: b0 * line(t, k) + b1 * line(t, k + m)
                total = [c0 * plane(t, 0) + c1 * plane(t, n * m) for t in table.reshape(2, -1)]
                if not here.all():
                    total = [np.where(here, t, np.nan) for t in total]
                void = np.flatnonzero(here & (np.isnan(total[0]) | np.isnan(total[1])))  # beside a node without a value, whose weight may be zero
                if len(void):
                    each = np.zeros((2, len(void)))
                    for c in np.ndindex(2, 2, 2):
                        weight = np.prod([(q if one else 1 - q)[void] for q, one in zip(w, c, strict=True)], axis=0)
                        value = table[:, *(q[void].astype(int) + one for q, one in zip(f, c, strict=True))]
                        each += np.where(weight == 0, 0, weight * value)
                    total[0][void], total[1][void] = each
                return total[0] + wind[0][on], total[1] + wind[1][on]

            nx, ny = drift.rk4(x[on], y[on], h[on], dt, velocity)
            if walk:
                nx, ny = drift.moved(nx, ny, walk * _noise(ids[on], pids[on], left[on], 1), walk * _noise(ids[on], pids[on], left[on], 2))
            lost = ~beyond & (np.isnan(nx) | np.isnan(ny))
            fine = ~beyond & ~lost
            parked[on[lost]] = True
            go = on[fine]
            x[go], y[go], h[go], left[go], moved[go] = nx[fine], ny[fine], h[go] + dt / 3600, left[go] - 1, True
            if (beyond & ~moved[on]).any():
                raise ValueError(f"a step goes beyond {FASTEST} m/s: take shorter ones")
            going = np.zeros(len(points), dtype=bool)
            going[go] = left[go] > 0
        left[parked] = 0
        return points.assign(lon=x, lat=y, t=h, left=left, parked=parked)[columns]

    columns = ["candidate_id", "pid", "lon", "lat", "t", "wind_u", "wind_v", "left", "parked"]
    schema = "candidate_id long, pid int, lon double, lat double, t double, wind_u double, wind_v double, left int, parked boolean"
    wind = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in particles.columns else F.lit(0.0).alias(c) for c in ("wind_u", "wind_v")]
    placed = F.col("lon").isNotNull() & F.col("lat").isNotNull() & F.col("t").isNotNull()
    state = written(particles.select("candidate_id", F.col("pid").cast("int").alias("pid"), *(F.col(c).cast("double").alias(c) for c in ("lon", "lat", "t")), *wind, F.when(placed, steps).otherwise(0).alias("left"), (~placed).alias("parked")), "particles")
    chunked = field.where("u IS NOT NULL AND v IS NOT NULL").select("k", "i", "j", "u", "v", *(around(c, n, r).alias(name) for c, n, r, name in [("k", CHUNK[0], rim[0], "ck")]))
    for c, n, r, name in [("i", CHUNK[1], rim[1], "ci"), ("j", CHUNK[2], rim[2], "cj")]:
        chunked = chunked.withColumn(name, around(c, n, r))
    chunked = written(chunked, "chunks")
    done = [state.where("left = 0")]
    spark = particles.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)  # given: steps cost more than rows' bytes say
    while not (going := state.where("left > 0")).isEmpty():
        here = going.withColumns({c: x for c, x in zip(names, chunk, strict=True)})
        shares = written(here.groupBy(*names).agg(F.ceil(F.count("*") / PARTICLES).alias("shares")), "shares")  # chunks with particles
        dealt = here.join(shares, [*names]).withColumn("share", F.pmod(F.xxhash64("candidate_id", "pid"), F.col("shares"))).drop("shares")
        nodes = chunked.join(shares, [*names]).withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1))).drop("shares")
        by_task = (df.repartition(tasks, *names, "share").groupBy(*names, "share") for df in (dealt, nodes))
        moved = next(by_task).cogroup(next(by_task)).applyInPandas(run, schema)
        state = written(moved, "particles")
        done.append(state.where("left = 0"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("candidate_id", "pid", "lon", "lat", "t", "parked")
