"""Particle drift: analytic and gridded velocity fields, fourth-order steps back and forth in time.

A candidate's particles are a cloud of bounded size that lives in one numpy kernel, fed by Arrow batches of candidates:
rows of candidates go in, rows of candidates come out, no particle is ever shuffled.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.geo import haversine_km
from tidewatch.sources.shared import written

LEEWAY = 0.03
M_PER_DEGREE_LAT, M_PER_DEGREE_LON = 110_574.0, 111_320.0
# Km of model error an hour; hours beyond which an origin is a blur, a forecast unreliable, or refused.
ERROR_KM_PER_HOUR = 0.9
ORIGIN_HOURS, FORECAST_HOURS, LAST_HOURS = 24.0, 48.0, 72.0
#: Particles that a kernel moves at a time.
PARTICLES_AT_ONCE = 1 << 15

Field = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def toward(speed: float, direction_deg: float) -> tuple[float, float]:
    """(u, v) of a flow toward a direction."""
    return speed * float(np.sin(np.radians(direction_deg))), speed * float(np.cos(np.radians(direction_deg)))


def leeway(speed: float, from_deg: float, blown_from: bool = True) -> tuple[float, float]:
    """Wind drift, 3 % of the wind; meteorological directions say where wind comes from, so drift goes the other way."""
    return toward(speed * LEEWAY, from_deg + 180.0 if blown_from else from_deg)


def rotating_field(lon: np.ndarray, lat: np.ndarray, hours: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A base current with an eddy and a tide of 12.42 hours."""
    return _wave(lat, 0.18) + (0.25 + 0.12 * np.cos(2 * np.pi / 12.42 * hours)), -0.10 - _wave(lon, 0.18)


def _wave(degrees: np.ndarray, height: float) -> np.ndarray:
    """A sine of 0.6 degrees' length; whole waves are taken off first, as the sine of a small angle takes half the time."""
    x = degrees / 0.6
    x -= np.rint(x)
    x *= 2 * np.pi
    x = np.sin(x)
    x *= height
    return x


def _velocity(u0: float | np.ndarray, v0: float | np.ndarray, eddy: bool) -> Field:
    """Current plus a constant part, such as wind drift."""
    if not eddy:
        return lambda lon, lat, hours: (u0 + np.zeros_like(lon), v0 + np.zeros_like(lat))

    def both(lon: np.ndarray, lat: np.ndarray, hours: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        u, v = rotating_field(lon, lat, hours)
        u += u0
        v += v0
        return u, v

    return both


def moved(lon: np.ndarray, lat: np.ndarray, east_m: np.ndarray, north_m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return lon + east_m / (M_PER_DEGREE_LON * np.cos(np.radians(lat))), lat + north_m / M_PER_DEGREE_LAT


def rk4(lon: np.ndarray, lat: np.ndarray, hours: np.ndarray, dt: float | np.ndarray, velocity: Field) -> tuple[np.ndarray, np.ndarray]:
    """One fourth-order step of dt seconds, back in time if dt is negative; hours and dt may be one for each row of particles."""
    across, along = dt / (M_PER_DEGREE_LON * np.cos(np.radians(lat))), dt / M_PER_DEGREE_LAT
    half, up = across * 0.5, along * 0.5
    u, v = velocity(lon, lat, hours)
    u1, v1 = velocity(lon + u * half, lat + v * up, hours + dt / 7200.0)
    u2, v2 = velocity(lon + u1 * half, lat + v1 * up, hours + dt / 7200.0)
    u3, v3 = velocity(lon + u2 * across, lat + v2 * along, hours + dt / 3600.0)
    return lon + (u + 2 * (u1 + u2) + u3) * (across / 6), lat + (v + 2 * (v1 + v2) + v3) * (along / 6)


def advect(particles: DataFrame, hours: float, dt: float, u0: float = 0.0, v0: float = 0.0, eddy: bool = False) -> DataFrame:
    """Move particles (lon, lat, hours: time in hours) by `hours` in steps of dt seconds; negative dt goes back in time.

    Other columns and the order of columns stay.
    """
    steps = round(hours * 3600 / abs(dt))
    velocity = _velocity(u0, v0, eddy)
    typed = particles.withColumns({c: F.col(c).cast("double") for c in ("lon", "lat", "hours")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lon, lat, t = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("lon", "lat", "hours"))
            for _ in range(steps):
                lon, lat = rk4(lon, lat, t, dt, velocity)
                t = t + dt / 3600.0
            new = {"lon": lon, "lat": lat, "hours": t}
            yield pa.RecordBatch.from_arrays([pa.array(new[c], from_pandas=True) if c in new else batch.column(c) for c in batch.schema.names], batch.schema.names)

    return typed.mapInArrow(run, typed.schema)


def sample_polygon(ring: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """n points spread evenly in a simple polygon (k x 2), by rejection from its box: at most 200 n attempts.

    A ring that takes no point, or has fewer than three corners, is an error.
    """
    if len(ring) < 3:
        raise ValueError("a polygon needs three corners")
    low, high = ring.min(axis=0), ring.max(axis=0)
    (x0, y0), (x1, y1) = ring.T[:, :, None], np.roll(ring, -1, axis=0).T[:, :, None]  # a row each side, as a column's points are many
    with np.errstate(divide="ignore", invalid="ignore"):
        slope = (x1 - x0) / (y1 - y0)
    found, left = [], 200 * n
    while left > 0 and sum(map(len, found)) < n:
        p = low + rng.random((min(2 * n, left), 2)) * (high - low)
        left -= len(p)
        x, y = np.ascontiguousarray(p.T)
        above = y0 > y
        with np.errstate(divide="ignore", invalid="ignore"):
            crossed = (above != np.roll(above, -1, axis=0)) & (x < slope * (y - y0) + x0)
        found.append(p[np.logical_xor.reduce(crossed, axis=0)])
    points = np.concatenate(found)[:n] if found else np.zeros((0, 2))
    if not len(points):
        raise ValueError("no particle falls into the polygon")
    return points


def generator(candidate_id: int, salt: int = 0) -> np.random.Generator:
    """A candidate's own random numbers, whatever rows it meets in a batch."""
    return np.random.Generator(np.random.Philox(key=[candidate_id & 0xFFFFFFFFFFFFFFFF, salt]))


def spread_of(lon: np.ndarray, lat: np.ndarray) -> tuple[float, float, float]:
    """Centre of a cloud and the radius in km that holds 68 % of it."""
    a, b = lon.mean(), lat.mean()
    h = np.sin(np.radians(lat - b) / 2) ** 2 + np.cos(np.radians(b)) * np.cos(np.radians(lat)) * np.sin(np.radians(lon - a) / 2) ** 2
    at = (len(h) - 1) * 0.68
    k = int(at)
    low, high = np.partition(h, (k, min(k + 1, len(h) - 1)))[[k, min(k + 1, len(h) - 1)]]  # the distance rises with h
    near, far = (2 * 6371.0088 * np.arcsin(np.sqrt(np.minimum(1.0, x))) for x in (low, high))
    return float(a), float(b), float(near + (far - near) * (at - k))


CLOUD = "candidate_id long, centre_lon double, centre_lat double, spread_km double, particles long, uncertainty_km double, reliable boolean, wkt string, problem string, track array<struct<hours:double,lon:double,lat:double,spread_km:double>>"

NAMES = ["candidate_id", "centre_lon", "centre_lat", "spread_km", "particles", "uncertainty_km", "reliable", "wkt", "problem", "track"]


def drift_clouds(candidates: DataFrame, hours: Column | float | list[Column | float], dt: float, n: int = 500, diffusion: float = 5.0, eddy: bool = True, u0: float = 0.0, v0: float = 0.0, track: bool = False, hull: bool = True) -> DataFrame:
    """Seed n particles in each candidate's polygon, move them `hours` on (back, if negative), and sum the cloud up.

    candidates: candidate_id, ring (array of struct lon, lat) or points (the same, as seeds themselves, n of them at most), at (time
    in hours), and if there are such columns wind_u, wind_v (m/s): LEEWAY of them is added to the current. Horizontal diffusion (m2/s) is a random walk of sqrt(2 K dt)
    m a step. The uncertainty adds ERROR_KM_PER_HOUR of the way to the spread. A forecast beyond LAST_HOURS is refused:
    the cloud stays and isn't reliable, nor is one beyond FORECAST_HOURS, or an origin beyond ORIGIN_HOURS or 50 km.
    A candidate whose ring takes no particle has nulls and the problem. track: the cloud's centre and spread after each
    step, from the observation on; hull: its convex hull as WKT; null otherwise. Of several `hours` each makes a cloud of the same
    seeds and the same random walk, with its number in `leg`.
    """
    wind = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in candidates.columns else F.lit(0.0).alias(c) for c in ("wind_u", "wind_v")]
    wanted = hours if isinstance(hours, list) else [hours]
    legs = len(wanted)  # the kernel takes no Column with it
    far = F.array(*(F.lit(float(h)) if isinstance(h, int | float) else h.cast("double") for h in wanted))
    given = "points" in candidates.columns
    rows = candidates.select("candidate_id", (F.col("points") if given else F.col("ring")).alias("ring"), F.col("at").cast("double").alias("at"), far.alias("hours"), *wind)

    def cloud_rows(given_rows: list[dict]) -> Iterator[tuple]:
        some = [{**r, "hours": h, "leg": leg} for r in given_rows for leg, h in enumerate(r["hours"])]
        seeded, made = [], {}
        for k in range(0, len(some), legs):
            r, rng = some[k], generator(some[k]["candidate_id"])
            try:
                corners = np.array([(p["lon"], p["lat"]) for p in r["ring"] or []], float).reshape(-1, 2)
                if given and (not len(corners) or np.isnan(corners).any()):
                    raise ValueError("no particle to follow")
                points = corners if given else sample_polygon(corners, n, rng)
                seeded.extend((k + leg, points, walker) for leg, walker in enumerate(_alike(rng, r["candidate_id"], legs)))
            except ValueError as e:
                made |= {k + leg: (r["candidate_id"], None, None, None, 0, None, False, None, str(e), None, leg) for leg in range(legs)}
        # the longest way first, so that those under way at a step are the first rows
        way = {k: some[k]["hours"] if some[k]["hours"] is not None and some[k]["hours"] <= LAST_HOURS else 0.0 for k, _, _ in seeded}
        steps = {k: max(1, round(abs(h) * 3600 / abs(dt))) if h else 0 for k, h in way.items()}
        seeded.sort(key=lambda x: -steps[x[0]])
        each = lambda values: np.array(values, float)[:, None]
        cloud_of = np.zeros((2, len(seeded), n))
        for row, (_, points, _) in enumerate(seeded):
            cloud_of[:, row, : len(points)] = points.T
        lon, lat = cloud_of
        tracks: dict[int, list[dict]] = {k: [] for k, _, _ in seeded}

        def note(step: int, rows_of: int) -> None:
            for row, (k, points, _) in enumerate(seeded[:rows_of] if track else []):
                x, y, spread = spread_of(lon[row, : len(points)], lat[row, : len(points)])
                tracks[k].append({"hours": step * float(np.sign(way[k])) * abs(dt) / 3600.0, "lon": x, "lat": y, "spread_km": spread})

        note(0, len(seeded))
        if seeded:
            sign, t = each([np.sign(way[k]) for k, _, _ in seeded]), each([some[k]["at"] or 0.0 for k, _, _ in seeded])
            u, v = each([u0 + LEEWAY * some[k]["wind_u"] for k, _, _ in seeded]), each([v0 + LEEWAY * some[k]["wind_v"] for k, _, _ in seeded])
            walk = np.sqrt(2 * diffusion * abs(dt))
            for step in range(steps[seeded[0][0]]):
                m = sum(steps[k] > step for k, _, _ in seeded)
                d = sign[:m] * abs(dt)
                lon[:m], lat[:m] = rk4(lon[:m], lat[:m], t[:m], d, _velocity(u[:m], v[:m], eddy))
                t[:m] += d / 3600.0
                if diffusion > 0:
                    shaken = np.empty((m, 2, n))
                    for row, (_, _, rng) in enumerate(seeded[:m]):
                        rng.standard_normal(out=shaken[row])
                    shaken *= walk
                    lon[:m], lat[:m] = moved(lon[:m], lat[:m], shaken[:, 0], shaken[:, 1])
                note(step + 1, m)
        for row, (k, points, _) in enumerate(seeded):
            x, y, asked = lon[row, : len(points)], lat[row, : len(points)], some[k]["hours"]
            a, b, spread = spread_of(x, y)
            unsure = float(np.hypot(spread, ERROR_KM_PER_HOUR * abs(way[k])))
            good = asked is not None and (unsure <= 50.0 and -asked <= ORIGIN_HOURS if asked < 0 else asked <= FORECAST_HOURS)
            problem = "too old for a forecast" if asked is not None and asked > LAST_HOURS else None
            made[k] = (some[k]["candidate_id"], a, b, spread, len(points), unsure, good, hull_wkt(np.stack([x, y], axis=1)) if hull else None, problem, tracks[k] if track else None, some[k]["leg"])
        yield from (made[k] for k in range(len(some)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_once = max(1, PARTICLES_AT_ONCE // n // legs)
        for batch in batches:
            for a in range(0, batch.num_rows, at_once):
                cols = list(zip(*cloud_rows(batch.slice(a, at_once).to_pylist()), strict=True))
                types = (pa.int64(), *[pa.float64()] * 3, pa.int64(), pa.float64(), pa.bool_(), pa.string(), pa.string(), pa.list_(pa.struct([(x, pa.float64()) for x in ("hours", "lon", "lat", "spread_km")])), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [*NAMES, "leg"])

    tasks = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    clouds = rows.repartition(tasks).mapInArrow(run, f"{CLOUD}, leg int")  # a row is small, its particles take milliseconds
    return clouds if isinstance(hours, list) else clouds.drop("leg")


def _alike(rng: np.random.Generator, candidate_id: int, n: int) -> list[np.random.Generator]:
    """n generators that go on as rng does, itself the first."""
    others = [generator(candidate_id) for _ in range(n - 1)]
    for other in others:
        other.bit_generator.state = rng.bit_generator.state
    return [rng, *others]


def forecast_state(hours: Column) -> Column:
    """What a forecast over so many hours is worth: not in the past, refused, unreliable, reliable."""
    return F.when(hours <= 0, "not in the past").when(hours > LAST_HOURS, "refused").when(hours > FORECAST_HOURS, "unreliable").otherwise("reliable")


def origin_reliable(hours: Column, uncertainty_km: Column) -> Column:
    return (hours <= ORIGIN_HOURS) & (uncertainty_km <= 50.0)


def ellipse(lon: Column, lat: Column, area_km2: Column, elongation: Column, axis_deg: Column, corners: int = 16) -> Column:
    """The ring of an ellipse of a slick's area and elongation, its long axis toward axis_deg: array<struct<lon, lat>>."""
    half = F.sqrt(area_km2 / np.pi / F.greatest(elongation, F.lit(1.0))) * 1000.0
    along, turn = half * F.greatest(elongation, F.lit(1.0)), F.radians(axis_deg)

    def corner(k: int) -> Column:
        a, b = float(np.cos(2 * np.pi * k / corners)) * along, float(np.sin(2 * np.pi * k / corners)) * half
        east, north = a * F.sin(turn) + b * F.cos(turn), a * F.cos(turn) - b * F.sin(turn)
        return F.struct((lon + east / (M_PER_DEGREE_LON * F.cos(F.radians(lat)))).alias("lon"), (lat + north / M_PER_DEGREE_LAT).alias("lat"))

    return F.array(*(corner(k) for k in range(corners)))


def laid_out(candidate_id: Column, lon: Column, lat: Column, area_km2: Column, elongation: Column, axis_deg: Column, n: int) -> Column:
    """n points spread evenly over a slick's ellipse (see `ellipse`) by MD5 of candidate and number: array<struct<lon, lat>>, the same every time.

    A slick without a place or an area has nulls in it.
    """
    half = F.sqrt(F.when(area_km2 > 0, area_km2) / np.pi / F.greatest(elongation, F.lit(1.0))) * 1000.0
    along, turn = half * F.greatest(elongation, F.lit(1.0)), F.radians(axis_deg)

    def point(pid: Column) -> Column:
        u = lambda salt: F.conv(F.substring(F.md5(F.concat_ws("|", candidate_id.cast("string"), pid.cast("string"), F.lit(str(salt))).cast("binary")), 1, 8), 16, 10).cast("long") / 4294967296.0
        a, b = F.sqrt(u(1)) * F.cos(2 * np.pi * u(2)) * along, F.sqrt(u(1)) * F.sin(2 * np.pi * u(2)) * half
        east, north = a * F.sin(turn) + b * F.cos(turn), a * F.cos(turn) - b * F.sin(turn)
        return F.struct((lon + east / (M_PER_DEGREE_LON * F.cos(F.radians(lat)))).alias("lon"), (lat + north / M_PER_DEGREE_LAT).alias("lat"))

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), point)


def seed(candidates: DataFrame, n: int, radius_km: float) -> DataFrame:
    """n particles within radius_km of each candidate (candidate_id, lon, lat), spread by MD5: the same every time, in any engine."""
    u = lambda salt: F.conv(F.substring(F.md5(F.concat_ws("|", "candidate_id", "pid", F.lit(str(salt))).cast("binary")), 1, 8), 16, 10).cast("long") / 4294967296.0
    far, turn = radius_km * F.sqrt(u(1)), 2 * np.pi * u(2)
    spread = candidates.withColumn("pid", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return spread.withColumns({"lon": F.col("lon") + far * F.sin(turn) * 1000.0 / (M_PER_DEGREE_LON * F.cos(F.radians("lat"))), "lat": F.col("lat") + far * F.cos(turn) * 1000.0 / M_PER_DEGREE_LAT})


def cloud(particles: DataFrame, key: str = "candidate_id") -> DataFrame:
    """Centre of each particle cloud and the radius that holds 68 % of it."""
    centre = particles.groupBy(key).agg(F.avg("lon").alias("centre_lon"), F.avg("lat").alias("centre_lat"))
    far = particles.join(centre, key).withColumn("km", haversine_km(F.col("lon"), F.col("lat"), F.col("centre_lon"), F.col("centre_lat")))
    return far.groupBy(key, "centre_lon", "centre_lat").agg(F.percentile("km", 0.68).alias("spread_km"), F.count("*").alias("particles"))


def backtrack(particles: DataFrame, hours: float, dt: float, **field) -> DataFrame:
    """Origin of each candidate: the cloud after drifting back, with the error that grows 0.9 km an hour added."""
    origin = cloud(advect(particles, hours, -abs(dt), **field))
    unsure = F.sqrt(F.col("spread_km") * F.col("spread_km") + F.lit((ERROR_KM_PER_HOUR * hours) ** 2))
    return origin.withColumn("uncertainty_km", unsure).withColumn("reliable", F.lit(hours <= ORIGIN_HOURS) & (F.col("uncertainty_km") <= 50.0))


#: Particles (or candidates, if those are dealt) that meet a tile of the field in one task, and the tile's side in cells.
TILE_PARTICLES, TILE_CELLS = 2_000, 32


def _bilinear(table: np.ndarray, i0: int, j0: int, lon0: float, lat0: float, step: float) -> Field:
    """The velocity between the nodes of a table (u and v by i and j) whose last two rows and columns are NaN, from node i0, j0 on."""
    high, wide = table.shape[1:]
    u_at, v_at = table.reshape(2, -1)

    def velocity(lon: np.ndarray, lat: np.ndarray, _: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, y = (lon - lon0) / step - i0, (lat - lat0) / step - j0
        a, b = np.floor(x), np.floor(y)
        inside = (a >= 0) & (b >= 0) & (a < high - 1) & (b < wide - 1)
        if not inside.all():
            a, b = np.where(inside, a, high - 2), np.where(inside, b, wide - 2)
        k = (a * wide + b).astype(np.intp)
        fx, fy = x - a, y - b
        gx, gy = 1 - fx, 1 - fy
        between = lambda t: gx * (gy * t.take(k) + fy * t.take(k + 1)) + fx * (gy * t.take(k + wide) + fy * t.take(k + wide + 1))
        return between(u_at), between(v_at)

    return velocity


def advect_grid(particles: DataFrame, grid: DataFrame, lon0: float, lat0: float, step: float, hours: float, dt: float, seed: Callable[[DataFrame], DataFrame] | None = None, spread_km: float = 0.0) -> DataFrame:
    """Particles (candidate_id, pid, lon, lat) through a gridded steady field (i, j, u, v): the same, moved, and parked.

    Particles that leave the grid stay where they left it, and say so. With `seed`, which turns rows of candidate_id, lon, lat
    into particles within spread_km of them, the rows are candidates: these are shuffled, and seeded where they arrive.

    A tile's cells, and those within reach around it (3 m/s at most), go ahead of its particles through the tasks that they are
    dealt to. The tasks are given, as adaptive execution would join them by bytes, and a row's work is in the steps.
    """
    spark = particles.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
    reach = int(np.ceil((abs(hours) * 3600 * 3.0 + spread_km * 1000) / M_PER_DEGREE_LAT / step)) + 2
    tile = lambda x, origin: F.coalesce(F.floor((F.col(x) - origin) / step / TILE_CELLS), F.lit(0))
    own = ["candidate_id", *([] if seed else ["pid"]), "lon", "lat"]
    tiled = particles.select(*own).withColumns({"ti": tile("lon", lon0), "tj": tile("lat", lat0)})
    shares = written(tiled.groupBy("ti", "tj").agg(F.least(F.ceil(F.count("*") / TILE_PARTICLES), F.lit(tasks)).alias("shares")), "tiles")
    task = lambda share: F.pmod(F.pmod(F.xxhash64("ti", "tj"), F.lit(tasks)) + share, F.lit(tasks)).cast("int").alias("task")
    around = lambda x: F.sequence(F.floor((F.col(x) - reach) / TILE_CELLS), F.floor((F.col(x) + reach) / TILE_CELLS))
    cells = grid.select("i", "j", *(F.col(c).cast("double").alias(c) for c in ("u", "v"))).withColumn("ti", F.explode(around("i"))).withColumn("tj", F.explode(around("j"))).join(shares, ["ti", "tj"])
    fields = cells.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1))).select("ti", "tj", task(F.col("share")), F.lit(0).alias("kind"), "i", "j", "u", "v")
    dealt = tiled.join(shares, ["ti", "tj"]).select("ti", "tj", task(F.pmod(F.xxhash64(*own[:-2]), F.col("shares"))), F.lit(1).alias("kind"), *own)
    rows = dealt.unionByName(fields, allowMissingColumns=True).repartitionById(tasks, F.col("task")).drop("task").sortWithinPartitions("ti", "tj", "kind")
    if seed:
        rows = seed(rows).where("kind = 1 OR pid = 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, velocity, held = (None, None), None, []
        for batch in batches:
            kind, ti, tj, lon, lat = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("kind", "ti", "tj", "lon", "lat"))
            turns = np.flatnonzero((np.diff(kind) != 0) | (np.diff(ti) != 0) | (np.diff(tj) != 0)) + 1
            for a, b in itertools.pairwise([0, *turns.tolist(), len(kind)] if len(kind) else []):
                if kind[a] == 0:
                    if key != (ti[a], tj[a]):
                        key, held = (ti[a], tj[a]), []
                    held.append([batch.column(c).slice(a, b - a).to_numpy(zero_copy_only=False) for c in ("i", "j", "u", "v")])
                    velocity = None
                    continue
                x, y = lon[a:b].astype(float), lat[a:b].astype(float)
                parked = np.full(b - a, key != (ti[a], tj[a]))  # a tile without cells
                if not parked.all():
                    if velocity is None:
                        i, j, u, v = (np.concatenate(c) for c in zip(*held, strict=True))
                        i, j = i.astype(int), j.astype(int)
                        table = np.full((2, i.max() - i.min() + 3, j.max() - j.min() + 3), np.nan)  # nothing beyond the last cells
                        table[:, i - i.min(), j - j.min()] = u, v
                        velocity = _bilinear(table, i.min(), j.min(), lon0, lat0, step)
                    still = np.zeros(b - a)
                    for _ in range(round(abs(hours) * 3600 / abs(dt))):
                        nx, ny = rk4(x, y, still, dt, velocity)
                        parked |= np.isnan(nx) | np.isnan(ny)
                        x, y = (np.where(parked, x, nx), np.where(parked, y, ny)) if parked.any() else (nx, ny)
                ids = (batch.column(c).slice(a, b - a) for c in ("candidate_id", "pid"))
                yield pa.RecordBatch.from_arrays([*ids, pa.array(x, from_pandas=True), pa.array(y, from_pandas=True), pa.array(parked)], ["candidate_id", "pid", "lon", "lat", "parked"])

    return rows.withColumns({"candidate_id": F.col("candidate_id").cast("long"), "pid": F.col("pid").cast("int"), **{c: F.col(c).cast("double") for c in ("lon", "lat")}}).mapInArrow(run, "candidate_id long, pid int, lon double, lat double, parked boolean")


#: Directions in which a cloud's extreme points are sought.
_TURNS = np.stack([f(2 * np.pi * np.arange(24) / 24) for f in (np.cos, np.sin)], axis=1)


def _outer(points: np.ndarray) -> np.ndarray:
    """The points that don't lie well inside the polygon of extreme ones, which can't be on the hull.

    Directions are those of the cloud made round, as most of a narrow one lies beyond the few corners that an even choice finds.
    """
    if len(points) < 20:
        return points
    x, y = points.T - points.mean(axis=0)[:, None]
    a, b, c = (x * x).mean(), (x * y).mean(), (y * y).mean()
    if not a * c - b * b > 1e-12 * a * c:
        return points
    wide = np.sqrt(a)  # of the lower triangle whose square is the covariance; its inverse makes the cloud round and keeps its sense of turning
    lean = b / wide
    x, y = x / wide, (y - lean * (x / wide)) / np.sqrt(c - lean * lean)
    corner = (_TURNS @ np.stack([x, y])).argmax(axis=1)
    side_x, side_y = np.roll(x[corner], -1) - x[corner], np.roll(y[corner], -1) - y[corner]
    left = side_x[:, None] * (y - y[corner, None]) - side_y[:, None] * (x - x[corner, None])
    return points[~(left[(side_x != 0) | (side_y != 0)] > 1e-9).all(axis=0)]


def hull_wkt(points: np.ndarray) -> str:
    """Convex hull of points (n x 2) as WKT, by monotone chains."""
    ordered = sorted({(float(x), float(y)) for x, y in _outer(points)})

    def chain(some: list[tuple[float, float]]) -> list[tuple[float, float]]:
        out: list[tuple[float, float]] = []
        for p in some:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    h = chain(ordered) + chain(ordered[::-1]) if len(ordered) > 2 else ordered
    return "POLYGON ((" + ", ".join(f"{x:.6f} {y:.6f}" for x, y in [*h, h[0]]) + "))" if len(h) > 2 else "POLYGON EMPTY"


def hulls(particles: DataFrame) -> DataFrame:
    """Convex hull of each candidate's particles as WKT; a candidate's particles are bounded by the seeding."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pdf[["candidate_id"]].assign(wkt=[hull_wkt(np.array([(p["lon"], p["lat"]) for p in ring], float).reshape(-1, 2)) for ring in pdf["points"]])

    rings = particles.groupBy("candidate_id").agg(F.collect_list(F.struct("lon", "lat")).alias("points"))
    return rings.mapInPandas(run, "candidate_id long, wkt string")
