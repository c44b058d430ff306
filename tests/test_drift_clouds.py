"""Clouds of particles against plain loops: seeding, steps, spread, horizons, gridded fields."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import drift

RING = [(76.0, 9.0), (76.4, 9.05), (76.3, 9.2), (76.2, 9.1), (76.05, 9.25)]
ROW = "candidate_id long, ring array<struct<lon:double,lat:double>>, at double, wind_u double, wind_v double"


def eddy(lon, lat, hours):
    k = 2 * math.pi / 0.6
    return 0.25 + 0.18 * math.sin(k * lat) + 0.12 * math.cos(2 * math.pi * hours / 12.42), -0.10 - 0.18 * math.sin(k * lon)


def offset(p, east, north):
    return p[0] + east / (111_320.0 * math.cos(math.radians(p[1]))), p[1] + north / 110_574.0


def walk(p, hours, at, dt, u0, v0):
    """Plain fourth-order steps of one particle."""
    for _ in range(max(1, round(abs(hours) * 3600 / dt)) if hours else 0):
        d = math.copysign(dt, hours)
        speed = lambda q, t: tuple(a + b for a, b in zip(eddy(*q, t), (u0, v0), strict=True))
        k1 = speed(p, at)
        k2 = speed(offset(p, k1[0] * d / 2, k1[1] * d / 2), at + d / 7200)
        k3 = speed(offset(p, k2[0] * d / 2, k2[1] * d / 2), at + d / 7200)
        k4 = speed(offset(p, k3[0] * d, k3[1] * d), at + d / 3600)
        p = offset(p, *((a + 2 * b + 2 * c + e) / 6 * d for a, b, c, e in zip(k1, k2, k3, k4, strict=True)))
        at += d / 3600
    return p


def haversine(a, b):
    h = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(h))


def inside(p):
    hit = False
    for (x0, y0), (x1, y1) in zip(RING, RING[1:] + RING[:1], strict=True):
        if (y0 > p[1]) != (y1 > p[1]) and p[0] < (x1 - x0) * (p[1] - y0) / (y1 - y0) + x0:
            hit = not hit
    return hit


def test_seeds_fill_the_polygon_and_repeat():
    a, b = (drift.sample_polygon(np.array(RING), 400, drift.generator(7)) for _ in range(2))
    assert (a == b).all() and len(a) == 400 and all(inside(p) for p in a.tolist())
    assert np.ptp(a[:, 0]) > 0.35 and np.ptp(a[:, 1]) > 0.2
    for ring in ([(0.0, 0.0), (1.0, 1.0)], [(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)]):
        with pytest.raises(ValueError):
            drift.sample_polygon(np.array(ring), 10, drift.generator(1))


@pytest.mark.parametrize("hours", [-12.0, -3.0, 0.0, 30.0])
def test_clouds_by_plain_loops(spark, hours):
    rows = [(k, RING, 5.0 * k, 8.0 * k, -3.0) for k in range(1, 4)]
    got = {r["candidate_id"]: r for r in drift.drift_clouds(spark.createDataFrame(rows, ROW), hours, 1800, n=40, diffusion=0.0).collect()}
    for k, _, at, wu, wv in rows:
        seeds = drift.sample_polygon(np.array(RING), 40, drift.generator(k)).tolist()
        ends = [walk(p, hours, at, 1800, 0.03 * wu, 0.03 * wv) for p in seeds]
        centre = tuple(sum(p[i] for p in ends) / 40 for i in (0, 1))
        spread = float(np.percentile([haversine(centre, p) for p in ends], 68))
        r = got[k]
        assert (r["centre_lon"], r["centre_lat"]) == (pytest.approx(centre[0], abs=1e-7), pytest.approx(centre[1], abs=1e-7))
        assert r["spread_km"] == pytest.approx(spread, rel=1e-5) and r["particles"] == 40 and r["problem"] is None
        assert r["uncertainty_km"] == pytest.approx(math.hypot(spread, 0.9 * abs(hours)), rel=1e-5) and r["reliable"]
        assert r["wkt"].startswith("POLYGON ((")


def test_horizons_and_polygons_without_particles(spark):
    rows = [(1, RING, 0.0, 0.0, 0.0), (2, [(1.0, 1.0)], 0.0, 0.0, 0.0), (3, None, 0.0, 0.0, 0.0)]
    clouds = lambda hours: {r["candidate_id"]: r for r in drift.drift_clouds(spark.createDataFrame(rows, ROW), hours, 1800, n=30).collect()}
    late, old, back = clouds(60.0), clouds(80.0), clouds(-30.0)
    assert not late[1]["reliable"] and late[1]["problem"] is None
    assert not old[1]["reliable"] and old[1]["problem"] == "too old for a forecast" and old[1]["uncertainty_km"] == pytest.approx(old[1]["spread_km"])
    assert not back[1]["reliable"]
    for r in (late[2], late[3]):
        assert r["problem"] and r["centre_lon"] is None and r["particles"] == 0 and not r["reliable"]
    mixed = spark.createDataFrame(rows[:1], ROW).withColumn("h", F.lit(None).cast("double"))
    assert not drift.drift_clouds(mixed, F.col("h"), 1800, n=10).first()["reliable"]
    assert drift.drift_clouds(spark.createDataFrame([], ROW), -12.0, 1800).count() == 0


def test_diffusion_widens_the_cloud_by_the_root_of_time(spark):
    tiny = [(76.0, 9.0), (76.0001, 9.0), (76.0001, 9.0001)]
    d = spark.createDataFrame([(k, tiny, 0.0, 0.0, 0.0) for k in range(20)], ROW)
    spread = [r["spread_km"] for r in drift.drift_clouds(d, 12.0, 1800, n=500, diffusion=5.0, eddy=False).collect()]
    sigma = math.sqrt(2 * 5.0 * 12 * 3600) / 1000
    assert np.mean(spread) == pytest.approx(sigma * math.sqrt(-2 * math.log(0.32)), rel=0.05) and len(set(spread)) == 20


def test_ellipse_has_its_area_and_axis(spark):
    r = spark.range(1).select(drift.ellipse(F.lit(76.0), F.lit(9.0), F.lit(12.0), F.lit(9.0), F.lit(40.0), 360).alias("e")).first()["e"]
    x = np.array([((p["lon"] - 76.0) * 111.320 * math.cos(math.radians(9.0)), (p["lat"] - 9.0) * 110.574) for p in r])
    area = abs(np.dot(x[:, 0], np.roll(x[:, 1], -1)) - np.dot(x[:, 1], np.roll(x[:, 0], -1))) / 2
    far = x[np.hypot(*x.T).argmax()]
    assert area == pytest.approx(12.0, rel=1e-3) and math.degrees(math.atan2(far[0], far[1])) % 180 == pytest.approx(40.0, abs=1)


def test_gridded_drift_by_plain_loops(spark, monkeypatch):
    monkeypatch.setattr(drift, "TILE_PARTICLES", 5)
    monkeypatch.setattr(drift, "TILE_CELLS", 4)
    field = {(i, j): (math.sin(i * 0.3) * 0.4, math.cos(j * 0.2) * 0.3) for i in range(20) for j in range(15)}
    grid = spark.createDataFrame([(i, j, *uv) for (i, j), uv in field.items()], "i long, j long, u double, v double")
    rng = np.random.default_rng(2)
    points = [(k % 7, k, float(74 + rng.random() * 2), float(8 + rng.random() * 1.5)) for k in range(60)]

    def speed(p):
        x, y = (p[0] - 74.0) / 0.1, (p[1] - 8.0) / 0.1
        i, j = math.floor(x), math.floor(y)
        if not all((i + a, j + b) in field for a in (0, 1) for b in (0, 1)):
            return None
        return tuple(sum(field[i + a, j + b][c] * abs(1 - a - (x - i)) * abs(1 - b - (y - j)) for a in (0, 1) for b in (0, 1)) for c in (0, 1))

    def stepped(p, d):
        ks = []
        for share in (0, 0.5, 0.5, 1.0):
            k = speed(offset(p, ks[-1][0] * d * share, ks[-1][1] * d * share) if ks else p)
            if k is None:
                return None
            ks.append(k)
        return offset(p, *((ks[0][c] + 2 * ks[1][c] + 2 * ks[2][c] + ks[3][c]) / 6 * d for c in (0, 1)))

    got = {r["pid"]: r for r in drift.advect_grid(spark.createDataFrame(points, "candidate_id long, pid int, lon double, lat double"), grid, 74.0, 8.0, 0.1, 6.0, -1800).collect()}
    assert len(got) == 60
    for c, pid, lon, lat in points:
        p, parked = (lon, lat), False
        for _ in range(12):
            q = None if parked else stepped(p, -1800)
            parked = q is None
            p = p if parked else q
        r = got[pid]
        assert (r["candidate_id"], r["parked"]) == (c, parked) and (r["lon"], r["lat"]) == (pytest.approx(p[0], abs=1e-9), pytest.approx(p[1], abs=1e-9))
    assert any(r["parked"] for r in got.values()) and not all(r["parked"] for r in got.values())


def test_points_keep_their_columns(spark):
    p = spark.createDataFrame([("x", 76.3, 9.31, 0, 4), ("y", None, 9.0, 1, 5)], "name string, lon double, lat double, hours int, more int")
    got = {r["name"]: r for r in drift.advect(p, 1, 1800, u0=1.0).collect()}
    assert got["x"]["more"] == 4 and got["x"]["hours"] == 1.0 and got["y"]["lon"] is None
