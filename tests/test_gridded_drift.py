"""Drift through gridded currents in time against a plain loop over the whole grid."""

import math

import numpy as np
import pytest

from tidewatch.operators import gridded

T, LON, LAT = gridded.Axis(0.0, 3.0, 12), gridded.Axis(74.0, 0.05, 80), gridded.Axis(12.0, -0.05, 70)
FIELD = "k int, i int, j int, u double, v double"
POINT = "candidate_id long, pid int, lon double, lat double, t double, wind_u double, wind_v double, x string"


def grid():
    k, i, j = np.meshgrid(*(np.arange(a.nodes) for a in (T, LON, LAT)), indexing="ij")
    return 1.5 * np.sin(i * 0.11 + k * 0.7), 1.2 * np.cos(j * 0.13 - k * 0.3)


def plain(u, v, lon, lat, t, hours, dt, wind):
    """One particle, step by step."""

    def velocity(x, y, h):
        place = [(h - T.start) / T.step, (x - LON.start) / LON.step, (y - LAT.start) / LAT.step]
        low = [math.floor(p) for p in place]
        if any(f < 0 or f > a.nodes - 2 for f, a in zip(low, (T, LON, LAT), strict=True)):
            return None
        out = [0.03 * w for w in wind]
        for c in np.ndindex(2, 2, 2):
            w = math.prod(p - f if one else 1 - (p - f) for p, f, one in zip(place, low, c, strict=True))
            if w:
                at = tuple(f + one for f, one in zip(low, c, strict=True))
                out[0] += w * u[at]
                out[1] += w * v[at]
        return None if any(math.isnan(x) for x in out) else out

    for _ in range(round(hours * 3600 / abs(dt))):
        ax, ay = dt / (111_320 * math.cos(math.radians(lat))), dt / 110_574
        ks = []
        for s in (0, 0.5, 0.5, 1):
            a, b = ks[-1] if ks else (0, 0)
            k = velocity(lon + s * a * ax, lat + s * b * ay, t + s * dt / 3600)
            if k is None:
                return lon, lat, t, True
            ks.append(k)
        lon += ax / 6 * (ks[0][0] + 2 * (ks[1][0] + ks[2][0]) + ks[3][0])
        lat += ay / 6 * (ks[0][1] + 2 * (ks[1][1] + ks[2][1]) + ks[3][1])
        t += dt / 3600
    return lon, lat, t, False


@pytest.mark.parametrize(("chunk", "particles", "dt"), [((2, 6, 7), 20, -1800.0), ((50, 100, 100), 50_000, 1200.0)])
def test_particles_migrate_between_chunks(spark, monkeypatch, chunk, particles, dt):
    monkeypatch.setattr(gridded, "CHUNK", chunk)
    monkeypatch.setattr(gridded, "PARTICLES", particles)
    monkeypatch.setattr(gridded, "FASTEST", 3.0)
    u, v = grid()
    u[:, 40:44, 30:33] = np.nan  # an island
    rng = np.random.default_rng(2)
    start = 30.0 if dt < 0 else 2.0
    points = [(int(n // 30), int(n % 30), float(74.3 + 3.3 * a), float(8.8 + 2.9 * b), start, float(5 * c), -2.0, "x") for n, (a, b, c) in enumerate(rng.random((90, 3)))]
    points += [(9, 0, 60.0, 9.0, start, 0.0, 0.0, "off"), (9, 1, None, 9.0, start, 0.0, 0.0, "null"), (9, 2, 75.0, 10.0, 500.0, None, None, "late")]
    nodes = [(int(k), int(i), int(j), None if math.isnan(u[k, i, j]) else float(u[k, i, j]), float(v[k, i, j])) for k, i, j in np.ndindex(u.shape)]
    out = gridded.advect_field(spark.createDataFrame(points, POINT), spark.createDataFrame(nodes, FIELD), T, LON, LAT, 24.0, dt)
    got = {(r["candidate_id"], r["pid"]): r for r in out.collect()}
    assert len(got) == len(points) == out.count()
    ends = set()
    for i, p, lon, lat, t, a, b, _ in points:
        r = got[i, p]
        if lon is None:
            assert r["parked"] and r["lon"] is None
            continue
        *place, parked = plain(u, v, lon, lat, t, 24.0, dt, (a or 0.0, b or 0.0))
        assert r["parked"] == parked and [r["lon"], r["lat"], r["t"]] == pytest.approx(place, abs=1e-9)
        ends.add(parked)
    assert ends == {True, False}


def test_random_walk_does_not_hang_on_chunks(spark, monkeypatch):
    u, v = grid()
    nodes = spark.createDataFrame([(int(k), int(i), int(j), float(u[k, i, j]), float(v[k, i, j])) for k, i, j in np.ndindex(u.shape)], FIELD)
    points = spark.createDataFrame([(1, n, 76.0, 10.5, 3.0, 0.0, 0.0, "x") for n in range(400)], POINT)
    made = []
    for chunk in ((2, 8, 8), (20, 90, 90)):
        monkeypatch.setattr(gridded, "CHUNK", chunk)
        made.append(sorted((r["pid"], r["lon"], r["lat"]) for r in gridded.advect_field(points, nodes, T, LON, LAT, 6.0, 1800.0, diffusion=20.0).collect()))
    assert np.allclose(made[0], made[1], atol=1e-9)
    lon, lat = np.array(made[0])[:, 1], np.array(made[0])[:, 2]
    assert lat.std() * 110_574 == pytest.approx(math.sqrt(2 * 20 * 6 * 3600), rel=0.15) and lon.std() * 111_320 * math.cos(math.radians(10.5)) > 500


def test_steps_beyond_the_rim_are_refused(spark, monkeypatch):
    monkeypatch.setattr(gridded, "CHUNK", (2, 4, 4))
    u, v = grid()
    nodes = spark.createDataFrame([(int(k), int(i), int(j), 90.0, 0.0) for k, i, j in np.ndindex(u.shape)], FIELD)
    with pytest.raises(Exception, match="shorter"):
        gridded.advect_field(spark.createDataFrame([(1, 1, 75.0, 10.0, 9.0, 0.0, 0.0, "x")], POINT), nodes, T, LON, LAT, 2.0, 1800.0).collect()
