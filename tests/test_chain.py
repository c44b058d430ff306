"""Origins and reasons in the whole chain against plain loops: the drift of each slick, and those that have none."""

import datetime
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import physics
from tidewatch.operators import wavetrain
from tidewatch.plans import screening

FOUND = "candidate_id long, lon double, lat double, area_km2 double, elongation double, axis_deg double, obs_hour long, wind_ms double, shape string, observed timestamp_ntz"
SEEN = datetime.datetime(2024, 1, 3, 4)


def velocity(lon, lat, hours):
    k = 2 * math.pi / 0.6
    return 0.25 + 0.18 * math.sin(k * lat) + 0.12 * math.cos(2 * math.pi / 12.42 * hours), -0.1 - 0.18 * math.sin(k * lon)


def km(a, b, c, d):
    h = math.sin(math.radians(d - b) / 2) ** 2 + math.cos(math.radians(b)) * math.cos(math.radians(d)) * math.sin(math.radians(c - a) / 2) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(h))


def origin(row):
    """Centre and uncertainty of 50 particles drifted back twelve hours in half-hour steps."""
    i, lon, lat, area, elongation, axis, hour, wind, *_ = row
    half = math.sqrt(area / math.pi / max(elongation, 1)) * 1000
    turn, ends = math.radians(axis), []
    for pid in range(50):
        u = [int(hashlib.md5(f"{i}|{pid}|{salt}".encode()).hexdigest()[:8], 16) / 2**32 for salt in (1, 2)]
        a, b = math.sqrt(u[0]) * math.cos(2 * math.pi * u[1]) * half * max(elongation, 1), math.sqrt(u[0]) * math.sin(2 * math.pi * u[1]) * half
        x = lon + (a * math.sin(turn) + b * math.cos(turn)) / (111_320 * math.cos(math.radians(lat)))
        y = lat + (a * math.cos(turn) - b * math.sin(turn)) / 110_574
        t = float(hour)
        for _ in range(24):
            ax, ay = -1800 / (111_320 * math.cos(math.radians(y))), -1800 / 110_574
            k = []
            for s in (0, 0.5, 0.5, 1):
                u0, v0 = k[-1] if k else (0, 0)
                u1, v1 = velocity(x + s * u0 * ax, y + s * v0 * ay, t - s / 2)
                k.append((u1 + 0.03 * wind * math.sin(turn), v1 + 0.03 * wind * math.cos(turn)))
            x += ax / 6 * (k[0][0] + 2 * (k[1][0] + k[2][0]) + k[3][0])
            y += ay / 6 * (k[0][1] + 2 * (k[1][1] + k[2][1]) + k[3][1])
            t -= 0.5
        ends.append((x, y))
    a, b = np.mean(ends, axis=0)
    return a, b, math.hypot(np.percentile([km(x, y, a, b) for x, y in ends], 68), 0.9 * 12)


def test_origins_by_plain_loops(spark):
    rows = [(7, 76.0, 9.3, 2.5, 8.0, 30.0, 52, 5.0, "linear", SEEN), (8, 76.2, 9.1, 0.4, 1.0, 120.0, 9, 0.0, "blob", SEEN), (9, 170.0, 40.0, 1.0, 0.5, 0.0, 0, 11.0, "unknown", SEEN)]
    none = [(20, 76.0, 9.0, 0.0, 2.0, 1.0, 3, 1.0, "blob", SEEN), (21, 76.0, 9.0, None, 2.0, 1.0, 3, 1.0, "blob", SEEN), (22, None, 9.0, 1.0, 2.0, 1.0, 3, 1.0, "blob", SEEN)]
    got = {r["candidate_id"]: r for r in screening.origins_of(spark.createDataFrame(rows + none, FOUND)).collect()}
    assert set(got) == {7, 8, 9}
    for row in rows:
        r = got[row[0]]
        assert (r["lon"], r["lat"], r["unc_km"]) == pytest.approx(origin(row), rel=1e-9)
        assert r["release"] == SEEN - datetime.timedelta(hours=12) and r["axis_deg"] == (30.0 if row[0] == 7 else None)
    assert screening.origins_of(spark.createDataFrame([], FOUND)).collect() == []


def test_first_reason_counts(spark):
    rows = [(True, 0.0, "vessel", False, None, 0, None, None), (False, 0.1, "natural_seep", False, None, 0, None, None), (False, 0.5, "natural_seep", False, None, 0, None, None), (False, 0.5, "vessel", False, None, 0, None, None),
            (False, 0.5, "vessel", True, 61.0, 3, 0.9, 0.1), (False, 0.5, "vessel", True, 20.0, 0, None, None), (False, 0.5, "vessel", True, 20.0, 1, 0.3, None), (False, 0.5, "vessel", True, 20.0, 2, 0.6, 0.55), (False, 0.5, "unknown", True, 20.0, 2, 0.6, 0.5), (False, 0.5, "unknown", True, 20.0, 1, 0.6, None)]
    df = spark.createDataFrame(rows, "rejected boolean, win double, source_type string, has_origin boolean, unc_km double, vessels long, top double, second double")
    got = [r[0] for r in df.select(physics.abstain_reason(*(F.col(c) for c in df.columns))).collect()]
    assert got == ["not classified as oil", "wind at the edge of the detection window", "source classified as natural seep", "no drift origin", "drift origin too uncertain", "no AIS tracks near the origin", "best candidate below threshold", "top two candidates too close", None, None]


def test_wave_trains_reject_before_anything_else(spark):
    """A train's members are rejected with a reason of their own; those that were rejected keep theirs."""
    judged = spark.createDataFrame([(1, None, 0.9, False), (2, "too_small", 0.1, True), (3, None, 0.8, False), (4, None, 0.15, False)], "candidate_id long, gate string, p_oil double, rejected boolean")
    trains = spark.createDataFrame([(1,), (2,), (4,)], "candidate_id long")
    got = sorted(map(tuple, wavetrain.override(judged, trains).select("candidate_id", "gate", "p_oil", "rejected").collect()))
    assert got == [(1, "internal_wave_train", 0.2, True), (2, "too_small", 0.1, True), (3, None, 0.8, False), (4, "internal_wave_train", 0.15, True)]
