"""Wave trains against the greedy search in plain Python, over random scenes."""

import math
import random

import numpy as np
import pytest

from tidewatch.operators import wavetrain

REGION = "scene_id long, candidate_id long, lon double, lat double, axis_deg double, elongation double, area_km2 double"


def km_and_bearing(a, b):
    dx, p, q = math.radians(b[0] - a[0]), math.radians(a[1]), math.radians(b[1])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(dx / 2) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(h)), math.atan2(math.sin(dx) * math.cos(q), math.cos(p) * math.sin(q) - math.sin(p) * math.cos(q) * math.cos(dx))


def greedy(rows):
    """Trains of one scene as (members, axis, mean gap, variation)."""
    left = sorted((r for r in rows if r[5] >= 3 and r[6] > 0), key=lambda r: (-r[6], r[1]))
    used, trains = set(), []
    for seed in left:
        if seed[1] in used:
            continue
        group = [seed]
        for other in left:
            turned = abs((other[4] - seed[4] + 90) % 180 - 90)
            if other[1] != seed[1] and other[1] not in used and turned <= 20 and max(other[6], seed[6]) / min(other[6], seed[6]) <= 3:
                group.append(other)
        if len(group) < 3:
            continue
        axis = math.degrees(math.atan2(sum(math.sin(math.radians(2 * r[4])) for r in group), sum(math.cos(math.radians(2 * r[4])) for r in group))) / 2 % 180
        offsets = []
        for r in group:
            km, bearing = km_and_bearing(seed[2:4], r[2:4])
            offsets.append(km * math.cos(bearing - math.radians(axis + 90)) if km else 0.0)
        gaps = [b - a for a, b in zip(sorted(offsets), sorted(offsets)[1:], strict=False) if b - a > 1e-6]
        if gaps and np.std(gaps) / np.mean(gaps) <= 0.45:
            used |= {r[1] for r in group}
            trains.append((frozenset(r[1] for r in group), axis, float(np.mean(gaps)), float(np.std(gaps) / np.mean(gaps))))
    return trains


def test_trains_by_plain_search(spark):
    rng = random.Random(4)
    rows = []
    for scene in range(40):
        for k in range(rng.randint(0, 14)):
            lat = 9 + 0.05 * k + rng.choice([0, 0, 0.002, 0.03])
            rows.append((scene, 1000 * scene + k, 76 + rng.random() * 0.02, lat, float(rng.choice([88, 90, 95, 100, 10])), rng.choice([2.0, 5.0, 9.0]), rng.choice([0.0, 4.0, 6.0, 10.0, 30.0])))
    rows += [(99, 99_000 + k, 76.0, 9.0, 90.0, 5.0, 4.0) for k in range(4)]  # all in one place: no gap, no train
    got = {}
    for r in wavetrain.wave_trains(spark.createDataFrame(rows, REGION)).collect():
        got.setdefault((r["scene_id"], r["train"]), []).append(r)
    want = [(s, *t) for s in {r[0] for r in rows} for t in greedy([r for r in rows if r[0] == s])]
    assert {(s, frozenset(r["candidate_id"] for r in g)) for (s, _), g in got.items()} == {(s, m) for s, m, *_ in want} and len(want) > 8
    for s, members, axis, spacing, cv in want:
        r = next(g for (k, _), g in got.items() if k == s and {x["candidate_id"] for x in g} == members)[0]
        assert (r["axis"], r["spacing_km"], r["cv"]) == (pytest.approx(axis, abs=1e-6), pytest.approx(spacing, rel=1e-6), pytest.approx(cv, rel=1e-6, abs=1e-9))
