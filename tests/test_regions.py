"""Region extraction against plain loops, outlines of hand-made shapes, fields in time, sinks."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import cells, raster, regions
from tidewatch.functions.geo import haversine_km
from tidewatch.sources import fields, sinks

NEAR = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]


@pytest.fixture(scope="module")
def scene():
    rng = np.random.default_rng(5)
    db = rng.normal(-16, 1, (40, 50))
    db[5:12, 8:30] -= 8
    db[8, 15] = -16  # a hole that closing fills
    db[20:23, 20:23] -= 9
    db[30:38, 3:5] -= 9
    db[0:3, 45:50] -= 9  # at the rim
    land = np.zeros(db.shape, dtype=bool)
    land[10:14, 28:32] = True
    return db, land, 1 / (1 + np.exp((db + 20) / 0.5))


def frame(spark, scene):
    db, land, p = scene
    rows = [(i, j, float(db[i, j]), float(p[i, j]), bool(land[i, j])) for i in range(db.shape[0]) for j in range(db.shape[1])]
    return spark.createDataFrame(rows, "r long, c long, db double, p double, land boolean")


def closed(dark, land):
    grown = {(i, j) for i in range(dark.shape[0]) for j in range(dark.shape[1]) if any(0 <= i + a < dark.shape[0] and 0 <= j + b < dark.shape[1] and dark[i + a, j + b] for a, b in NEAR)}
    return {(i, j) for i, j in grown if all((i + a, j + b) in grown for a, b in NEAR) and not land[i, j]}


def floods(cells_):
    left, out = set(cells_), []
    while left:
        todo, own = [left.pop()], set()
        while todo:
            p = todo.pop()
            own.add(p)
            for a, b in NEAR:
                q = (p[0] + a, p[1] + b)
                if q in left:
                    left.discard(q)
                    todo.append(q)
        out.append(own)
    return out


def test_regions_by_plain_loops(spark, scene):
    db, land, p = scene
    dark = closed((p >= 0.5) & ~land, land)
    pixels = frame(spark, scene)
    assert {(r.r, r.c) for r in regions.closing(pixels.where("p >= 0.5 AND NOT land").select("r", "c"), pixels).collect()} == dark
    want = {min(r * (1 << 32) + c for r, c in own): own for own in floods(dark) if len(own) >= max(4, round(0.05 / 0.08**2))}
    got = {r["label"]: r for r in regions.extract(pixels, 0.5, 0.08, 0.05).collect()}
    assert got.keys() == want.keys() and len(want) >= 3
    power = 10 ** (db / 10)
    for label, own in want.items():
        r = got[label]
        assert r["pixels"] == len(own) and r["area_km2"] == pytest.approx(len(own) * 0.0064)
        edge = {q for q in own if any((q[0] + a, q[1] + b) not in own for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0)))}
        long = sum(regions.STEP_LENGTH.get(1 + 2 * sum((i + a, j + b) in edge for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0))) + 10 * sum((i + a, j + b) in edge for a in (-1, 1) for b in (-1, 1)), 0) for i, j in edge) or 1.0
        assert r["perimeter"] == pytest.approx(long) and r["compactness"] == pytest.approx(min(1, 4 * math.pi * len(own) / long**2))
        assert (r["r0"], r["c0"], r["r1"], r["c1"]) == (min(i for i, _ in own), min(j for _, j in own), max(i for i, _ in own), max(j for _, j in own))
        ring = [(i, j) for i in range(db.shape[0]) for j in range(db.shape[1]) if (i, j) not in own and not land[i, j] and any(abs(i - a) + abs(j - b) <= 8 for a, b in own)]
        clear = [power[q] for q in ring if q not in dark]
        assert r["clear_pixels"] == len(clear) and r["surround_db"] == pytest.approx(10 * math.log10(np.mean(clear)))
        assert r["damping_ratio"] == pytest.approx(np.mean([power[q] for q in own]) / np.mean(clear))
        assert r["mean_confidence"] == pytest.approx(np.mean([p[q] for q in own]))


def test_surroundings_fall_back_to_dark_sea(spark):
    pixels = spark.createDataFrame([(i, j, -20.0) for i in range(5) for j in range(5)], "r long, c long, db double")
    region = spark.createDataFrame([(1, 2, 2)], "label long, r long, c long")
    got = regions.surroundings(region, pixels, pixels).first()
    assert (got["clear_pixels"], got["surround_db"], got["damping_ratio"]) == (0, pytest.approx(-20.0), pytest.approx(1.0))
    alone = regions.surroundings(region, pixels.where("r = 2 AND c = 2"), pixels).first()
    assert alone["surround_db"] is None and alone["damping_ratio"] is None


def test_no_dark_pixel_no_region(spark, scene):
    assert regions.extract(frame(spark, scene), 1.1, 0.08, 0.05).count() == 0


def area(ring):
    return abs(np.dot(ring[:-1, 0], ring[1:, 1]) - np.dot(ring[1:, 0], ring[:-1, 1])) / 2


@pytest.mark.parametrize("shape", [[(0, 0)], [(i, j) for i in range(4) for j in range(7)], [(i, j) for i in range(6) for j in range(6) if i < 2 or j < 2], [(i, j) for i in range(7) for j in range(7) if not (2 < i < 5 and 2 < j < 5)]])
def test_outlines(shape):
    r, c = np.array(shape).T
    ring = regions.trace(r, c)
    assert (ring[0] == ring[-1]).all() and len(ring) > 4
    assert (np.abs(np.diff(ring, axis=0)).sum(axis=1) == 1).all()  # every step leads from one middle of a side to the next
    box = set(map(tuple, shape)) | {(3, 3), (3, 4), (4, 3), (4, 4)} if len(shape) == 45 else set(shape)
    corners = sum(1 for i, j in {(i - a, j - b) for i, j in box for a in (0, 1) for b in (0, 1)} if sum((i + a, j + b) in box for a in (0, 1) for b in (0, 1)) in (1, 3))
    full = sum(1 for i, j in {(i - a, j - b) for i, j in box for a in (0, 1) for b in (0, 1)} if sum((i + a, j + b) in box for a in (0, 1) for b in (0, 1)) == 4)
    assert area(ring) > 0 and corners >= 4 and area(ring) >= full


def test_pixels_that_touch_by_a_corner_are_apart_and_lines_are_simplified(spark):
    ring = regions.trace(np.array([0, 1]), np.array([0, 1]))
    assert len(ring) == 5
    line = np.array([(0.0, float(k) + 0.3 * (k % 2)) for k in range(20)] + [(10.0, 19.0), (0.0, 0.0)])
    kept = regions.simplified(line, 1.5)
    assert len(kept) == 4 and (kept[0] == kept[-1]).all()
    square = spark.createDataFrame([(1, i, j) for i in range(10, 20) for j in range(10, 30)] + [(2, 0, 0)], "label long, r long, c long")
    got = {r["label"]: r for r in regions.contours(square, (70.0, 0.0, 71.0, 1.0), 101, 101).collect()}
    assert got[1]["wkt"].startswith("POLYGON ((") and 5 <= got[1]["vertices"] <= 9 and "70.100000" not in got[2]["wkt"]


def test_annotation_windows(spark):
    box = lambda *x: F.struct(*(F.lit(v).alias(n) for v, n in zip(x, ("west", "south", "east", "north"), strict=True)))
    row = spark.range(1).select(
        regions.pixel_window(box(70.2, 10.2, 70.4, 10.6), (70.0, 10.0, 71.0, 11.0), 200, 100).alias("a"),
        regions.pixel_window(box(69.0, 9.0, 70.05, 10.05), (70.0, 10.0, 71.0, 11.0), 200, 100).alias("b"), regions.pixel_window(box(70.2, 10.2, 70.21, 10.6), (70.0, 10.0, 71.0, 11.0), 200, 100).alias("c"),
    ).first()
    assert tuple(row.a)[1::2] == (20, 40) and tuple(row.a)[::2] in {(80, 160), (80, 159), (79, 160)} and row.b.c0 == 0 and row.b.r1 == 200 and row.c is None


def test_speckle_filters_by_name(spark):
    grid = np.random.default_rng(1).normal(-17, 2, (8, 8))
    px = spark.createDataFrame([(0, i, j, float(grid[i, j])) for i in range(8) for j in range(8)], "tile long, r long, c long, db double")
    padded = np.pad(grid, 2, mode="symmetric")
    for r in raster.filtered(px, "median", 5, (8, 8), ("tile",)).collect():
        assert r.db == pytest.approx(np.median(padded[r.r : r.r + 5, r.c : r.c + 5]))
    assert raster.filtered(px, "none", 5, (8, 8), ("tile",)).count() == raster.filtered(px, "lee", 3, (8, 8), ("tile",)).count() == raster.filtered(px, "refined_lee", 7, (8, 8), ("tile",)).count() == 64
    with pytest.raises(ValueError, match="no such"):
        raster.filtered(px, "boxcar", 3, (8, 8))


def test_cells_find_every_pair_on_the_globe(spark):
    rng = np.random.default_rng(4)
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(rng.uniform(-180, 180, 500), np.degrees(np.arcsin(rng.uniform(-1, 1, 500))), strict=True))]
    points += [(500, 179.99, 10.0), (501, -179.99, 10.0), (502, 0.0, 90.0), (503, 120.0, 89.9), (504, -60.0, -90.0), (505, 10.0, 0.0)]
    reach = {i: float(r) for i, r in zip(range(506), np.exp(rng.uniform(np.log(3), np.log(2000), 506)), strict=True)}
    p = spark.createDataFrame(points, "a long, lon double, lat double")
    t = spark.createDataFrame([(i, x, y, reach[i]) for i, x, y in points], "b long, tlon double, tlat double, reach double")
    met = cells.meet(cells.place_points(p, cells.levels(3, 10)), cells.place_targets(t, F.col("reach"), 3, 10, "tlon", "tlat"))
    km = haversine_km(F.col("lon"), F.col("lat"), F.col("tlon"), F.col("tlat"))
    got = [(r["a"], r["b"]) for r in met.where(km <= F.col("reach")).collect()]
    whole = p.crossJoin(t).where(km <= F.col("reach")).collect()
    assert len(got) == len(set(got)) and set(got) == {(r["a"], r["b"]) for r in whole} and len(got) > 600


def test_fields_in_time(spark):
    grid = spark.createDataFrame([(k, i, j, float(i), float(10 * k + j)) for k in range(3) for i in range(3) for j in range(3) if (k, i, j) != (2, 2, 2)], "k long, i long, j long, u double, v double")
    points = spark.createDataFrame([(1, 1.5, 70.5, 9.5), (2, 2.0, 71.0, 9.0), (3, 4.5, 70.0, 10.0), (4, 3.9, 71.9, 8.1)], "id long, t double, lon double, lat double")
    axes = {"t": (0.0, 2.0), "lon": (70.0, 1.0), "lat": (10.0, -1.0)}
    got = {r["id"]: (r["u"], r["v"]) for r in fields.sample(points, grid, axes, outside="null").collect()}
    assert got[1] == (pytest.approx(0.5), pytest.approx(8.0)) and got[2] == (pytest.approx(1.0), pytest.approx(11.0)) and got[3] == (None, None) and got[4] == (None, None)
    assert fields.sample(points.where("id < 3"), grid, axes).count() == 2
    with pytest.raises(Exception, match="outside of the field: 3"):
        fields.sample(points, grid, axes).collect()


def test_fields_by_settings(spark, tmp_path):
    p = spark.createDataFrame([(1, 70.0, 9.0)], "candidate_id long, lon double, lat double")
    assert tuple(fields.wind_of({"wind": {"source": "constant", "speed_ms": 6, "direction_deg": 90}})(p).first())[3:] == (6.0, 90.0, "constant")
    assert fields.wind_of({})(p).first()["wind_source"] == "synthetic"
    with pytest.raises(ValueError, match="unknown wind"):
        fields.wind_of({"wind": {"source": "x"}})
    assert fields.currents_of({"currents": {"source": "constant", "u": 1, "v": 2}}, spark) == {"u0": 1.0, "v0": 2.0, "eddy": False} and fields.currents_of({}, spark) == {"eddy": True}
    spark.createDataFrame([(0, 0, 0, 1.0, 1.0)], "k long, i long, j long, u double, v double").write.parquet(f"{tmp_path}/s1")
    assert fields.currents_of({"currents": {"source": "grid", "path": str(tmp_path), "per_scene": True}}, spark, "s1")["grid"].count() == 1
    with pytest.raises(ValueError, match="unknown current"):
        fields.currents_of({"currents": {"source": "x"}}, spark)


def test_kept_results_and_lines(spark, tmp_path):
    df = spark.createDataFrame([("s1", 1.0), ("s2", float("nan"))], "scene_id string, x double")
    first = sinks.write_once(df, f"file://{tmp_path}/cache", "1", "s1", {"a": 1})
    again = sinks.write_once(df.withColumn("x", F.lit(9.0)), f"file://{tmp_path}/cache", "1", "s1", {"a": 1})
    assert sorted(map(str, first.collect())) == sorted(map(str, again.collect()))
    assert sinks.write_once(df.withColumn("x", F.lit(9.0)), f"file://{tmp_path}/cache", "2", "s1", {"a": 1}).first()["x"] == 9.0
    for _ in range(2):
        sinks.write_results(df, f"{tmp_path}/results")
    (tmp_path / "results" / "torn.json").write_text('{"scene_id": "s3", "x": 2.0}\n{"scene_id": "s4", "x"')
    assert sorted(r["scene_id"] for r in sinks.completed(spark, f"{tmp_path}/results", "scene_id string, x double").collect() if r["scene_id"]) == ["s1", "s1", "s2", "s2", "s3"]
    sinks.world_index(df, f"{tmp_path}/world")
    assert spark.read.json(f"{tmp_path}/world").count() == 2
    sinks.manifests(df, f"{tmp_path}/manifests")
    files = list((tmp_path / "manifests").glob("scene=s1/*.json"))
    assert json.loads(files[0].read_text())["scene_id"] == "s1"
    sinks.feature_table(df, f"{tmp_path}/features")
    assert spark.read.option("header", True).csv(f"{tmp_path}/features").count() == 2
