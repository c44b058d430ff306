"""What a reviewer found in round 4, each on the smallest table that shows it."""

from datetime import datetime

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions
from test_findings_r03 import plan_of, same_as_sql


def test_f10_a_mean_axis_just_below_0_is_180_as_in_sql(spark, tmp_path):
    keys = [k for a in range(1, 90) for k in (a, 180 - a)]  # two axes either side of 0: the sine's sum is 0 or what rounding leaves; 45 and 135 cancel
    got = same_as_sql(spark, tmp_path, "a03_mean_axis", orders=pa.table({"o_orderkey": keys, "o_custkey": [n // 2 for n in range(len(keys))]}))
    assert len(got) == 88 and any("180.0" in r for r in got) and any(", 0.0," in r for r in got)


def joined(*_, **__):
    raise AssertionError("pairs of origins and fixes or silences go through a join")


@pytest.mark.parametrize("name", ["w08_ranked_vessels", "w09_margins", "j05_closest_approach", "j06_j07_dark_events", "o03_most_suspicious"])
def test_f3_f4_f6_f7_f8_pairs_are_never_joined_or_shuffled(spark, tmp_path, monkeypatch, name):
    from tidewatch.operators import around, cells

    events = pq.read_table("/root/testdata/sf0.001/events.parquet")
    keys = [k * 7 + 126_000 * n for k in range(60) for n in range(2)]  # places, times and axes repeat after so many keys
    monkeypatch.setattr(cells, "meet", joined)
    monkeypatch.setattr(around, "ORIGINS", 2)  # a group's origins go to several tasks
    monkeypatch.setattr(around, "PIECE", 7)
    same_as_sql(spark, tmp_path, name, events=events, orders=pa.table({"o_orderkey": keys, "o_custkey": [k % 7 for k in keys]}))


def fixes_and_origins(spark, seed):
    """A crowd of fixes, a few across the date line, one; some origins near them, one far away."""
    rng = np.random.default_rng(seed)
    at = lambda h: datetime.fromtimestamp(1704067200 + int(h * 3600) + 0.25)
    spots = [(76.0, 9.4), (179.97, 71.0), (30.0, -2.0)]
    fixes = [(k, int(v), at(60 * rng.random()), x + 0.7 * (rng.random() - 0.5), y + 0.7 * (rng.random() - 0.5), float(rng.integers(360))) for k, (v, (x, y)) in enumerate([(v, spots[0]) for v in rng.integers(0, 400, 4000)] + [(v, spots[1]) for v in rng.integers(0, 40, 200)] + [(9999, spots[2])])]
    fixes = [(e, v, t, (float(x) + 180) % 360 - 180, float(y), c) for e, v, t, x, y, c in fixes] + [(99_999, 5, at(20), None, None, 1.0), (99_998, None, at(21), 76.0, 9.4, 2.0)]
    pos = spark.createDataFrame(fixes, "event_id long, mmsi long, ts timestamp_ntz, lon double, lat double, cog double").withColumn("sog", functions.lit(1.0)).repartition(4)
    origin = [(k, float((x + 0.5 * (rng.random() - 0.5) + 180) % 360 - 180), float(y + 0.5 * (rng.random() - 0.5)), None if k % 9 == 0 else float(rng.choice([0.5, 11, 30, 58])), at(8 + 40 * rng.random()), None if k % 2 else float(rng.integers(180))) for k, (x, y) in enumerate([spots[0]] * 40 + [spots[1]] * 30 + [spots[2]] * 9)]
    origin += [(900, -120.0, 0.0, 11.0, at(20), 3.0), (901, None, 9.0, 11.0, at(20), 3.0)]
    return pos, spark.createDataFrame(origin, "candidate_id long, lon double, lat double, unc_km double, release timestamp_ntz, axis_deg double")


@pytest.mark.parametrize("levels", [(11, 9, 7), (7,)])
def test_f1_f3_f4_all_vessels_round_an_origin_are_those_of_the_join(spark, monkeypatch, levels):
    from tidewatch.operators import around, joins, tracks
    from tidewatch.plans import vessels

    pos, origins = fixes_and_origins(spark, 41)
    monkeypatch.setattr(vessels, "relation", lambda *_: pos)
    monkeypatch.setattr(around, "LEVELS", levels)
    digits = lambda r: tuple(round(x, 9) if isinstance(x, float) else x for x in r)
    rows = lambda df: {(r[0], r[1]): digits(r) for r in df.collect()}
    near = ("candidate_id", "mmsi", "approach_at", "km", "hours")
    found = rows(around.approaches(origins, pos).select(*near))
    assert found == rows(joins.closest_approach(origins, pos, 8, 6).select(*near)) and len(found) > 1000 and any(m is None for _, m in found)
    every = vessels.ranked_vessels(spark, "", origins)
    best = ("candidate_id", "mmsi", "place", "went_dark", "parity", "proximity", "temporality", "score")
    gaps, courses = tracks.gaps(pos), tracks.mean_courses(pos)
    for n in (2, 3):
        assert rows(around.best_vessels(origins, pos, gaps, courses, n).select(*best)) == rows(every.where(functions.col("place") <= n).select(*best))
    place = lambda n, c: functions.max(functions.when(functions.col("place") == n, functions.col(c)))
    sums = every.groupBy("candidate_id").agg(functions.count("*"), place(1, "score"), place(2, "score"), place(1, "mmsi"))
    assert rows(around.two_of_all(origins, pos, gaps, courses)) == rows(sums) and sums.count() > 60


def test_f7_f8_silences_round_an_origin_are_those_of_the_join(spark):
    from tidewatch.operators import around, joins, tracks

    pos, origins = fixes_and_origins(spark, 43)
    gaps = tracks.gaps(pos)
    rows = lambda df: sorted(str(tuple(round(x, 9) if isinstance(x, float) else x for x in r)) for r in df.collect())
    columns = ("candidate_id", "mmsi", "minutes", "km", "suspicion")
    events = joins.dark_events(origins, gaps)
    found = rows(around.silences(origins, pos, gaps, least=0.2).select(*columns))
    assert found == rows(events.where("suspicion >= 0.2").select(*columns)) and len(found) > 500
    from pyspark.sql import Window

    place = functions.row_number().over(Window.partitionBy("candidate_id").orderBy(functions.desc("suspicion"), "mmsi", "minutes"))
    best = rows(around.silences(origins, pos, gaps, best=3).select(*columns, "place"))
    assert best == rows(events.withColumn("place", place).where("place <= 3").select(*columns, "place")) and len(best) > 100


def test_f9_slicks_and_areas_meet_as_lists_that_are_spread_where_they_meet(spark, tmp_path, monkeypatch):
    from tidewatch.operators import areas
    from tidewatch.plans import catalog

    orders = pa.table({"o_orderkey": [k + 7000 * n for k in range(100) for n in range(9)], "o_custkey": [1] * 900})  # places repeat after 7,000 keys
    supplier = pa.table({"s_suppkey": [k + 39_000 * n for k in range(1, 40) for n in range(4)]})  # outlines after 39,000
    for most in (4096, 2):  # some lists are cut
        monkeypatch.setattr(areas, "IDS", most, raising=False)
        assert len(same_as_sql(spark, tmp_path, "j14_g01_areas_of_slicks", orders=orders, supplier=supplier)) > 6000
    wrote, write = [], areas.written
    monkeypatch.setattr(areas, "written", lambda df, name: wrote.append(df.count()) or write(df, name))
    plan = plan_of(catalog.queries()["j14_g01_areas_of_slicks"](spark, str(tmp_path)))
    assert sum(wrote) <= 156 and "Exchange" not in plan[: plan.index("SortMergeJoin")]  # pairs of places and areas are neither written, shuffled nor joined again
    points = spark.createDataFrame([(1, 76.0, 9.5), (None, 76.0, 9.5), (3, None, 9.5)], "candidate_id long, lon double, lat double")
    drawn = spark.createDataFrame([(k, "POLYGON ((75.5 9, 76.5 9, 76 10.5))") for k in (7, 8)], "area_id long, wkt string")
    assert sorted(map(str, areas.areas_of_all(points, drawn, 0.1).select("candidate_id", "area_id").collect())) == sorted(f"Row(candidate_id={c}, area_id={a})" for c in (1, None) for a in (7, 8))


def test_f5_a_slick_s_particles_are_laid_out_once_for_its_three_states(spark):
    from tidewatch.operators import drift
    from tidewatch.plans import catalog

    assert plan_of(catalog.queries()["d05_n07_timeline"](spark, "/root/testdata/sf0.001")).count("MapInArrow") == 1
    ring = [(76 + 0.02 * np.cos(t) * c - 0.001 * np.sin(t) * s, 9 + 0.02 * np.cos(t) * s + 0.001 * np.sin(t) * c) for t in np.arange(16) * np.pi / 8 for c, s in [(0.8, 0.6)]]
    points = drift.sample_polygon(np.array(ring), 300, drift.generator(5))
    outer = drift._outer(points)  # of a narrow cloud, few are left to be ordered
    assert len(outer) < 60 and drift.hull_wkt(outer) == drift.hull_wkt(points)
    hull = [tuple(map(float, p.split())) for p in drift.hull_wkt(points)[10:-2].split(", ")]
    assert all((bx - ax) * (y - ay) - (by - ay) * (x - ax) > -1e-7 for (ax, ay), (bx, by) in zip(hull, hull[1:], strict=False) for x, y in points)
    rows = [(k, [{"lon": float(x), "lat": float(y)} for x, y in ring] if k else [], 5.0, 3.0, -1.0) for k in range(4)]
    seeded = spark.createDataFrame(rows, "candidate_id long, ring array<struct<lon: double, lat: double>>, at double, wind_u double, wind_v double")
    both = sorted(map(str, drift.drift_clouds(seeded, [-3.0, 5.0], 1800, n=50).drop("leg").collect()))
    assert both == sorted(str(r) for h in (-3.0, 5.0) for r in drift.drift_clouds(seeded, h, 1800, n=50).collect()) and len(both) == 8


def test_f2_tall_narrow_windows_are_measured_in_tasks_too(spark, monkeypatch):
    from tidewatch.operators import objects

    rng = np.random.default_rng(2)
    pixels = spark.createDataFrame([(r, c, None if (r * 7 + c) % 11 == 0 else float(np.round(rng.normal(-15, 2), 3))) for r in range(200) for c in range(40)], "r long, c long, db double")
    windows = spark.createDataFrame([(k, 13 * k, 3 * k, 13 * k + 60, 3 * k + 6) for k in range(10)] + [(50, 40, 5, 64, 25)], "object_id long, r0 long, c0 long, r1 long, c1 long")
    rows = lambda: {r[0]: r for r in objects.object_features(windows, pixels).collect()}
    monkeypatch.setattr(objects, "CELL", 16)
    monkeypatch.setattr(objects, "MOST_CELL", 1)
    want = rows()  # all summed up by Spark, pixel by pixel
    monkeypatch.setattr(objects, "MOST_CELL", 64)
    monkeypatch.setattr(objects, "_measured_by_groups", joined)
    got = rows()
    assert got.keys() == want.keys() and len(got) == 11
    assert all(np.allclose([x or 0.0 for x in got[k]], [x or 0.0 for x in want[k]], rtol=0, atol=1e-9) for k in got)
