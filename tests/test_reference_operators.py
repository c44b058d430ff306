"""Operators on hand-made rows with known results."""

import json
import math
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import geo, physics, text
from tidewatch.operators import drift, evaluation, joins, raster, tracks, wavetrain
from tidewatch.sources import config, readers, relations, sinks, world_incidents


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_geodesy(spark):
    x = lambda v: F.lit(float(v))
    r = one(
        spark, km=geo.haversine_km(x(0), x(0), x(1), x(0)), north=geo.bearing_deg(x(0), x(0), x(0), x(1)), east=geo.bearing_deg(x(0), x(0), x(1), x(0)), across=geo.angular_difference_deg(x(350), x(10)),
        axis=geo.axial_difference_deg(x(90), x(270)), square=geo.axial_difference_deg(x(0), x(90)), to=geo.destination_point(x(179.9), x(0), x(90), x(100)), box=geo.expand_box(x(-179.9), x(89.9), x(179.9), x(90), x(100)),
        pixel=geo.pixel_to_lonlat(F.lit(0), F.lit(99), F.lit(100), F.lit(100), (72.0, 15.0, 72.6, 15.6)),
    )
    assert r.km == pytest.approx(111.195, abs=1e-2) and r.north == 0 and r.east == pytest.approx(90) and r.across == 20 and r.axis == 0 and r.square == 90
    assert -180 <= r.to.lon < -179 and r.box.north == 90 and r.box.west == -180 and (r.pixel.lon, r.pixel.lat) == (72.6, 15.6)


@pytest.mark.parametrize(("wind", "score"), [(2.0, 0), (2.75, 0.5), (3.5, 1), (7.5, 1), (9.75, 0.5), (12, 0), (float("nan"), 0), (float("inf"), 0), (None, 0)])
def test_wind_window(spark, wind, score):
    assert one(spark, s=physics.wind_window_score(F.lit(wind).cast("double"))).s == pytest.approx(score)


@pytest.mark.parametrize(
    ("case", "gate", "oil"),
    [
        (dict(), None, True), (dict(wind=1.2), "wind_too_low", False), (dict(wind=13.0), None, False), (dict(wind=float("nan")), "no_wind", False), (dict(damping=10, elong=40, wind=0.5), "wind_too_low", False),
        (dict(damping=3.5, elong=1.6, comp=0.82, homog=0.48, contrast=34, wind=6.2), None, False), (dict(damping=4.5, elong=1.2, comp=0.9, homog=0.55, contrast=45, wind=7.0), None, False), (dict(damping=0.5), "insufficient_damping", False), (dict(area=0.01), "too_small", False),
    ],
)
def test_lookalike_cases(spark, case, gate, oil):
    f = dict(damping=8.0, elong=22.0, comp=0.08, homog=0.78, contrast=6.0, area=8.0, wind=5.5) | case
    lit = {k: F.lit(float(v)) for k, v in f.items()}
    contributions = physics.contributions(physics.evidence(lit["wind"], lit["damping"], lit["elong"], lit["comp"], lit["homog"], lit["contrast"], lit["area"], F.lit(None).cast("double")))
    r = one(spark, gate=physics.gate(lit["wind"], lit["damping"], lit["area"]), p=physics.logistic(contributions), c=contributions)
    assert r.gate == gate and r.c["vh_vv"] == 0 and (r.gate is None and r.p >= 0.5) == oil


def test_morphology_catalogue_first(spark):
    points = spark.createDataFrame([(1, 76.14, 9.31, 22.0, 0.08), (2, 72.0, 15.0, 22.0, 0.08), (3, 72.0, 15.0, 2.0, 0.8), (4, 72.0, 15.0, 4.0, 0.4)], "id long, lon double, lat double, e double, c double")
    near = joins.match_known_source(points, relations.known_sources(spark)).withColumn("m", physics.morphology(F.col("source_kind"), F.col("e"), F.col("c")))
    assert {r.id: tuple(r.m) for r in near.collect()} == {1: ("blob", "infrastructure"), 2: ("linear", "vessel"), 3: ("blob", "unknown"), 4: ("unknown", "unknown")}
    assert tuple(one(spark, m=physics.morphology(F.lit(None), F.lit(22.0), F.lit(0.08), F.lit(True))).m) == ("blob", "infrastructure")


def test_confidence_tiers(spark):
    def tier(p=0.93, damping=8.0, win=1.0, shape="linear", e=35.0, area=52.0, rejected=False, match=None, kind="unknown"):
        return tuple(one(spark, g=physics.confidence(*map(F.lit, (p, damping, win, shape, e, area, rejected)), F.lit(match).cast("double"), F.lit(kind))).g)

    assert tier()[0] == "probable" and tier(match=0.92)[0] == "confirmed" and tier(match=0.11)[0] == "probable" and tier(rejected=True) == ("insufficient", 0.0)
    assert tier(p=0.6, damping=3.0, win=0.3)[0] == "probable" or tier(p=0.6, damping=3.0, win=0.3)[1] < tier()[1]
    assert tier(p=0.6, damping=3.0, win=0.3, shape="blob", kind="natural_seep")[0] in ("probable", "insufficient")


def make_track(spark, course=90.0, n=12, step_min=20, knots=12.0, gap_after=None, lon=76.1, lat=9.31):
    rows, minute = [], 0
    for i in range(n):
        km = knots * 1.852 * step_min / 60 * (i - n // 2)
        rows.append(("v", i, datetime(2025, 5, 25, 2 + (minute - n // 2 * step_min) // 60, (minute - n // 2 * step_min) % 60), lon + km * math.sin(math.radians(course)) / (111.32 * math.cos(math.radians(lat))), lat + km * math.cos(math.radians(course)) / 110.574))
        minute += step_min + (180 if i == gap_after else 0)
    return spark.createDataFrame(rows, "mmsi string, event_id long, ts timestamp_ntz, lon double, lat double").withColumns({"cog": F.lit(None).cast("double"), "sog": F.lit(knots), "name": F.lit(None).cast("string"), "vessel_type": F.lit(None).cast("string")})


def test_track_course_voyage_and_gaps(spark):
    t = make_track(spark)
    assert tracks.mean_courses(t).first().course == pytest.approx(90, abs=1)
    v = tracks.voyages(t).first()
    assert v.knots == pytest.approx(12, abs=0.6) and v.hours == pytest.approx(11 / 3)
    assert tracks.gaps(t).count() == 0
    g = tracks.gaps(make_track(spark, gap_after=3)).collect()
    assert len(g) == 1 and g[0].minutes == 200 and g[0].knots < 60
    assert tracks.segments(make_track(spark, gap_after=3)).agg(F.sum("fixes")).first()[0] == 12
    assert tracks.gaps(t.limit(0)).count() == 0 and tracks.voyages(t.limit(0)).count() == 0


def test_scores(spark):
    x = lambda v: F.lit(v).cast("double")
    r = one(
        spark, with_axis=physics.parity_score(x(90), x(90)), back=physics.parity_score(x(270), x(90)), across=physics.parity_score(x(0), x(90)), no_course=physics.parity_score(x(None), x(90)), near=physics.proximity_score(x(0), x(8)),
        far=physics.proximity_score(x(200), x(8)), before=physics.temporality_score(x(-3)), after=physics.temporality_score(x(3)), never=physics.temporality_score(x(None)), out=physics.disqualified(x(0), x(1)), late=physics.disqualified(x(0.5), x(0.01)), kept=physics.disqualified(x(0.5), x(0.5)),
    )
    assert r.with_axis == r.back == 1 and r.across == 0 and r.no_course == 0 and r.near == 1 and r.far == 0 and r.after < r.before / 2 and r.never == 0
    assert r.out and r.late and r.kept is None


@pytest.mark.parametrize(
    ("case", "reason"),
    [
        (dict(), None), (dict(rejected=True), "not classified"), (dict(win=0.0), "wind"), (dict(kind="natural_seep"), "natural seep"), (dict(origin=False), "no drift origin"), (dict(unc=120.0), "uncertain"),
        (dict(vessels=0, top=None, second=None), "no AIS"), (dict(top=0.2, second=None, vessels=1), "below threshold"), (dict(top=0.82, second=0.79), "too close"),
    ],
)
def test_abstention(spark, case, reason):
    f = dict(rejected=False, win=1.0, kind="vessel", origin=True, unc=8.0, vessels=2, top=0.91, second=0.42) | case
    args = [F.lit(f[k]) for k in ("rejected", "win", "kind", "origin", "unc", "vessels")] + [F.lit(f[k]).cast("double") for k in ("top", "second")]
    got = one(spark, r=physics.abstain_reason(*args)).r
    assert (got is None) == (reason is None) and (reason is None or reason in got)


def test_corroboration_cases(spark):
    slick = spark.createDataFrame([(1, 76.3, 9.4, datetime(2025, 5, 27))], "candidate_id long, lon double, lat double, observed timestamp_ntz")
    rows = [(1, 76.3, 9.41, datetime(2025, 5, 25), False, 0.0), (2, 76.3, 9.41, datetime(2024, 5, 25), False, 0.0), (3, 120.0, 9.4, datetime(2025, 5, 25), False, 0.0), (4, 76.3, 9.41, None, False, 0.0), (5, 76.9, 9.9, datetime(2000, 1, 1), True, 0.0)]
    incidents = spark.createDataFrame(rows, "incident_id long, lon double, lat double, occurred timestamp_ntz, persistent boolean, duration_days double")
    got = {r.incident_id: r for r in joins.corroborate(slick, incidents).collect()}
    assert sorted(got) == [1, 4, 5] and got[1].confidence > got[4].confidence and got[1].days == 2
    assert [r.incident_id for r in joins.top_matches(joins.corroborate(slick, incidents), 1).collect()] == [1]
    assert one(spark, r=physics.corroboration_radius_km(F.lit(20.0))).r == 250 and one(spark, r=physics.corroboration_radius_km(F.lit(-1.0))).r == 30


def test_asof_takes_the_earlier_of_two(spark):
    left = spark.createDataFrame([(1, "a", datetime(2024, 1, 1, 5, 30)), (2, "b", datetime(2024, 1, 1, 5))], "id long, k string, t timestamp_ntz")
    right = spark.createDataFrame([("a", datetime(2024, 1, 1, 5), 1.0), ("a", datetime(2024, 1, 1, 6), 2.0), ("b", datetime(2024, 1, 2), 3.0)], "k string, u timestamp_ntz, v double")
    assert [(r.id, r.v) for r in joins.asof_nearest(left, right, "k", "t", "u", ["v"], "id").collect()] == [(1, 1.0)]


def test_bilinear_midpoint_and_outside(spark):
    grid = spark.createDataFrame([(i, j, float(i), float(j)) for i in (0, 1) for j in (0, 1)], "i long, j long, u double, v double")
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.0, 1.0), (3, 1.5, 0.5)], "id long, lon double, lat double")
    assert {r.id: (r.u, r.v) for r in joins.bilinear(points, grid, 0.0, 0.0, 1.0).collect()} == {1: (0.5, 0.5), 2: (1.0, 1.0)}


def test_uniform_current_moves_21_6_km(spark):
    u, v = drift.toward(0.5, 90.0)
    p = spark.createDataFrame([(1, 76.3, 9.31, 0.0)], "candidate_id long, lon double, lat double, hours double")
    r = drift.advect(p, 12, 1800, u0=u, v0=v).withColumn("km", geo.haversine_km(F.lit(76.3), F.lit(9.31), F.col("lon"), F.col("lat"))).first()
    assert r.km == pytest.approx(21.6, abs=0.5) and r.hours == 12
    w = drift.leeway(10.0, 270.0)
    assert w[0] == pytest.approx(0.3) and drift.leeway(10.0, 270.0, blown_from=False)[0] == pytest.approx(-0.3)


def test_forward_undoes_backward(spark):
    p = spark.createDataFrame([(1, 76.3, 9.31, 0.0)], "candidate_id long, lon double, lat double, hours double")
    back = drift.advect(drift.advect(p, 6, -1800, eddy=True), 6, 1800, eddy=True).first()
    assert (back.lon, back.lat) == (pytest.approx(76.3, abs=1e-5), pytest.approx(9.31, abs=1e-5))


def test_uncertainty_grows_and_grid_parks(spark):
    seeded = drift.seed(spark.createDataFrame([(1, 76.3, 9.31)], "candidate_id long, lon double, lat double"), 60, 2.0)
    at = seeded.withColumn("hours", F.lit(0.0))
    a, b = (drift.backtrack(at, h, 1800, u0=0.1, v0=0.1).first() for h in (3, 12))
    assert a.uncertainty_km < b.uncertainty_km and a.spread_km <= 2.01 and a.reliable
    grid = spark.createDataFrame([(i, j, 0.5, 0.0) for i in range(3) for j in range(3)], "i long, j long, u double, v double")
    particles = spark.createDataFrame([(1, 0, 76.05, 9.1), (1, 1, 76.19, 9.1)], "candidate_id long, pid int, lon double, lat double")
    out = {r.pid: r for r in drift.advect_grid(particles, grid, 76.0, 9.0, 0.1, 2.0, 1800).collect()}
    assert not out[0].parked and out[1].parked and out[0].lon > 76.05
    assert drift.hulls(spark.createDataFrame([(1, float(x), float(y)) for x in (0, 1) for y in (0, 1)] + [(1, 0.5, 0.5)], "candidate_id long, lon double, lat double")).first().wkt.count(",") == 4


def band(label, lat, orient=90.0, elong=8.0, area=10.0):
    return (1, label, 72.0, lat, orient, elong, area)


@pytest.mark.parametrize(
    ("lats", "orients", "members"),
    [([15.0, 15.05, 15.1, 15.15, 15.2], [90.0] * 5, 5), ([15.0, 15.05], [90.0] * 2, 0), ([15.0, 15.05, 15.5, 16.4], [90.0] * 4, 0), ([15.0, 15.05, 15.1, 15.15, 15.2], [0.0, 90.0, 0.0, 90.0, 0.0], 0)],
)
def test_wave_trains(spark, lats, orients, members):
    regions = spark.createDataFrame([band(i, a, o) for i, (a, o) in enumerate(zip(lats, orients, strict=True))], "scene_id long, candidate_id long, lon double, lat double, axis_deg double, elongation double, area_km2 double")
    got = wavetrain.wave_trains(regions).collect()
    assert len(got) == members and all(r.cv < 0.2 for r in got)


def brute_windows(grid, k, f):
    padded = np.pad(grid, k // 2, mode="symmetric")
    return np.array([[f(padded[i : i + k, j : j + k]) for j in range(grid.shape[1])] for i in range(grid.shape[0])])


def test_raster_kernels_against_numpy(spark):
    rng = np.random.default_rng(0)
    grid = rng.normal(-17, 2, (16, 16))
    px = spark.createDataFrame([(0, i, j, float(grid[i, j])) for i in range(16) for j in range(16)], "tile long, r long, c long, db double")

    def array(df, col):
        out = np.zeros((16, 16))
        for r in df.collect():
            out[r.r, r.c] = r[col]
        return out

    stats = raster.local_statistics(px, "db", 5, (16, 16), ("tile",))
    assert array(stats, "mean") == pytest.approx(brute_windows(grid, 5, np.mean)) and array(stats, "variance") == pytest.approx(brute_windows(grid, 5, np.var))
    assert array(raster.sliding(px, "db", 3, (16, 16), F.max, ("tile",)), "db_k") == pytest.approx(brute_windows(grid, 3, np.max))
    smooth = array(raster.per_tile(px, raster.refined_lee, 16), "db")
    assert smooth.std() < 0.8 * grid.std()
    dark = grid.copy()
    dark[6:9, 2:14] -= 12
    assert raster.dark_patch(dark)[7, 4:12].min() > raster.dark_patch(dark)[0:3].max()
    assert raster.block_mean(px, 5, ("tile",)).count() == 9


def test_components_against_flood_fill(spark):
    rng = np.random.default_rng(3)
    mask = rng.random((20, 20)) < 0.35
    cells = {(int(i), int(j)) for i, j in zip(*np.nonzero(mask), strict=True)}
    want = {}
    for start in sorted(cells):
        if start in want:
            continue
        todo = [start]
        while todo:
            p = todo.pop()
            if p in want or p not in cells:
                continue
            want[p] = start[0] * (1 << 32) + start[1]
            todo += [(p[0] + a, p[1] + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    got = raster.components(spark.createDataFrame(sorted(cells), "r long, c long"))
    assert {(r.r, r.c): r.label for r in got.collect()} == want


def test_regions_and_calibration(spark):
    px = spark.createDataFrame([(1, i, j, -25.0) for i in range(4) for j in range(40)], "label long, r long, c long, db double")
    r = raster.regions(px, 0.08).first()
    assert r.pixels == 160 and r.elongation > 8 and r.bearing == 90.0
    v = spark.createDataFrame([(0.5,), (2.0,), (0.0,)], "v double")
    assert [round(x.db, 2) for x in raster.calibrate(v, "already_sigma0").collect()] == [-3.01, 3.01, -99.0]
    assert raster.calibration_mode(spark.createDataFrame([(-20.0,), (-15.0,)], "v double")).first()["mode"] == "already_db"


def test_evaluation(spark):
    p = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1)], "t long, g long")
    assert {r["class"]: r.iou for r in evaluation.iou(p, "t", "g", 3).collect()} == {0: 0.5, 1: pytest.approx(2 / 3), 2: None}
    worse, better = (evaluation.dice_focal(spark.createDataFrame([(x, 1), (1 - x, 0)], "p double, t int"), "p", "t").first().loss for x in (0.6, 0.9))
    assert better < worse


@pytest.mark.parametrize(("commodity", "name", "oil"), [("crude oil", "", True), ("Diesel", None, True), ("palm oil", "ship", False), ("container", "fuel barge", False), (None, "sheen report", True), ("unknown", "x", False)])
def test_petroleum(spark, commodity, name, oil):
    assert one(spark, p=text.is_petroleum(F.lit(commodity).cast("string"), F.lit(name).cast("string"))).p == oil


def test_text_fields(spark):
    s = lambda v: F.lit(v).cast("string")
    r = one(
        spark, a=text.to_timestamp(s("2025-05-25T02:00:00Z")), b=text.to_timestamp(s("25/05/2025 02:00:00")), bad=text.to_timestamp(s("x")), day=text.to_date(s("2025-05-25 13:00")), n=text.to_number(s(" 1,234.5 ")), inf=text.to_number(s("Infinity")),
        sog=text.plain_number(s("12.5")), no=text.plain_number(s("1e5")), first=text.first_non_blank(s(" "), s(None), s("x")), at=text.scene_time(s("20210304_x")), month=text.scene_time(s("2021-03")),
        prefix=text.product_prefix(s("S1A_IW_GRDH_1SDV_20230620T000209_20230620T000234_049062_05E65E_5ADB")), url=text.day_url("https://x/y/", F.lit("2024-02-03").cast("date")),
    )
    assert r.a == r.b == datetime(2025, 5, 25, 2) and r.bad is None and r.day == datetime(2025, 5, 25) and r.n == 1234.5 and r.inf is None and r.sog == 12.5 and r.no is None and r.first == "x"
    assert r.at == datetime(2021, 3, 4, 12) and r.month == datetime(2021, 3, 1, 12) and r.prefix.startswith("GRD/2023/6/20/IW/DV/S1A") and r.url == "https://x/y/aisdk-2024-02-03.zip"


def test_sources(spark, tmp_path):
    for root, vv in (("a", "one.tif"), ("b", "two.tif")):
        (tmp_path / root).mkdir()
        (tmp_path / root / "s.json").write_text(json.dumps({"scene_id": "S", "acquired_at": "2023-06-20T00:02:09Z", "bbox": [72, 15, 73, 16], "vv_path": vv}))
    (tmp_path / "b" / "bad.json").write_text("{")
    (tmp_path / "b" / "part.json").write_text('{"scene_id": "T"}')
    found = readers.scenes(readers.scene_manifests(spark, [str(tmp_path / "a"), str(tmp_path / "b")])).collect()
    assert [(r.scene_id, r.vv_path, r.orbit_direction, r.is_dual_pol, r.centre_lon) for r in found] == [("S", "two.tif", "DESCENDING", False, 72.5)]
    (tmp_path / "ais.csv").write_text("MMSI,LAT,LON,BaseDateTime,SOG,VesselName\n1,9.1,76.1,2025-05-25T02:00:00,12.5,A\n1,91,181,2025-05-25T02:00:00,1,A\n2,9.2,76.2,bad,1,B\n,9,76,2025-05-25T02:00:00,1,C\n3,9.3,79,2025-05-25T02:00:00,,\n")
    assert sorted(r.mmsi for r in readers.ais_csv(spark, str(tmp_path / "ais.csv")).collect()) == ["1", "3"]
    assert [r.mmsi for r in readers.ais_csv(spark, str(tmp_path / "ais.csv"), box=(76.0, 9.0, 77.0, 10.0), start="2025-05-25 00:00:00").collect()] == ["1"]
    (tmp_path / "no.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="mmsi"):
        readers.ais_csv(spark, str(tmp_path / "no.csv"))
    (tmp_path / "noaa.csv").write_text("﻿id,name,lon,lat,open_date,commodity,location,max_ptl_release_gallons,threat,description\n7,Spill,190.0,10,2020-01-02T05:00:00Z,crude oil,x,\"1,000\",Oil,d\n8,Nuts,10,10,2020-01-02,palm oil,x,,,\n")
    r = readers.incident_csv(spark, str(tmp_path / "noaa.csv")).collect()
    assert len(r) == 1 and r[0].lon == -170 and r[0].occurred == datetime(2020, 1, 2) and r[0].gallons == 1000
    (tmp_path / "wind.json").write_text(json.dumps({"latitude": 9.5, "longitude": 76.0, "hourly": {"time": ["2025-05-28T00:00", "2025-05-28T01:00"], "wind_speed_10m": [5.0, None], "wind_direction_10m": [270, 280]}}))
    assert [(w.ts, w.speed) for w in readers.hourly_wind(spark, str(tmp_path / "wind.json")).collect()] == [(datetime(2025, 5, 28), 5.0)]
    (tmp_path / "lut.xml").write_text('<a><sigmaNought count="3">1.0 2.5\n3.0</sigmaNought><sigmaNought count="1">4</sigmaNought></a>')
    assert sorted(x.value for x in readers.calibration_lut(spark, str(tmp_path / "lut.xml")).collect()) == [1.0, 2.5, 3.0, 4.0]
    assert readers.daily_files("2024-01-01T03:00:00") == ["2023-12-31", "2024-01-01"]


def test_paged_source_and_gap_events(spark):
    spark.dataSource.register(readers.PagedSource)
    read = spark.read.format("tidewatch.paged").option("schema", "k long, name string").option("fetch", "tidewatch.sources.fixtures:pages").option("most", "5").load()
    assert [r.k for r in read.collect()] == [0, 1, 2, 3, 4]
    pages = spark.createDataFrame([("1", "A", "2025-05-25T00:00:00Z", "2025-05-25T05:00:00Z", 76.0, 9.0, [76.0, 8.0, 77.0, 9.0])], "mmsi string, name string, start string, end string, lon double, lat double, box array<double>")
    g = readers.gap_events(pages).first()
    assert (g.resume_lon, g.resume_lat) == (77.0, 8.0) and readers.gap_events(pages, (0.0, 0.0, 1.0, 1.0)).count() == 0


def test_sinks_and_config(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([("s1", 1.0), ("s2", float("nan"))], "scene_id string, x double")
    path = str(tmp_path / "out")
    sinks.write_by_scene(df.where("scene_id = 's1'"), path, skip_existing=True)
    sinks.write_by_scene(df, path, skip_existing=True)
    assert spark.read.parquet(path).count() == 2
    sinks.replace_scene(df.where("scene_id = 's1'").withColumn("x", F.lit(9.0)), path)
    assert sorted(r.x for r in spark.read.parquet(path).where("NOT isnan(x)").collect()) == [9.0]
    assert sinks.json_safe(df).where("x IS NULL").count() == 1
    ring = F.array(*(F.struct(F.lit(float(a)).alias("lon"), F.lit(float(b)).alias("lat")) for a, b in ((0, 0), (1, 0), (1, 1), (0, 0))))
    made = one(spark, polygon=sinks.feature(F.lit(1.0), F.lit(2.0), ring, F.struct(F.lit(1).alias("a"))), point=sinks.feature(F.lit(1.0), F.lit(2.0), None, F.struct(F.lit(1).alias("a"))))
    assert json.loads(made.polygon)["geometry"]["type"] == "Polygon" and json.loads(made.point)["geometry"]["coordinates"] == [1.0, 2.0]
    assert sinks.cache_key("1", "s", {"a": 1, "b": 2}) == sinks.cache_key("1", "s", {"b": 2, "a": 1}) != sinks.cache_key("2", "s", {})
    monkeypatch.setenv("WHERE", "x")
    made = config.interpolated(config.merged({"a": {"b": 1, "c": "${WHERE}/${NONE:-y}"}}, {"a": {"b": 2}}))
    assert made == {"a": {"b": 2, "c": "x/y"}} and config.get(made, "a.b") == 2 and config.get(made, "a.z.q", 5) == 5


def test_polygon_round_trip(spark):
    ring = F.array(*(F.struct(F.lit(float(a)).alias("lon"), F.lit(float(b)).alias("lat")) for a, b in ((0, 0), (2, 0), (2, 2), (0, 2), (0, 0))))
    r = one(spark, wkt=text.wkt_polygon(ring), inside=text.point_in_ring(F.lit(1.0), F.lit(1.5), ring), outside=text.point_in_ring(F.lit(3.0), F.lit(1.0), ring), back=text.parse_wkt(text.wkt_polygon(ring)), none=text.parse_wkt(F.lit("POLYGON EMPTY")))
    assert r.inside and not r.outside and len(r.back) == 5 and r.back[1].lon == 2.0 and r.none is None and r.wkt.startswith("POLYGON ((0.000000 0.000000")


def test_known_frames_have_no_nan(spark):
    world = world_incidents.world_incidents(spark)
    assert world.count() == world.select("incident_id").distinct().count() == 54 and world.where("persistent").count() == 7
    assert not pd.isna(relations.ports(spark).toPandas()).any().any() and relations.ports(spark).count() == 22 and relations.known_sources(spark).count() == 4
