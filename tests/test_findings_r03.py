"""What a reviewer found in round 3, each on the smallest table that shows it."""

from datetime import datetime

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions

from tidewatch.plans import catalog


def same_as_sql(spark, folder, name, **tables):
    """The query's rows over these tables are those of its SQL."""
    con = duckdb.connect()
    for table, rows in tables.items():
        pq.write_table(rows, f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    found = con.execute(catalog.oracles()[name])
    columns = [c[0] for c in found.description]
    want = sorted(map(str, found.fetchall()))
    got = sorted(str(tuple(r)) for r in catalog.queries()[name](spark, str(folder)).select(*columns).collect())
    assert want and got == want
    return got


def test_f24_milliseconds_are_rounded(spark, tmp_path):
    at = [datetime(2024, 1, 30, 22, 48, 53, us) for us in (999_499, 999_500, 999_812)]
    events = pa.table({"event_id": [1, 2, 3], "ts": pa.array(at, pa.timestamp("us")), "user_id": [1, 2, 3], "event_type": ["a"] * 3, "value": [1.0] * 3, "props": ["{}"] * 3})
    got = same_as_sql(spark, tmp_path, "w12_w13_latest_fixes", events=events)
    assert got == ["(1, '1706654933')", "(2, '1706654934')", "(3, '1706654934')"]


def test_f23_a_mosaic_with_a_ragged_edge(spark, tmp_path):
    noise = np.random.default_rng(5).normal(0, 0.125, (56, 64)).astype(np.float32)  # two rows of 25 tiles and six more
    vectors = pa.table({"vec_id": np.arange(56), "embedding": pa.array(noise.tolist(), pa.list_(pa.float32())), "label": pa.array([1] * 56, pa.int32())})
    same_as_sql(spark, tmp_path, "r05_radiometric_land", embeddings=vectors)


def test_f6_matches_of_slicks_at_one_place_and_of_incidents_alike(spark):
    from tidewatch.operators import joins

    seen, day = datetime(2024, 1, 10), datetime(2024, 1, 8)
    slick = spark.createDataFrame([(i, 76.0 + i % 3 / 10, 9.5, seen) for i in range(30)] + [(30, None, 9.5, seen)], "candidate_id long, lon double, lat double, observed timestamp_ntz")
    rows = [(i, 76.05 + i % 2 / 50, 9.52, None if i % 5 == 0 else day, None if i % 7 == 0 else i % 7 == 1, float(i % 2), i % 11 == 0) for i in range(60)]
    incident = spark.createDataFrame(rows, "incident_id long, lon double, lat double, occurred timestamp_ntz, persistent boolean, duration_days double, natural_seep boolean")
    whole = lambda df: sorted(map(str, df.collect()))
    top = joins.top_corroborated(slick, incident, 3)
    want = joins.top_matches(joins.corroborate(slick, incident), 3)
    assert len(whole(top)) == 90 and whole(top) == whole(want.select(*top.columns))
    met = joins._met(joins.cells.place_targets(incident, joins._steady_radius(30.0), 5, 8).selectExpr("*", "0 AS __slot"), joins.cells.place_points(slick.limit(1), joins.cells.levels(5, 8)).selectExpr("*", "0 AS __slot"))
    assert 0 < met.count() < 9 * 60  # targets in cells without a slick aren't shuffled


def test_f15_f17_f18_origins_alike_are_sought_once(spark, tmp_path):
    from tidewatch.plans import vessels

    events = pq.read_table("/root/testdata/sf0.001/events.parquet")
    keys = [k + 126_000 * n for k in range(40) for n in range(3)]  # the relations' places, times and axes repeat after so many keys
    orders = pa.table({"o_orderkey": keys, "o_custkey": [k % 7 for k in keys]})
    for name in ("j05_closest_approach", "j06_j07_dark_events", "w08_ranked_vessels", "w09_margins", "o03_most_suspicious"):
        same_as_sql(spark, tmp_path, name, events=events, orders=orders)
    places, to_all = vessels.placed_once(vessels.origins(spark, str(tmp_path)))
    assert places.count() == 40 and to_all(places).count() == 120


def test_f22_axes_that_cancel_to_within_the_sql_s_bound(spark):
    from tidewatch.operators import tracks

    axes = spark.createDataFrame([(0.0,), (90.00001,)], "a double")  # the sums are 6e-14 and 3.5e-7
    assert axes.agg(tracks.circular_mean(functions.col("a"), 180.0, 1e-6)).first()[0] is None and axes.agg(tracks.circular_mean(functions.col("a"), 180.0)).first()[0] is not None


def test_f25_f26_f27_scenes_share_a_batch_and_span_batches(spark):
    import random

    from test_wave_trains import REGION, greedy
    from tidewatch.operators import wavetrain

    rng = random.Random(7)
    rows = [(s or None, 1000 * s + k, 76 + rng.random() * 0.02, 9 + 0.05 * k + rng.choice([0, 0, 0.02]), float(rng.choice([88, 90, 95, 10])), 5.0, rng.choice([4.0, 6.0, 10.0])) for s in range(30) for k in range(rng.choice([2, 5, 40]))]
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = wavetrain.wave_trains(spark.createDataFrame(rows, REGION))
        assert "FlatMapGroups" not in found._jdf.queryExecution().toString()  # no call of Python for each scene
        got = found.collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    trains = {}
    for r in got:
        trains.setdefault((r["scene_id"], r["train"]), set()).add(r["candidate_id"])
    want = {(s, k, m) for s in {r[0] for r in rows} for k, (m, *_) in enumerate(greedy([r for r in rows if r[0] == s]))}
    assert {(*k, frozenset(m)) for k, m in trains.items()} == want and len(want) > 10 and any(s is None for s, *_ in want)


def test_f7_places_and_outlines_alike_meet_once(spark, tmp_path, monkeypatch):
    from tidewatch.operators import areas

    met = []
    once = areas.areas_at
    monkeypatch.setattr(areas, "areas_at", lambda points, index, *a: met.append((points.count(), index.select("area_id").distinct().count())) or once(points, index, *a))
    orders = pa.table({"o_orderkey": [k + 7000 * n for k in range(300) for n in range(3)], "o_custkey": [1] * 900})  # places repeat after 7,000 keys
    supplier = pa.table({"s_suppkey": [k + 39_000 * n for k in range(1, 40) for n in range(2)]})  # outlines after 39,000
    got = same_as_sql(spark, tmp_path, "j14_g01_areas_of_slicks", orders=orders, supplier=supplier)
    assert met == [(300, 39)] and len(got) > 6000


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_f21_f31_labels_and_pixels_are_never_broadcast(spark):
    from tidewatch.operators import raster, regions

    scene = spark.range(64 * 60).selectExpr("id DIV 60 AS r", "id % 60 AS c", "IF(id % 60 < 9, -20e0, -10e0) AS db", "IF(id % 60 < 9, 1e0, 0e0) AS p", "false AS land")
    assert "BroadcastHashJoin" not in plan_of(raster.components(scene.where("p = 1").select("r", "c")))
    found = regions.extract(scene, 0.9, 0.08, 0.05)
    assert "BroadcastHashJoin" not in plan_of(found) and found.count() == 1


def test_f30_rings_are_masks_of_runs_of_columns(spark):
    from tidewatch.operators import regions

    rng = np.random.default_rng(3)
    db = np.round(rng.normal(-12, 2, (30, 110)), 3)
    parts = {1: {(14, c) for c in range(40, 60)} | {(r, 47) for r in range(3, 20)}, 2: {(20, 96), (21, 95), (29, 109)}}
    pixels = spark.createDataFrame([(r, c, float(db[r, c])) for r in range(30) for c in range(110) if (r * 7 + c) % 9], "r long, c long, db double")
    region = spark.createDataFrame([(k, r, c) for k, p in parts.items() for r, c in p], "label long, r long, c long")
    found = regions.surroundings(region, pixels, region)
    assert not [x for x in plan_of(found).splitlines() if "SortMergeJoin" in x and "c#" in x]  # no pixel of a ring goes by itself
    got = {r["label"]: r for r in found.collect()}
    power = lambda some: np.mean([10 ** (db[p] / 10) for p in some if (p[0] * 7 + p[1]) % 9])
    for k, p in parts.items():
        ring = {(r + a, c + b) for r, c in p for a in range(-8, 9) for b in range(-8, 9) if abs(a) + abs(b) <= 8 and 0 <= r + a < 30 and 0 <= c + b < 110} - parts[1] - parts[2]
        assert got[k]["clear_pixels"] == sum((r * 7 + c) % 9 > 0 for r, c in ring)
        assert abs(got[k]["surround_db"] - 10 * np.log10(power(ring))) < 1e-9 and abs(got[k]["damping_ratio"] - power(p) / power(ring)) < 1e-9


def test_f14_f28_f33_the_kernel_s_waves_and_spread_are_the_plain_ones():
    from tidewatch.operators import drift

    rng = np.random.default_rng(2)
    lon, lat, at = rng.uniform(-180, 180, 999), rng.uniform(-80, 80, 999), rng.uniform(0, 700, 999)
    u, v = drift.rotating_field(lon, lat, at)
    k = 2 * np.pi / 0.6
    assert np.allclose(u, 0.25 + 0.18 * np.sin(k * lat) + 0.12 * np.cos(2 * np.pi / 12.42 * at), rtol=0, atol=1e-12) and np.allclose(v, -0.10 - 0.18 * np.sin(k * lon), rtol=0, atol=1e-12)
    for n in (1, 2, 3, 50, 300):
        x, y = 76 + rng.random(n) / 9, 9 + rng.random(n) / 9
        a, b = x.mean(), y.mean()
        h = np.sin(np.radians(y - b) / 2) ** 2 + np.cos(np.radians(b)) * np.cos(np.radians(y)) * np.sin(np.radians(x - a) / 2) ** 2
        assert np.allclose(drift.spread_of(x, y), (a, b, np.percentile(2 * 6371.0088 * np.arcsin(np.sqrt(h)), 68)), rtol=1e-12, atol=0)


def test_f20_candidates_are_shuffled_and_seeded_where_they_arrive(spark, tmp_path):
    orders = pa.table({"o_orderkey": list(range(0, 90_000, 1500)), "o_custkey": [1] * 60})
    same_as_sql(spark, tmp_path, "s19_d04_gridded_drift", orders=orders)
    plan = plan_of(catalog.queries()["s19_d04_gridded_drift"](spark, str(tmp_path)))
    assert "FlatMapCoGroups" not in plan and plan.index("Generate explode") < plan.index("Exchange")


def test_f2_matches_are_sought_outward(spark, monkeypatch):
    from tidewatch.operators import joins

    rng = np.random.default_rng(8)
    slick = spark.createDataFrame([(i, 76 + float(rng.random()), 9 + float(rng.random()), datetime(2024, 1, 10, i % 24)) for i in range(25)] + [(25, 79.9, 12.5, datetime(2024, 1, 10)), (26, 120.0, 12.0, datetime(2024, 1, 10))], "candidate_id long, lon double, lat double, observed timestamp_ntz")
    rows = [(i, 75.5 + 2 * float(rng.random()), 8.5 + 2 * float(rng.random()), None if i % 13 == 0 else datetime(2024, 1, 1 + i % 20), i % 29 == 0, 30.0 * (i % 11 == 0), i % 31 == 0) for i in range(3000)]
    incident = spark.createDataFrame(rows, "incident_id long, lon double, lat double, occurred timestamp_ntz, persistent boolean, duration_days double, natural_seep boolean")
    whole = lambda df: sorted(map(str, df.collect()))
    pairs, corroborate = [], joins.corroborate
    every = corroborate(slick, incident)
    want = joins.top_matches(every, 3)
    monkeypatch.setattr(joins, "corroborate", lambda *a: pairs.append(corroborate(*a)) or pairs[-1])
    top = joins.top_corroborated(slick, incident, 3)
    assert whole(top) == whole(want.select(*top.columns)) and top.count() > 70
    assert sum(p.count() for p in pairs) < every.count() / 5  # few of them are met


def test_f32_chunks_are_dealt_to_given_tasks(spark, tmp_path):
    orders = pa.table({"o_orderkey": list(range(0, 90_000, 700)), "o_custkey": [1] * 129})
    same_as_sql(spark, tmp_path, "d04_s23_currents_in_time", orders=orders)
    from tidewatch.operators import gridded

    rows, cogrouped = [], gridded.written
    gridded.written = lambda df, name: rows.append(plan_of(df)) or cogrouped(df, name)
    try:
        catalog.queries()["d04_s23_currents_in_time"](spark, str(tmp_path))
    finally:
        gridded.written = cogrouped
    moves = [p for p in rows if "FlatMapCoGroups" in p]
    assert moves and all(p.count("REPARTITION_BY_NUM") == 2 for p in moves)


def test_f34_a_point_meets_its_cell_as_one_row(spark, tmp_path):
    orders = pa.table({"o_orderkey": list(range(0, 90_000, 70)), "o_custkey": [1] * 1286})
    same_as_sql(spark, tmp_path, "j11_s19_field_in_time", orders=orders)
    plan = plan_of(catalog.queries()["j11_s19_field_in_time"](spark, str(tmp_path)))
    assert "Aggregate" not in plan and "hashpartitioning" not in plan  # no point is shuffled or summed up


def test_f29_the_slick_is_found_once(spark, monkeypatch):
    from tidewatch.plans import screening

    given, decided = [], screening.decided
    monkeypatch.setattr(screening, "decided", lambda spark, d, one: given.append(one) or decided(spark, d, one))
    catalog.queries()["n05_j18_slick_detail"](spark, "/root/testdata/sf0.001")
    assert given[0].count() == 1 and "MapInArrow" not in plan_of(given[0])  # no wave train is sought again for each use of it


def test_f9_windows_alike_are_measured_once_and_no_pixel_is_shuffled_for_an_object(spark, tmp_path, monkeypatch):
    from tidewatch.operators import objects

    measured, by_task = [], objects._measured_by_task
    monkeypatch.setattr(objects, "_measured_by_task", lambda windows, *a: measured.append(windows.count()) or by_task(windows, *a))
    monkeypatch.setattr(objects, "WORK", 20_000)  # several tasks a cell
    embeddings = pq.read_table("/root/testdata/sf0.001/embeddings.parquet")
    supplier = pa.table({"s_suppkey": [k + 25_200 * n for k in range(1, 60) for n in range(3)]})  # boxes repeat after 25,200 keys
    got = same_as_sql(spark, tmp_path, "s52_m20_object_features", embeddings=embeddings, supplier=supplier)
    assert 20 < measured[0] < 60 and len(got) > measured[0]
    assert "Window" not in plan_of(catalog.queries()["s52_m20_object_features"](spark, str(tmp_path)))  # no pixel meets an object by itself
    monkeypatch.setattr(objects, "CELL", 16)
    monkeypatch.setattr(objects, "MOST_CELL", 32)  # the others are summed up by Spark
    assert same_as_sql(spark, tmp_path, "s52_m20_object_features", embeddings=embeddings, supplier=supplier) == got and 0 < measured[-1] < measured[0]


def test_f19_origins_look_at_few_vessels_and_decide_as_if_at_all(spark, monkeypatch):
    from tidewatch.functions import physics
    from tidewatch.operators import ranking, tracks
    from tidewatch.plans import vessels

    rng = np.random.default_rng(19)
    at = lambda h: datetime.fromtimestamp(1704067200 + int(h * 3600) + 0.25)
    spots = [(76.0, 9.4), (179.97, 71.0), (30.0, -2.0)]  # many fixes, a few across the date line, one
    fixes = [(k, int(v), at(40 * rng.random()), x + 0.7 * (rng.random() - 0.5), y + 0.7 * (rng.random() - 0.5), float(rng.integers(360))) for k, (v, (x, y)) in enumerate([(v, spots[0]) for v in rng.integers(0, 4000, 9000)] + [(v, spots[1]) for v in rng.integers(0, 40, 60)] + [(9999, spots[2])])]
    fixes = [(e, v, t, (float(x) + 180) % 360 - 180, float(y), c) for e, v, t, x, y, c in fixes] + [(99_999, 5, at(20), None, None, 1.0)]
    pos = spark.createDataFrame(fixes, "event_id long, mmsi long, ts timestamp_ntz, lon double, lat double, cog double").withColumn("sog", functions.lit(1.0)).repartition(4)
    origin = [(k, float((x + 0.5 * (rng.random() - 0.5) + 180) % 360 - 180), float(y + 0.5 * (rng.random() - 0.5)), float(rng.choice([0.5, 11, 30, 58])), at(8 + 24 * rng.random()), None if k % 2 else float(rng.integers(180))) for k, (x, y) in enumerate([spots[0]] * 60 + [spots[1]] * 40 + [spots[2]] * 9)] + [(900, -120.0, 0.0, 11.0, at(20), 3.0)]
    origins = spark.createDataFrame(origin, "candidate_id long, lon double, lat double, unc_km double, release timestamp_ntz, axis_deg double")
    monkeypatch.setattr(vessels, "relation", lambda *_: pos)
    place = lambda n, c: functions.max(functions.when(functions.col("place") == n, functions.col(c)))
    every = vessels.ranked_vessels(spark, "", origins).groupBy("candidate_id").agg(functions.count("*").alias("n"), place(1, "score").alias("top"), place(2, "score").alias("second"), place(1, "mmsi").alias("suspect"))
    reason = physics.abstain_reason(functions.lit(False), functions.lit(1.0), functions.lit("vessel"), functions.lit(True), functions.lit(1.0), *map(functions.col, ("n", "top", "second")))
    said = lambda df: {r["candidate_id"]: (r["reason"], None if r["reason"] else r["suspect"]) for r in df.withColumn("reason", reason).collect()}
    monkeypatch.setattr(ranking, "ORIGINS", 7)  # a cell's origins go to several tasks
    want, found = said(every), ranking.two_best(origins, pos, tracks.gaps(pos), tracks.mean_courses(pos))
    assert said(found) == want and len(want) > 90 and {r for r, _ in want.values()} >= {None, "top two candidates too close"} and 900 not in want
    crowd = lambda df: df.where("candidate_id < 60").agg(functions.sum("n")).first()[0]
    assert crowd(found) < crowd(every) / 2  # met by a few circles
    whole, seen = ({r["candidate_id"]: r for r in df.collect()} for df in (every, found))
    same = [k for k, r in seen.items() if r["n"] == whole[k]["n"]]  # where all were looked at, scores are those of all
    assert len(same) > 30 and all(seen[k]["suspect"] == whole[k]["suspect"] and np.allclose([seen[k]["top"], seen[k]["second"] or 0], [whole[k]["top"], whole[k]["second"] or 0], rtol=0, atol=1e-9) for k in same)
