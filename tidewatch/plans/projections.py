"""Queries of what is handed out: listings, candidates, evidence, tracks, frames, fields in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.functions import physics, text
from tidewatch.functions.geo import bearing_deg, haversine_km, round_to
from tidewatch.operators import around, drift, joins, tracks
from tidewatch.plans import sql
from tidewatch.plans.drifting import DT, _shaped
from tidewatch.plans.registry import query
from tidewatch.plans.screening import _SHAPED, judged, shaped
from tidewatch.plans.vessels import _DARK_KM, _r, incidents, origins, placed_once, slicks
from tidewatch.sources import fields
from tidewatch.sources.relations import relation

_LISTED = f"{sql.judged()}, ais AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM pos)"


@query(sql.with_relations("slick", "pos", then=_LISTED) + f"""
SELECT scene_id, min(observed) AS acquired_at, {sql.r('min(lon)')} AS west, {sql.r('min(lat)')} AS south, {sql.r('max(lon)')} AS east, {sql.r('max(lat)')} AS north,
bool_or(NOT rejected) AS analysed, bool_or(day IS NOT NULL) AS has_ais FROM judged LEFT JOIN ais ON CAST(observed AS DATE) = day GROUP BY scene_id""")
def f21_scene_list(spark: SparkSession, d: str) -> DataFrame:
    """Every scene with its time and box, whether anything in it was confirmed, and whether positions of its days are there."""
    days = relation(spark, d, "pos").select(F.to_date("ts").alias("day")).distinct().withColumn("there", F.lit(True))
    seen = judged(slicks(spark, d)).withColumn("day", F.to_date("observed")).join(days, "day", "left")
    corner = [_r(n, f(x)) for n, f, x in (("west", F.min, "lon"), ("south", F.min, "lat"), ("east", F.max, "lon"), ("north", F.max, "lat"))]
    return seen.groupBy("scene_id").agg(F.min("observed").alias("acquired_at"), *corner, F.bool_or(~F.col("rejected")).alias("analysed"), F.bool_or(F.coalesce("there", F.lit(False))).alias("has_ais"))


@query(sql.with_relations("slick", "source", then=f"{sql.judged()}, {_SHAPED}") + f"""
SELECT scene_id || '-' || lpad(CAST(candidate_id % 1000 AS VARCHAR), 3, '0') AS name, candidate_id, {sql.r('area_km2', 4)} AS area_km2, {sql.r('elongation', 3)} AS elongation, {sql.r('compactness', 4)} AS compactness,
{sql.r('pow(10e0, -damping_db / 10)', 5)} AS damping_ratio, {sql.r('wind_ms', 3)} AS wind_ms, {sql.r(sql.window_score('wind_ms'), 3)} AS window_score, {sql.r('p_oil', 4)} AS p_oil, shape AS morphology,
{sql.r('vh_vv', 5)} AS vh_vv_ratio, gate AS rejected_reason FROM shaped""")
def f22_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Measured regions as candidates, rounded as they are handed on."""
    s = shaped(spark, d)
    number = F.lpad((F.col("candidate_id") % 1000).cast("string"), 3, "0")
    return s.select(
        F.concat_ws("-", F.col("scene_id").cast("string"), number).alias("name"), "candidate_id", _r("area_km2", digits=4), _r("elongation", digits=3), _r("compactness", digits=4), _r("damping_ratio", F.pow(F.lit(10.0), -F.col("damping_db") / 10.0), 5),
        _r("wind_ms", digits=3), _r("window_score", physics.wind_window_score(F.col("wind_ms")), 3), _r("p_oil", digits=4), F.col("shape").alias("morphology"), _r("vh_vv_ratio", F.col("vh_vv"), 5), F.col("gate").alias("rejected_reason"),
    )


_TERM_LIST = "[" + ", ".join(f"{{'v': abs({sql.contribution(t)}), 'k': '{t}'}}" for t in sql.TERMS) + "]"


@query(sql.with_relations("slick", then=sql.judged()) + f"""
SELECT candidate_id, array_to_string(list_transform(list_sort({_TERM_LIST}, 'DESC'), lambda x: x.k), ' ') AS strongest_first FROM judged""")
def o07_contributions(spark: SparkSession, d: str) -> DataFrame:
    """Evidence terms by weight, strongest first, the bias left out."""
    entries = F.transform(F.map_entries("contributions"), lambda e: F.struct(F.abs(e["value"]).alias("v"), e["key"].alias("k")))
    return judged(relation(spark, d, "slick")).select("candidate_id", F.array_join(F.transform(F.sort_array(entries, asc=False), lambda e: e["k"]), " ").alias("strongest_first"))


@query(sql.with_relations("slick") + f"""
SELECT candidate_id, CASE WHEN obs_hour % 100 - 20 <= 0 THEN 'not in the past' WHEN obs_hour % 100 - 20 > 72 THEN 'refused' WHEN obs_hour % 100 - 20 > 48 THEN 'unreliable' ELSE 'reliable' END AS forecast,
obs_hour % 48 <= 24 AND unc_km <= 50 AS origin_reliable FROM slick""")
def f26_reliability(spark: SparkSession, d: str) -> DataFrame:
    """What an age allows of a forecast, and whether an origin is reliable."""
    age = F.col("obs_hour") % 100 - 20
    return relation(spark, d, "slick").select("candidate_id", drift.forecast_state(age).alias("forecast"), drift.origin_reliable(F.col("obs_hour") % 48, F.col("unc_km")).alias("origin_reliable"))


@query(sql.with_relations("slick") + f" SELECT candidate_id, {sql.r('sqrt(pow(0.3e0 * sin(lon), 2) + pow(0.2e0 * cos(lat), 2))', 6)} AS speed, {sql.r(sql.mod('degrees(atan2(0.3e0 * sin(lon), 0.2e0 * cos(lat)))', '360e0'))} AS direction FROM slick")
def m17_speed_direction(spark: SparkSession, d: str) -> DataFrame:
    u, v = 0.3 * F.sin("lon"), 0.2 * F.cos("lat")
    return relation(spark, d, "slick").select("candidate_id", _r("speed", F.hypot(u, v), 6), _r("direction", F.pmod(F.degrees(F.atan2(u, v)), F.lit(360.0))))


_DARKEST = (
    sql.gapped() + f", e AS (SELECT s.candidate_id, g.mmsi, g.event_id, g.minutes, {_DARK_KM} AS km, greatest(s.unc_km * 2, 10e0) AS tolerance FROM slick s JOIN gap g ON s.observed >= g.gap_start - INTERVAL 1 HOUR AND s.observed <= g.gap_end + INTERVAL 1 HOUR WHERE {_DARK_KM} <= greatest(s.unc_km * 2, 10e0)), "
    "t AS (SELECT *, least(1e0, 0.6e0 * greatest(0e0, 1 - km / tolerance) + 0.4e0 * least(minutes / 240, 1e0)) AS suspicion FROM e), n AS (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY suspicion DESC, mmsi, minutes) AS place FROM t)"
)


@query(sql.with_relations("slick", "pos", then=_DARKEST) + f" SELECT candidate_id, mmsi, place, {sql.r('suspicion')} AS suspicion FROM n WHERE place <= 3")
def o03_most_suspicious(spark: SparkSession, d: str) -> DataFrame:
    """The three most suspicious silences of each slick, in order."""
    places, to_all = placed_once(origins(spark, d).select("candidate_id", "lon", "lat", "unc_km", "release"))
    pos = relation(spark, d, "pos")
    return to_all(around.silences(places, pos, tracks.gaps(pos), best=3).select("candidate_id", "mmsi", "place", _r("suspicion")))


@query(sql.with_relations("slick") + f" SELECT candidate_id, {sql.r('lon + (2e-2 + 6e-2 + 1e-2) / 4', 6)} AS lon, {sql.r('lat + (1e-2 + 5e-2 + 3e-2) / 4', 6)} AS lat FROM slick")
def a29_vertex_centroid(spark: SparkSession, d: str) -> DataFrame:
    """The mean of a ring's corners, its closing point left out."""
    corner = lambda x, y: F.struct((F.col("lon") + x).alias("lon"), (F.col("lat") + y).alias("lat"))
    ring = F.array(corner(0.0, 0.0), corner(0.02, 0.01), corner(0.06, 0.05), corner(0.01, 0.03), corner(0.0, 0.0))
    return relation(spark, d, "slick").select("candidate_id", text.vertex_centroid(ring).alias("at")).select("candidate_id", _r("lon", F.col("at.lon"), 6), _r("lat", F.col("at.lat"), 6))


_ACROSS = (
    "f AS (SELECT *, first_value(lon) OVER w AS lon0, first_value(lat) OVER w AS lat0 FROM slick WINDOW w AS (PARTITION BY scene_id ORDER BY area_km2 DESC, candidate_id)), "
    f"o AS (SELECT scene_id, candidate_id, {sql.km('lon0', 'lat0', 'lon', 'lat')} * cos(radians({sql.bearing('lon0', 'lat0', 'lon', 'lat')} - 120e0)) AS x FROM f), g AS (SELECT *, x - lag(x) OVER (PARTITION BY scene_id ORDER BY x, candidate_id) AS gap FROM o)"
)


@query(sql.with_relations("slick", then=_ACROSS) + f" SELECT scene_id, candidate_id, {sql.r('x')} AS across_km, {sql.r('gap')} AS gap_km FROM g")
def w06_offset_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Distances across an axis of 30 degrees from a scene's largest slick, and the gaps between neighbours."""
    first = Window.partitionBy("scene_id").orderBy(F.desc("area_km2"), "candidate_id")
    led = relation(spark, d, "slick").withColumns({f"{c}0": F.first(c).over(first) for c in ("lon", "lat")})
    at = [F.col(c) for c in ("lon0", "lat0", "lon", "lat")]
    across = led.withColumn("x", haversine_km(*at) * F.cos(F.radians(bearing_deg(*at) - 120.0)))
    gap = F.col("x") - F.lag("x").over(Window.partitionBy("scene_id").orderBy("x", "candidate_id"))
    return across.withColumn("gap", gap).select("scene_id", "candidate_id", _r("across_km", F.col("x")), _r("gap_km", F.col("gap")))


@query(sql.with_relations("pos") + " SELECT mmsi, '[' || string_agg('[' || printf('%.5f', lon) || ',' || printf('%.5f', lat) || ']', ',' ORDER BY ts, event_id) || ']' AS coordinates, count(*) AS fixes FROM pos GROUP BY mmsi")
def k11_track_coordinates(spark: SparkSession, d: str) -> DataFrame:
    """Each vessel's track as GeoJSON coordinates, in time."""
    return tracks.coordinates(relation(spark, d, "pos"))


@query(sql.with_relations("slick", "incident", then=sql.matched() + ", placed AS (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY confidence DESC, incident_id) AS k FROM match)") + """
SELECT candidate_id, '[' || string_agg('{"incident_id":' || incident_id || ',"distance_km":' || printf('%.1f', floor(km * 10 + 5e-1) / 10) || ',"persistent":' || CAST(persistent AS VARCHAR) || '}', ',' ORDER BY k) || ']' AS matches, count(*) AS n FROM placed WHERE k <= 3 GROUP BY candidate_id""")
def k11_corroboration(spark: SparkSession, d: str) -> DataFrame:
    """Each slick's best documented matches as one JSON array."""
    top = joins.top_corroborated(slicks(spark, d), incidents(spark, d))
    one = F.format_string('{"incident_id":%d,"distance_km":%.1f,"persistent":%s}', "incident_id", round_to(F.col("km"), 1), F.col("persistent").cast("string"))
    ordered = F.array_sort(F.collect_list(F.struct("rank", one.alias("json"))))
    text_of = F.concat(F.lit("["), F.array_join(F.transform(ordered, lambda m: m["json"]), ","), F.lit("]"))
    return top.groupBy("candidate_id").agg(text_of.alias("matches"), F.count("*").alias("n"))


@query(sql.with_relations("slick", "source", then=f"{sql.judged()}, {_SHAPED}") + f"""
SELECT candidate_id, CASE WHEN gate = 'wind_too_low' THEN 'wind ' || printf('%.1f', floor(wind_ms * 1e1 + 5e-1) / 1e1) || ' m/s is below what makes oil visible' WHEN gate = 'wind_too_high' THEN 'wind ' || printf('%.1f', floor(wind_ms * 1e1 + 5e-1) / 1e1) || ' m/s mixes oil away'
WHEN gate IS NOT NULL THEN replace(gate, '_', ' ') WHEN rejected THEN 'likely a look-alike (p ' || printf('%.2f', floor(p_oil * 1e2 + 5e-1) / 1e2) || ')' ELSE shape || ' slick of ' || printf('%.1f', floor(area_km2 * 1e1 + 5e-1) / 1e1) || ' km2, p ' || printf('%.2f', floor(p_oil * 1e2 + 5e-1) / 1e2) END AS evidence FROM shaped""")
def x02_evidence_text(spark: SparkSession, d: str) -> DataFrame:
    """One sentence for each slick."""
    return shaped(spark, d).select("candidate_id", physics.evidence_text(*(F.col(c) for c in ("gate", "rejected", "shape", "wind_ms", "area_km2", "p_oil"))).alias("evidence"))


@query()
def n06_backtrace(spark: SparkSession, d: str) -> DataFrame:
    """Frames of the drift back from every slick that isn't rejected, oldest first; held against plain loops in the tests."""
    kept = judged(slicks(spark, d)).where(~F.col("rejected")).select("candidate_id", "observed")
    clouds = drift.drift_clouds(_shaped(spark, d).join(kept.select("candidate_id"), "candidate_id", "left_semi"), -12.0, DT, n=100, track=True, hull=False)
    frames = clouds.select("candidate_id", "uncertainty_km", "reliable", F.explode("track").alias("f")).join(kept, "candidate_id")
    at = F.col("observed") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("f.hours") * 3600).cast("decimal(18,6)"))
    place = F.row_number().over(Window.partitionBy("candidate_id").orderBy("f.hours"))
    return frames.select("candidate_id", place.cast("long").alias("frame"), at.alias("at"), F.col("f.lon").alias("lon"), F.col("f.lat").alias("lat"), F.col("f.spread_km").alias("spread_km"), "uncertainty_km", "reliable")


_TIMED = (
    "node AS (SELECT k, i, j, sin(i * 0.3e0 + k * 0.1e0) * 0.2e0 AS u, cos(j * 0.2e0 - k * 0.05e0) * 0.1e0 AS v FROM range(61) a(k), range(41) b(i), range(31) c(j)), "
    "p AS (SELECT candidate_id AS id, obs_hour / 12e0 AS z, (lon - 75) / 0.1e0 AS x, (12 - lat) / 0.1e0 AS y FROM slick), "
    "n AS (SELECT id, CAST(floor(z) + dz AS BIGINT) AS k, CAST(floor(x) + dx AS BIGINT) AS i, CAST(floor(y) + dy AS BIGINT) AS j, (CASE WHEN dz = 1 THEN z - floor(z) ELSE 1 - (z - floor(z)) END) * (CASE WHEN dx = 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) * (CASE WHEN dy = 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) AS w FROM p, range(2) a(dz), range(2) b(dx), range(2) c(dy))"
)


@query(sql.with_relations("slick", then=_TIMED) + f" SELECT id, {sql.r('sum(w * u)', 6)} AS u, {sql.r('sum(w * v)', 6)} AS v FROM n JOIN node USING (k, i, j) WHERE w > 0 GROUP BY id HAVING abs(sum(w) - 1) < 1e-9")
def j11_s19_field_in_time(spark: SparkSession, d: str) -> DataFrame:
    """A field of twelve-hour steps at each slick's place and time; its latitudes run from north to south."""
    k, i, j = (spark.range(n).select(F.col("id").alias(x)) for n, x in ((61, "k"), (41, "i"), (31, "j")))
    nodes = k.join(F.broadcast(i)).join(F.broadcast(j))
    grid = nodes.select("k", "i", "j", (F.sin(F.col("i") * 0.3 + F.col("k") * 0.1) * 0.2).alias("u"), (F.cos(F.col("j") * 0.2 - F.col("k") * 0.05) * 0.1).alias("v"))
    points = relation(spark, d, "slick").select(F.col("candidate_id").alias("id"), F.col("obs_hour").cast("double").alias("t"), "lon", "lat")
    got = fields.sample(points, grid, {"t": (0.0, 12.0), "lon": (75.0, 0.1), "lat": (12.0, -0.1)}, outside="null")
    return got.where("u IS NOT NULL").select("id", _r("u", digits=6), _r("v", digits=6))


_FOUND = "joined AS (SELECT s.candidate_id, w.speed, w.direction, row_number() OVER (PARTITION BY s.candidate_id ORDER BY abs(epoch_us(w.ts) - epoch_us(s.observed)), w.ts, w.speed, w.direction) AS k FROM slick s JOIN wind w ON s.candidate_id % 20 = w.cell AND CAST(w.ts AS DATE) = CAST(s.observed AS DATE))"


@query(sql.with_relations("slick", "wind", then=_FOUND) + f" SELECT s.candidate_id, {sql.r('speed')} AS wind_ms, {sql.r('direction')} AS wind_deg, CASE WHEN speed IS NOT NULL THEN 'hourly' END AS wind_source FROM slick s LEFT JOIN joined j ON j.candidate_id = s.candidate_id AND k = 1")
def s18_wind_by_settings(spark: SparkSession, d: str) -> DataFrame:
    """The wind that settings choose, here the hourly table; slicks without a row of their day have none."""
    points = slicks(spark, d).select("candidate_id", (F.col("candidate_id") % 20).alias("cell"), "observed")
    wind = fields.wind_of({"wind": {"source": "hourly", "key": "cell"}}, {"hourly": relation(spark, d, "wind")})
    return wind(points).select("candidate_id", _r("wind_ms"), _r("wind_deg"), "wind_source")
