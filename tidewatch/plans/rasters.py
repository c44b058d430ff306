"""Queries of the raster operators on the mosaic of embedding tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import raster
from tidewatch.plans import sql
from tidewatch.plans.registry import query
from tidewatch.plans.vessels import _r
from tidewatch.sources.relations import pixels


def local(spark: SparkSession, d: str) -> DataFrame:
    """Pixels with r and c within their own tile."""
    return pixels(spark, d).select("tile", (F.col("i") / 8).cast("long").alias("r"), (F.col("i") % 8).cast("long").alias("c"), "db")


_DB = "10 * log10(greatest(avg(pow(10e0, db / 10)), 1e-12))"


@query(sql.with_relations("pix") + f" SELECT CAST(floor(r / 2e0) AS BIGINT) AS r, CAST(floor(c / 2e0) AS BIGINT) AS c, {sql.r(_DB)} AS db FROM pix GROUP BY 1, 2")
def a04_block_mean(spark: SparkSession, d: str) -> DataFrame:
    return raster.block_mean(pixels(spark, d), 2).select("r", "c", _r("db"))


@query(sql.with_relations("pix") + " SELECT CAST(floor(r / 4e0) AS BIGINT) AS r, CAST(floor(c / 4e0) AS BIGINT) AS c, bool_or(db > -15) AS bright FROM pix GROUP BY 1, 2")
def a06_mask_any(spark: SparkSession, d: str) -> DataFrame:
    return raster.block_any(pixels(spark, d).withColumn("bright", F.col("db") > -15), 4, "bright")


@query(sql.with_relations("pix", then=f"b AS (SELECT tile, i // 16 AS br, (i % 8) // 2 AS bc, {_DB} AS db FROM pix GROUP BY 1, 2, 3), q AS (SELECT tile, quantile_cont(db, 0.5) AS median, greatest((quantile_cont(db, 0.75) - quantile_cont(db, 0.25)) / 1.349e0, 0.15e0) AS sigma FROM b GROUP BY tile), z AS (SELECT tile, median, sigma, (median - db) / sigma AS z FROM b JOIN q USING (tile)), s AS (SELECT tile, any_value(median) AS median, avg(CASE WHEN z > 2.5e0 THEN 1e0 ELSE 0e0 END) AS area, max(z) AS depth FROM z GROUP BY tile)")
       + f" SELECT tile, {sql.r('median')} AS median, {sql.r('area')} AS area, {sql.r('depth')} AS depth, {sql.r('0.7e0 * least(area * 10, 1e0) + 0.3e0 * least(greatest(depth / 6, 0e0), 1e0)')} AS score FROM s")
def a12_a13_tile_screen(spark: SparkSession, d: str) -> DataFrame:
    return raster.tile_darkness(local(spark, d)).select("tile", _r("median"), _r("area"), _r("depth"), _r("score"))


@query(sql.with_relations("pix") + f" SELECT tile, {sql.r('stddev_pop(pow(10e0, db / 10)) / avg(pow(10e0, db / 10))')} AS speckle_index FROM pix GROUP BY tile")
def a14_speckle_index(spark: SparkSession, d: str) -> DataFrame:
    return raster.speckle_index(local(spark, d), ("tile",)).select("tile", _r("speckle_index"))


@query(sql.with_relations("pix") + f" SELECT {sql.r('avg(CASE WHEN db < 0 THEN 1e0 ELSE 0e0 END)')} AS negative, {sql.r('quantile_cont(db, 0.01)')} AS p1, {sql.r('quantile_cont(db, 0.99)')} AS p99, CASE WHEN avg(CASE WHEN db < 0 THEN 1e0 ELSE 0e0 END) > 0.5e0 THEN 'already_db' ELSE 'raw_dn' END AS mode FROM pix")
def a27_calibration_mode(spark: SparkSession, d: str) -> DataFrame:
    return raster.calibration_mode(pixels(spark, d), "db").select(_r("negative"), _r("p1"), _r("p99"), "mode")


@query(sql.with_relations("pix", then="v AS (SELECT r, c, pow(10e0, db / 10) * 100 AS v FROM pix), q AS (SELECT quantile_cont(v * v, 0.95) AS p95 FROM v WHERE v > 0)") + f" SELECT r, c, {sql.r('10 * log10(greatest(v * v / p95, 1e-6))')} AS db, v > 0 AS valid FROM v CROSS JOIN q")
def r01_m08_calibrate(spark: SparkSession, d: str) -> DataFrame:
    raw = pixels(spark, d).select("r", "c", (F.pow(F.lit(10.0), F.col("db") / 10.0) * 100.0).alias("v"))
    return raster.calibrate(raw, "raw_dn").select("r", "c", _r("db"), "valid")


def _mirror(x: str) -> str:
    return f"CASE WHEN {x} < 0 THEN -1 - ({x}) WHEN {x} > 7 THEN 15 - ({x}) ELSE {x} END"


_AROUND = f"o AS (SELECT unnest(range(-1, 2)) AS k), t AS (SELECT tile, i // 8 AS r, i % 8 AS c, db, pow(10e0, db / 10) AS p FROM pix), near AS (SELECT t.tile, t.r, t.c, n.db, n.p FROM t CROSS JOIN o a CROSS JOIN o b JOIN t n ON n.tile = t.tile AND n.r = {_mirror('t.r + a.k')} AND n.c = {_mirror('t.c + b.k')})"


@query(sql.with_relations("pix", then=_AROUND) + f" SELECT tile, r, c, {sql.r('avg(db)')} AS mean, {sql.r('var_pop(db)', 3)} AS variance FROM near GROUP BY tile, r, c")
def w10_local_statistics(spark: SparkSession, d: str) -> DataFrame:
    return raster.local_statistics(local(spark, d), "db", 3, (8, 8), ("tile",)).select("tile", "r", "c", _r("mean"), _r("variance", digits=3))


@query(sql.with_relations("pix", then=_AROUND) + f" SELECT tile, r, c, {sql.r('max(db)')} AS db FROM near GROUP BY tile, r, c")
def w11_dilation(spark: SparkSession, d: str) -> DataFrame:
    return raster.sliding(local(spark, d), "db", 3, (8, 8), F.max, ("tile",)).select("tile", "r", "c", _r("db", F.col("db_k")))


_LEE = "m AS (SELECT tile, r, c, avg(p) AS mean, greatest(0e0, avg(p * p) - avg(p) * avg(p)) AS variance FROM near GROUP BY tile, r, c), s AS (SELECT m.*, p, mean * mean / 4.4e0 AS noise, greatest(0e0, (variance - mean * mean / 4.4e0) / (1 + 1 / 4.4e0)) AS signal FROM m JOIN t USING (tile, r, c))"


@query(sql.with_relations("pix", then=f"{_AROUND}, {_LEE}") + f" SELECT tile, r, c, {sql.r('10 * log10(greatest(mean + CASE WHEN variance > 0 THEN signal / (signal + noise) ELSE 0e0 END * (p - mean), 1e-12))', 3)} AS db FROM s")
def r02_lee_filter(spark: SparkSession, d: str) -> DataFrame:
    return raster.lee_filter(local(spark, d), 3, 4.4, (8, 8), ("tile",)).select("tile", "r", "c", _r("db", digits=3))


_HALVES = ["a <= 0", "a >= 0", "b <= 0", "b >= 0", "a <= b", "a >= b", "a <= -b", "a >= -b"]
_WIDE = (
    f"o AS (SELECT unnest(range(-3, 4)) AS k), t AS (SELECT tile, i // 8 AS r, i % 8 AS c, pow(10e0, db / 10) AS p FROM pix), near AS (SELECT t.tile, t.r, t.c, n.p, a.k AS a, b.k AS b FROM t CROSS JOIN o a CROSS JOIN o b JOIN t n ON n.tile = t.tile AND n.r = {_mirror('t.r + a.k')} AND n.c = {_mirror('t.c + b.k')}), "
    f"m AS (SELECT tile, r, c, avg(p) AS mean, var_pop(p) AS var, [{', '.join(f'avg(p) FILTER ({h})' for h in _HALVES)}] AS means, [{', '.join(f'var_pop(p) FILTER ({h})' for h in _HALVES)}] AS vars FROM near GROUP BY tile, r, c), "
    "s AS (SELECT *, sqrt(var) / greatest(mean, 1e-12) AS cv, [sqrt(vars[1]) / greatest(means[1], 1e-12)" + "".join(f", sqrt(vars[{k}]) / greatest(means[{k}], 1e-12)" for k in range(2, 9)) + "] AS cvs FROM m), "
    "e AS (SELECT s.*, t.p, list_position(cvs, list_min(cvs)) AS pick, 1 / sqrt(4.4e0) AS cu FROM s JOIN t USING (tile, r, c)), "
    "g AS (SELECT *, CASE WHEN cv > cu THEN means[pick] ELSE mean END AS mm, CASE WHEN cv > cu THEN vars[pick] ELSE var END AS vv FROM e), "
    "f AS (SELECT *, mm * cu * mm * cu AS noise, greatest(0e0, (vv - mm * cu * mm * cu) / (1 + cu * cu)) AS signal FROM g)"
)


@query(sql.with_relations("pix", then=_WIDE) + f" SELECT tile, r, c, {sql.r('10 * log10(greatest(CASE WHEN cv > sqrt(1 + 2 / 4.4e0) THEN p ELSE mm + CASE WHEN signal + noise > 0 THEN signal / greatest(signal + noise, 1e-30) ELSE 0e0 END * (p - mm) END, 1e-12))', 3)} AS db FROM f")
def r03_refined_lee(spark: SparkSession, d: str) -> DataFrame:
    return raster.per_tile(local(spark, d), raster.refined_lee, 8).select("tile", "r", "c", _r("db", digits=3))


@query()
def r08_dark_patches(spark: SparkSession, d: str) -> DataFrame:
    return raster.dark_patches(pixels(spark, d)).withColumnRenamed("db", "p_dark")


@query(sql.with_relations("pix", then="q AS (SELECT tile, r, c, least(greatest(floor((db + 35) / 35 * 32), 0), 31) AS q FROM pix), m(dr, dc) AS (VALUES (0, 1), (1, 1), (1, 0), (1, -1)), p AS (SELECT a.tile, abs(a.q - b.q) AS g FROM q a CROSS JOIN m JOIN q b ON b.tile = a.tile AND b.r = a.r + dr AND b.c = a.c + dc)") + f" SELECT tile, {sql.r('avg(1 / (1 + g * g))')} AS homogeneity, {sql.r('avg(g * g)')} AS contrast FROM p GROUP BY tile")
def a08_texture(spark: SparkSession, d: str) -> DataFrame:
    return raster.cooccurrence(pixels(spark, d)).select("tile", _r("homogeneity"), _r("contrast"))


@query(sql.with_relations("pix") + f" SELECT tile AS label, count(*) AS pixels, {sql.r('count(*) * 0.0064e0')} AS area_km2, {sql.r('avg(r)')} AS row, {sql.r('avg(c)')} AS col, {sql.r('4 * 0.08e0 * sqrt((var_pop(r) + var_pop(c)) / 2 + sqrt(pow((var_pop(r) - var_pop(c)) / 2, 2) + pow(covar_pop(r, c), 2)))')} AS major_km, {sql.r('avg(db)')} AS mean_db FROM pix WHERE db < -17 GROUP BY tile")
def a07_regions(spark: SparkSession, d: str) -> DataFrame:
    dark = pixels(spark, d).where("db < -17").withColumnRenamed("tile", "label")
    return raster.regions(dark, 0.08).select("label", "pixels", _r("area_km2"), _r("row"), _r("col"), _r("major_km"), _r("mean_db"))




@query(sql.with_relations("pix", then="e AS (SELECT tile, i // 8 AS r, i % 8 AS c FROM pix WHERE db < -18), walk AS (SELECT tile, r, c, r * 4294967296 + c AS label FROM e UNION SELECT e.tile, e.r, e.c, walk.label FROM walk JOIN e ON e.tile = walk.tile AND abs(e.r - walk.r) <= 1 AND abs(e.c - walk.c) <= 1)").replace("WITH", "WITH RECURSIVE", 1) + " SELECT tile, r, c, min(label) AS label FROM walk GROUP BY tile, r, c")
def r11_components(spark: SparkSession, d: str) -> DataFrame:
    return raster.components(local(spark, d).where("db < -18"), ("tile",)).select("tile", "r", "c", "label")


_WINDOWS = (
    "h AS (SELECT max(r) + 1 AS n FROM pix), w(y, x) AS (SELECT a.s, b.s FROM (SELECT unnest(range(0, greatest(n - 32, 0) + 1, 24)) FROM h UNION SELECT greatest(n - 32, 0) FROM h) a(s) "
    "CROSS JOIN (VALUES (0), (24), (48), (72), (96), (120), (144), (168)) b(s))"
)


@query(sql.with_relations("pix", then=_WINDOWS) + f" SELECT r, c, {sql.r('avg(db)')} AS db, count(*) AS windows FROM pix JOIN w ON r >= y AND r < y + 32 AND c >= x AND c < x + 32 GROUP BY r, c")
def r06_a05_j16_tiling(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping windows over the whole mosaic, 200 pixels wide and as high as the table asks, and back by the mean."""
    rows = pixels(spark, d).agg(F.coalesce(F.max("r") + 1, F.lit(0))).first()[0]
    windows = raster.tiles(rows, 200, 32, 0.25, spark)
    return raster.merge_tiles(raster.to_tiles(pixels(spark, d), windows, 32, 24), "db").select("r", "c", _r("db"), "windows")


@query(sql.with_relations("pix", then=_AROUND) + " SELECT tile, r, c, bool_or(db > -5) AS land FROM near GROUP BY tile, r, c")
def r05_land_buffer(spark: SparkSession, d: str) -> DataFrame:
    """Bright pixels as land, grown by one pixel."""
    bright = local(spark, d).withColumn("bright", (F.col("db") > -5).cast("int"))
    return raster.sliding(bright, "bright", 3, (8, 8), F.max, ("tile",)).select("tile", "r", "c", (F.col("bright_k") == 1).alias("land"))
