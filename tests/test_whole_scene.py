"""Raster queries over the whole mosaic, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import raster
from tidewatch.plans import catalog
from tidewatch.sources.relations import pixels


def test_tiling_keeps_a_higher_mosaic(spark, tmp_path):
    rows = [(k, [float(k % 7)] * 64) for k in range(600)]  # 24 tiles high, 192 rows
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = catalog.queries()["r06_a05_j16_tiling"](spark, str(tmp_path))
    want = pixels(spark, str(tmp_path))
    assert got.count() == want.count() == 600 * 64
    assert got.join(want.withColumnRenamed("db", "x"), ["r", "c"]).where(F.abs(F.col("db") - F.col("x")) > 1e-3).isEmpty()


def windows(grid, k, f):
    return f(np.lib.stride_tricks.sliding_window_view(np.pad(grid, k // 2, mode="symmetric"), (k, k)), axis=(2, 3))


def test_dark_patches_of_a_scene(spark):
    grid = np.random.default_rng(3).normal(-17, 1, (90, 70))
    grid[24:40, 32:48] -= 6  # fills whole 8 x 8 tiles
    px = spark.createDataFrame([((i // 8) * 9 + j // 8, i, j, float(grid[i, j])) for i in range(90) for j in range(70)], "tile long, r long, c long, db double")
    got = np.full(grid.shape, np.nan)
    for r in raster.dark_patches(px, band=32).collect():
        got[r.r, r.c] = r.db
    sigma = max(0.25, 1.4826 * np.median(np.abs(grid - np.median(grid))))
    z = np.maximum(0, np.max([(windows(grid, k, np.mean) - grid) / sigma for k in (25, 61)], axis=0))
    x = np.arange(-8, 9)
    g = np.exp(-(x**2) / 8) / np.exp(-(x**2) / 8).sum()
    conv = lambda a, k, axis: np.apply_along_axis(lambda v: np.convolve(np.pad(v, 8, mode="symmetric"), k, "valid"), axis, a)
    slope = np.hypot(conv(conv(grid, x / 4 * g, 0), g, 1), conv(conv(grid, g, 0), x / 4 * g, 1))
    near = windows(np.clip(slope / np.percentile(slope, 90), 0, 1), 15, np.max)
    want = 1 / (1 + np.exp(-(z - 2))) * (0.55 + 0.45 * near)
    assert got == pytest.approx(want, abs=1e-6)
    assert got[28:36, 36:44].mean() > 0.8
