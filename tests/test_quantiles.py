"""Exact quantiles by range refinement against numpy and Spark's own percentile."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import quantiles, raster

SHARES = [0.0, 0.01, 0.25, 0.5, 0.68, 0.9, 0.95, 0.99, 1.0]


def values(kind):
    rng = random.Random(5)
    return {
        "distinct": [rng.gauss(0, 10) for _ in range(9000)],
        "ties": [float(rng.randint(0, 5)) for _ in range(5000)],
        "one": [3.5],
        "equal": [7.0] * 4000,
        "decades": [(-1) ** i * 10.0 ** rng.uniform(-300, 300) for i in range(6000)],
        "infinite": [math.inf] * 900 + [-math.inf] * 900 + [rng.random() for _ in range(900)],
        "far apart": [-1.7e308, 1.7e308, 0.0, 5e-324, -5e-324] * 700,
        "hot value": [0.0] * 8000 + [rng.uniform(-1e-9, 1e-9) for _ in range(4000)],
    }[kind]


@pytest.mark.parametrize("kind", ["distinct", "ties", "one", "equal", "decades", "infinite", "far apart", "hot value"])
def test_quantiles_by_numpy(spark, monkeypatch, kind):
    monkeypatch.setattr(quantiles, "FEW", 20)
    monkeypatch.setattr(quantiles, "BUCKETS", 512)
    own = values(kind)
    df = spark.createDataFrame([(v, 1) for v in own] + [(None, 1), (float("nan"), 1)], "x double, v int").repartition(3)
    got = quantiles.exact_quantiles(df, "x", SHARES)
    order = np.sort(own)
    for p, g in zip(SHARES, got, strict=True):
        at = p * (len(own) - 1)
        low, high = order[math.floor(at)], order[math.ceil(at)]
        assert g == (low if low == high else pytest.approx((1 - at + math.floor(at)) * low + (at - math.floor(at)) * high, rel=1e-12)), (kind, p)


def test_quantiles_as_percentile_has_them(spark):
    df = spark.range(30_000).select((F.sin("id") * 5).alias("x"))
    want = df.agg(F.percentile("x", F.array(*map(F.lit, SHARES)))).first()[0]
    assert quantiles.exact_quantiles(df, F.col("x"), SHARES) == pytest.approx(want, rel=1e-12)
    assert quantiles.exact_quantiles(df.where("false"), "x", [0.5]) == [None]


def test_rounds_return_bounded_rows(spark, monkeypatch):
    """However many distinct values there are, a round's counts are at most BUCKETS a range."""
    monkeypatch.setattr(quantiles, "BUCKETS", 100)
    monkeypatch.setattr(quantiles, "FEW", 10)
    seen, collect = [], type(spark.range(1)).collect
    monkeypatch.setattr(type(spark.range(1)), "collect", lambda df: seen.append(len(out := collect(df))) or out)
    df = spark.range(20_000).select((F.col("id") * 1.5).alias("x"))
    assert quantiles.exact_quantiles(df, "x", [0.5])[0] == pytest.approx(1.5 * 19_999 / 2)
    assert max(seen) <= 2 * 101 and len(seen) > 2


def test_calibration_of_no_pixels(spark):
    none = spark.createDataFrame([], "r long, c long, v double")
    assert [tuple(r) for r in raster.calibration_mode(none).collect()] == [(None, None, None, "raw_dn")]
    assert raster.calibrate(none, "raw_dn").collect() == []
