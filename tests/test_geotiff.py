"""GeoTIFF files made by hand: strips and tiles, byte orders, predictors, windows, averages; and the way there and back."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.sources import geotiff


def make(path, bands, dtype, order="<", tile=None, strip=7, deflate=True, predictor=1, planar=False, nodata=None):
    """A classic TIFF file of bands x rows x columns."""
    n, rows, cols = bands.shape
    kind = np.dtype(dtype).newbyteorder(order)
    height, width = tile or (strip, cols)
    planes = [bands[k : k + 1] for k in range(n)] if planar else [bands]
    blocks = []
    for plane in planes:
        for i in range(0, rows, height):
            for j in range(0, cols, width):
                b = np.zeros((height if tile else min(height, rows - i), width, len(plane)), kind)
                part = plane[:, i : i + height, j : j + width].transpose(1, 2, 0)
                b[: part.shape[0], : part.shape[1]] = part
                if predictor == 2:
                    b[:, 1:] = b[:, 1:] - b[:, :-1].copy()
                data = b.tobytes()
                if predictor == 3:
                    shuffled = np.frombuffer(b.astype(kind.newbyteorder(">")).tobytes(), np.uint8).reshape(b.shape[0], -1, kind.itemsize).transpose(0, 2, 1).reshape(b.shape[0], -1, b.shape[2])
                    moved = shuffled.copy()
                    moved[:, 1:] = shuffled[:, 1:] - shuffled[:, :-1]
                    data = moved.tobytes()
                blocks.append(zlib.compress(data) if deflate else data)
    sample = {"u": 1, "i": 2, "f": 3}[kind.kind]
    entries = [(256, "I", [cols]), (257, "I", [rows]), (258, "H", [kind.itemsize * 8] * n), (259, "H", [8 if deflate else 1]), (277, "H", [n]), (284, "H", [2 if planar else 1]), (317, "H", [predictor]), (339, "H", [sample] * n), (33550, "d", [0.5, 0.25, 0]), (33922, "d", [0, 0, 0, 70, 20, 0])]
    entries += [(322, "I", [width]), (323, "I", [height])] if tile else [(278, "I", [strip])]
    if nodata is not None:
        entries.append((42113, "s", f"{nodata}\0".encode()))
    names = (324, 325) if tile else (273, 279)
    entries = sorted([*entries, (names[0], "I", [0] * len(blocks)), (names[1], "I", [len(b) for b in blocks])])
    types, sizes = {"H": 3, "I": 4, "d": 12, "s": 2}, {"H": 2, "I": 4, "d": 8, "s": 1}

    def directory(offsets):
        table, rest, after = struct.pack(f"{order}H", len(entries)), b"", 8 + 2 + 12 * len(entries) + 4
        for tag, code, values in entries:
            values = offsets if tag == names[0] else values
            data = values if code == "s" else struct.pack(f"{order}{len(values)}{code}", *values)
            table += struct.pack(f"{order}HHI", tag, types[code], len(data) // sizes[code])
            table += data.ljust(4, b"\0") if len(data) <= 4 else struct.pack(f"{order}I", after + len(rest))
            rest += data if len(data) > 4 else b""
        return table + struct.pack(f"{order}I", 0) + rest

    first = 8 + len(directory([0] * len(blocks)))
    offsets = [first + sum(map(len, blocks[:k])) for k in range(len(blocks))]
    path.write_bytes(struct.pack(f"{order}2sHI", b"II" if order == "<" else b"MM", 42, 8) + directory(offsets) + b"".join(blocks))
    return str(path)


@pytest.fixture(scope="module")
def load(spark):
    spark.dataSource.register(geotiff.GeoTiff)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield lambda path, **options: spark.read.format("tidewatch.geotiff").options(path=path, **options).load()
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def grid(df, rows, cols):
    out = np.full((rows, cols), np.nan)
    for r in df.collect():
        assert np.isnan(out[r["r"], r["c"]])
        out[r["r"], r["c"]] = np.nan if r["v"] is None else r["v"]
    return out


CASES = [
    {"dtype": "u2"}, {"dtype": "u2", "order": ">", "predictor": 2}, {"dtype": "f4", "tile": (16, 16), "predictor": 3}, {"dtype": "f4", "order": ">", "predictor": 3}, {"dtype": "i2", "deflate": False, "tile": (16, 32)},
    {"dtype": "f8", "planar": True, "strip": 5}, {"dtype": "u1", "predictor": 2, "tile": (16, 16), "planar": True},
]


@pytest.mark.parametrize("case", CASES)
def test_every_layout(load, tmp_path, case):
    rng = np.random.default_rng(1)
    bands = rng.integers(0, 200, (2, 43, 37)).astype(case["dtype"]) if case["dtype"][0] != "f" else rng.normal(size=(2, 43, 37)).astype(case["dtype"])
    path = make(tmp_path / "a.tif", bands, **case)
    assert geotiff.header(path).bbox == (70.0, 20 - 43 * 0.25, 70 + 37 * 0.5, 20.0)
    assert (grid(load(path, band="2", rows="10"), 43, 37) == bands[1]).all()


def test_window_and_average(load, tmp_path):
    """A window is the crop of the whole, and touches the blocks it meets only; averages leave out what has no data."""
    bands = np.arange(64 * 64, dtype="f4").reshape(1, 64, 64)
    bands[0, 10:12, 10:12], bands[0, 12, 12] = -1, -1
    path = make(tmp_path / "b.tif", bands, "f4", tile=(16, 16), nodata=-1)
    whole = np.where(bands[0] == -1, np.nan, bands[0]).astype(float)
    asked = load(path, rows="16").where("r >= 20 AND r < 30 AND c > 15 AND c <= 40")
    got = grid(asked, 64, 64)
    assert np.array_equal(got[20:30, 16:41], whole[20:30, 16:41]) and np.isnan(got).sum() == 64 * 64 - 250
    assert asked.rdd.getNumPartitions() == 1 and load(path, rows="16").rdd.getNumPartitions() == 4
    small = grid(load(path, decimation="4"), 16, 16)
    want = np.array([[np.nanmean(whole[4 * i : 4 * i + 4, 4 * j : 4 * j + 4]) for j in range(16)] for i in range(16)])
    assert np.allclose(small, want)
    assert np.isnan(grid(load(path, decimation="2"), 32, 32)[5, 5])
    assert load(path).where("r > 100").count() == 0 and load(path).where(F.col("v") > 4000).count() == 95
    with pytest.raises(Exception, match="bands"):
        load(path, band="3").collect()


def test_there_and_back(spark, load, tmp_path):
    pixels = spark.range(100 * 50).select((F.col("id") / 50).cast("long").alias("r"), (F.col("id") % 50).alias("c"), F.sin("id").cast("float").cast("double").alias("v"))
    holes = pixels.where("r NOT BETWEEN 20 AND 39 AND c <> 7").withColumn("v", F.when(F.col("c") != 9, F.col("v")))
    path = str(tmp_path / "out.tif")
    geotiff.write_geotiff(holes.repartition(5), path, 100, 50, (70.0, 10.0, 75.0, 20.0), strip=16)
    head = geotiff.header(path)
    assert (head.rows, head.cols, head.bbox, head.nodata) == (100, 50, pytest.approx((70.0, 10.0, 75.0, 20.0)), -9999.0)
    want = np.sin(np.arange(5000)).astype("f4").astype(float).reshape(100, 50)
    want[20:40], want[:, 7], want[:, 9] = np.nan, np.nan, np.nan
    assert np.array_equal(grid(load(path), 100, 50), want, equal_nan=True)
    assert [p.name for p in tmp_path.iterdir()] == ["out.tif"]
    geotiff.write_geotiff(pixels.limit(0), path, 5, 3)
    assert load(path).where("v IS NULL").count() == 15 and geotiff.header(path).bbox is None
