"""GeoTIFF rasters as pixel relations (r, c, v), and back.

format("tidewatch.geotiff") reads the directory of a file once and then its strips or tiles, a run of rows of them in each
partition. Bounds on r and c are pushed into the reader, so a window touches only the blocks that it meets; the option
`decimation` averages square blocks while reading. write_geotiff compresses strips in Spark, and puts the file together
under another name, strip by strip, before it gets its own.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from tidewatch.sources.archives import _file_system
from tidewatch.sources.shared import written

# TIFF field types (struct format, bytes), the tags read here, sample formats.
_TYPES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 6: ("b", 1), 8: ("h", 2), 9: ("i", 4), 11: ("f", 4), 12: ("d", 8), 16: ("Q", 8), 17: ("q", 8)}
_WIDTH, _HEIGHT, _BITS, _COMPRESSION, _STRIPS, _SAMPLES, _STRIP_ROWS, _STRIP_BYTES, _PLANAR, _PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
_TILE_WIDTH, _TILE_HEIGHT, _TILES, _TILE_BYTES, _FORMAT, _SCALE, _TIE, _NODATA = 322, 323, 324, 325, 339, 33550, 33922, 42113
_KINDS = {1: "u", 2: "i", 3: "f"}
#: Rows of pixels that one partition reads at least, and pixels that it gives out at a time.
ROWS, PIXELS = 512, 1 << 18


@dataclass
class Raster:
    """What a file's first directory says."""

    path: str
    rows: int
    cols: int
    samples: int
    dtype: str
    compression: int
    predictor: int
    planar: bool
    block: tuple[int, int]
    offsets: list[int] = field(repr=False)
    sizes: list[int] = field(repr=False)
    #: west, south, east, north; None without a scale and a tie point
    bbox: tuple[float, float, float, float] | None = None
    nodata: float | None = None


def header(path: str) -> Raster:
    """Read the first directory of a TIFF or BigTIFF file."""
    system, at = _file_system(path)
    with system.open_input_file(at) as f:
        head = f.read(16)
        if head[:2] not in (b"II", b"MM"):
            raise ValueError(f"{path} is no TIFF file")
        order = "<" if head[:2] == b"II" else ">"
        big = struct.unpack(f"{order}H", head[2:4])[0] == 43
        first = struct.unpack(f"{order}Q", head[8:16])[0] if big else struct.unpack(f"{order}I", head[4:8])[0]
        f.seek(first)
        n = struct.unpack(f"{order}Q", f.read(8))[0] if big else struct.unpack(f"{order}H", f.read(2))[0]
        step, inline = (20, 8) if big else (12, 4)
        table, tags = f.read(n * step), {}
        for k in range(n):
            tag, kind = struct.unpack_from(f"{order}HH", table, k * step)
            count = struct.unpack_from(f"{order}{'Q' if big else 'I'}", table, k * step + 4)[0]
            if kind not in _TYPES:
                continue
            code, size = _TYPES[kind]
            data = table[(k + 1) * step - inline : (k + 1) * step]
            if count * size > inline:
                f.seek(struct.unpack(f"{order}{'Q' if big else 'I'}", data)[0])
                data = f.read(count * size)
            tags[tag] = data[: count * size].split(b"\0")[0].decode("ascii", "replace") if code == "s" else struct.unpack(f"{order}{count}{code}", data[: count * size])
    one = lambda tag, default: tags.get(tag, (default,))[0]
    rows, cols, bits = one(_HEIGHT, 0), one(_WIDTH, 0), one(_BITS, 1)
    if bits % 8 or one(_COMPRESSION, 1) not in (1, 8, 32946):
        raise ValueError(f"{path}: samples of {bits} bits, compression {one(_COMPRESSION, 1)} can't be read")
    tiled = _TILES in tags
    block = (one(_TILE_HEIGHT, 0), one(_TILE_WIDTH, 0)) if tiled else (min(one(_STRIP_ROWS, rows), rows), cols)
    bbox = None
    if _SCALE in tags and _TIE in tags:
        (sx, sy, *_), (i, j, _, x, y, *_) = tags[_SCALE], tags[_TIE]
        west, north = x - i * sx, y + j * sy
        bbox = (west, north - rows * sy, west + cols * sx, north)
    dtype = f"{order}{_KINDS[one(_FORMAT, 1)]}{bits // 8}"
    nodata = float(tags[_NODATA]) if tags.get(_NODATA, "").strip() else None
    return Raster(path, rows, cols, one(_SAMPLES, 1), dtype, one(_COMPRESSION, 1), one(_PREDICTOR, 1), one(_PLANAR, 1) == 2, block, list(tags[_TILES if tiled else _STRIPS]), list(tags[_TILE_BYTES if tiled else _STRIP_BYTES]), bbox, nodata)


def _decoded(raster: Raster, data: bytes, rows: int) -> np.ndarray:
    """A block as rows x columns x samples."""
    cols, samples, kind = raster.block[1], 1 if raster.planar else raster.samples, np.dtype(raster.dtype)
    if raster.compression != 1:
        data = zlib.decompress(data)
    data = data[: rows * cols * samples * kind.itemsize]
    if raster.predictor == 3:  # bytes by significance, differences along the row
        flat = np.cumsum(np.frombuffer(data, np.uint8).reshape(rows, -1, samples), axis=1, dtype=np.uint8).reshape(rows, kind.itemsize, cols * samples)
        return np.ascontiguousarray(flat.transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(rows, cols, samples)
    grid = np.frombuffer(data, kind).reshape(rows, cols, samples)
    return np.cumsum(grid, axis=1, dtype=kind) if raster.predictor == 2 else grid


def window(raster: Raster, band: int, r0: int, r1: int, c0: int, c1: int) -> np.ndarray:
    """Pixels r0 to r1 - 1, c0 to c1 - 1 of a band as doubles; only the blocks that they lie in are read."""
    height, width = raster.block
    across = -(-raster.cols // width)
    plane = (band - 1) * across * -(-raster.rows // height) if raster.planar else 0
    out = np.full((max(r1 - r0, 0), max(c1 - c0, 0)), np.nan)
    system, at = _file_system(raster.path)
    with system.open_input_file(at) as f:
        for i in range(r0 // height, -(-r1 // height)):
            for j in range(c0 // width, -(-c1 // width)):
                k = plane + i * across + j
                stored = height if across > 1 or width != raster.cols else min(height, raster.rows - i * height)
                f.seek(raster.offsets[k])
                grid = _decoded(raster, f.read(raster.sizes[k]), stored)[:, :, 0 if raster.planar else band - 1]
                top, left = i * height, j * width
                a, b, c, d = max(r0, top), min(r1, top + stored), max(c0, left), min(c1, left + width)
                out[a - r0 : b - r0, c - c0 : d - c0] = grid[a - top : b - top, c - left : d - left]
    if raster.nodata is not None:
        out[out == raster.nodata] = np.nan
    return out


@dataclass
class Run(InputPartition):
    """A run of (decimated) rows."""

    first: int
    last: int


class GeoTiff(DataSource):
    """Options: path, band (1), decimation (1), rows (of a partition, at least). Rows: r, c, v; pixels without data have a null v and don't count in averages."""

    @classmethod
    def name(cls) -> str:
        return "tidewatch.geotiff"

    def schema(self) -> str:
        return "r long, c long, v double"

    def reader(self, schema: StructType) -> DataSourceReader:
        return TiffReader(header(self.options["path"]), int(self.options.get("band", "1")), int(self.options.get("decimation", "1")), int(self.options.get("rows", str(ROWS))))


class TiffReader(DataSourceReader):
    def __init__(self, raster: Raster, band: int, decimation: int, rows: int):
        self.raster, self.band, self.decimation, self.rows = raster, band, decimation, rows
        if not 1 <= band <= raster.samples:
            raise ValueError(f"{raster.path} has {raster.samples} bands")
        self.low, self.high = {"r": 0, "c": 0}, {"r": raster.rows // decimation, "c": raster.cols // decimation}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if column not in self.low or not isinstance(getattr(f, "value", None), int):
                yield f
                continue
            if isinstance(f, GreaterThan | GreaterThanOrEqual | EqualTo):
                self.low[column] = max(self.low[column], f.value + isinstance(f, GreaterThan))
            if isinstance(f, LessThan | LessThanOrEqual | EqualTo):
                self.high[column] = min(self.high[column], f.value + (not isinstance(f, LessThan)))
            if not isinstance(f, GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual | EqualTo):
                yield f

    def partitions(self) -> list[InputPartition]:
        step = -(-max(self.rows, self.raster.block[0]) // self.decimation)
        first, last = self.low["r"], self.high["r"]
        if self.low["c"] >= self.high["c"] or first >= last:
            return [Run(0, 0)]
        return [Run(max(a, first), min(a + step, last)) for a in range(first // step * step, last, step)]

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        c0, c1, f = self.low["c"], self.high["c"], self.decimation
        lines = max(1, PIXELS // max(1, (c1 - c0) * f * f))
        for a in range(partition.first, partition.last, lines):
            b = min(a + lines, partition.last)
            grid = window(self.raster, self.band, a * f, b * f, c0 * f, c1 * f).reshape(b - a, f, c1 - c0, f)
            n = (~np.isnan(grid)).sum(axis=(1, 3))
            with np.errstate(invalid="ignore"):
                v = np.nansum(grid, axis=(1, 3)) / n
            r, c = np.mgrid[a:b, c0:c1]
            yield pa.RecordBatch.from_arrays([pa.array(r.ravel()), pa.array(c.ravel()), pa.array(v.ravel(), from_pandas=True)], ["r", "c", "v"])


def write_geotiff(pixels: DataFrame, path: str, rows: int, cols: int, bbox: tuple[float, float, float, float] | None = None, nodata: float = -9999.0, strip: int = 64) -> None:
    """Write pixels (r, c, v) as one float32 BigTIFF file of deflated strips, north up in degrees if there is a bbox.

    Pixels that aren't there, null and NaN are nodata. Spark makes the strips; the file is put together a strip at a time.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(pdf["k"].iloc[0])
        grid = np.full((min(strip, rows - k * strip), cols), nodata, "<f4")
        grid[pdf["r"].to_numpy() - k * strip, pdf["c"].to_numpy()] = pdf["v"].fillna(nodata).to_numpy("<f4")
        return pd.DataFrame({"k": [k], "data": [zlib.compress(grid.tobytes(), 6)]})

    inside = pixels.where((F.col("r") >= 0) & (F.col("r") < rows) & (F.col("c") >= 0) & (F.col("c") < cols))
    made = inside.select("r", "c", F.col("v").cast("double").alias("v"), F.floor(F.col("r") / strip).alias("k")).groupBy("k").applyInPandas(run, "k long, data binary")
    strips = written(made, "strips").repartitionByRange("k").sortWithinPartitions("k")
    n, system, at = -(-rows // strip), *_file_system(path)
    offsets, sizes, place = [0] * n, [0] * n, 16
    empty: dict[int, bytes] = {}
    with system.open_output_stream(f"{at}.part") as out:
        tags = _directory(rows, cols, strip, [0] * n, [0] * n, bbox, nodata, 16)
        place += len(tags)
        blocks = {r["k"]: r["n"] for r in strips.select("k", F.length("data").alias("n")).collect()}  # a number for each strip
        for k in range(n):
            if k not in blocks:
                lines = min(strip, rows - k * strip)
                empty.setdefault(lines, zlib.compress(np.full((lines, cols), nodata, "<f4").tobytes(), 6))
                blocks[k] = len(empty[lines])
            offsets[k], sizes[k], place = place, blocks[k], place + blocks[k]
        out.write(struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16) + _directory(rows, cols, strip, offsets, sizes, bbox, nodata, 16))
        done = 0
        for r in [*strips.toLocalIterator(prefetchPartitions=False), {"k": n, "data": b""}]:
            for k in range(done, r["k"]):
                out.write(empty[min(strip, rows - k * strip)])
            out.write(bytes(r["data"]))
            done = r["k"] + 1
    system.move(f"{at}.part", at)


def _directory(rows: int, cols: int, strip: int, offsets: list[int], sizes: list[int], bbox: tuple[float, ...] | None, nodata: float, at: int) -> bytes:
    """A BigTIFF directory at this place in the file, and the values that don't fit into it."""
    text = f"{nodata:g}".encode() + b"\0"
    entries = [(_WIDTH, 4, [cols]), (_HEIGHT, 4, [rows]), (_BITS, 3, [32]), (_COMPRESSION, 3, [8]), (262, 3, [1]), (_STRIPS, 16, offsets), (_SAMPLES, 3, [1]), (_STRIP_ROWS, 4, [strip]), (_STRIP_BYTES, 16, sizes), (_PLANAR, 3, [1]), (_FORMAT, 3, [3])]
    if bbox:
        west, south, east, north = bbox
        # 34735: geographic model, area pixels, EPSG:4326
        entries += [(_SCALE, 12, [(east - west) / cols, (north - south) / rows, 0.0]), (_TIE, 12, [0.0, 0.0, 0.0, west, north, 0.0]), (34735, 3, [1, 1, 0, 3, 1024, 0, 1, 2, 1025, 0, 1, 1, 2048, 0, 1, 4326])]
    entries.append((_NODATA, 2, text))
    table, rest = struct.pack("<Q", len(entries)), b""
    after = at + 8 + 20 * len(entries) + 8
    for tag, kind, values in entries:
        code = _TYPES[kind][0]
        data = values if code == "s" else struct.pack(f"<{len(values)}{code}", *values)
        table += struct.pack("<HHQ", tag, kind, len(values))
        if len(data) <= 8:
            table += data.ljust(8, b"\0")
        else:
            table += struct.pack("<Q", after + len(rest))
            rest += data + b"\0" * (-len(data) % 8)
    return table + struct.pack("<Q", 0) + rest
