"""Sources: scene manifests, vessel-position and incident CSVs, wind and gap JSON, calibration XML, feature tables."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from tidewatch.functions import text

MANIFEST = "scene_id string, acquired_at string, bbox array<double>, vv_path string, vh_path string, orbit_direction string, label string, config string, ais_path string, currents_path string"
# Header names under which vessel-position files carry each field.
AIS_ALIASES = {
    "mmsi": ["MMSI", "mmsi"],
    "lat": ["Latitude", "lat", "latitude", "LAT"],
    "lon": ["Longitude", "lon", "longitude", "LON"],
    "ts": ["# Timestamp", "Timestamp", "timestamp", "BaseDateTime", "time"],
    "sog": ["SOG", "sog", "speed"],
    "cog": ["COG", "cog", "course"],
    "name": ["Name", "name", "VesselName", "shipname"],
    "vessel_type": ["Ship type", "ShipType", "vessel_type", "shiptype"],
    "flag": ["Flag", "flag", "country"],
    "destination": ["Destination", "destination", "DEST"],
}


def scene_manifests(spark: SparkSession, roots: list[str]) -> DataFrame:
    """Scenes of manifest JSON files below several roots; of a scene in more than one, the last root counts.

    Malformed files and those without scene_id, bbox of four numbers and vv_path are left out.
    """
    found = None
    for rank, root in enumerate(roots):
        part = spark.read.schema(MANIFEST).option("multiLine", True).option("mode", "PERMISSIVE").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(root)
        part = part.withColumns({"root_rank": F.lit(rank), "path": F.input_file_name()})
        found = part if found is None else found.unionByName(part)
    whole = found.where("scene_id IS NOT NULL AND vv_path IS NOT NULL AND size(bbox) = 4")
    w = Window.partitionBy("scene_id").orderBy(F.desc("root_rank"), F.desc("path"))
    return whole.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def scenes(manifests: DataFrame) -> DataFrame:
    """Manifest rows as scenes: time, box, centre, dual polarisation, orbit (descending unless said)."""
    west, south, east, north = (F.col("bbox")[k] for k in range(4))
    box = F.struct(west.alias("min_lon"), south.alias("min_lat"), east.alias("max_lon"), north.alias("max_lat"))
    return manifests.select(
        "scene_id", text.to_timestamp(F.col("acquired_at")).alias("acquired_at"), box.alias("bbox"), "vv_path", "vh_path", F.coalesce("orbit_direction", F.lit("DESCENDING")).alias("orbit_direction"),
        F.col("vh_path").isNotNull().alias("is_dual_pol"), ((west + east) / 2).alias("centre_lon"), ((south + north) / 2).alias("centre_lat"),
    )


def ais_csv(spark: SparkSession, path: str | list[str], box: tuple[float, float, float, float] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Vessel positions from CSV files with any of the known headers; rows without a place on earth or a time go."""
    raw = spark.read.option("header", True).csv(path)
    names = {c.strip(): c for c in raw.columns}

    def field(key: str):
        there = [F.col(f"`{names[a]}`") for a in AIS_ALIASES[key] if a in names]
        return text.first_non_blank(*there) if there else F.lit(None).cast("string")

    missing = [k for k in ("mmsi", "lat", "lon", "ts") if not any(a in names for a in AIS_ALIASES[k])]
    if missing:
        raise ValueError(f"no column for {', '.join(missing)} in {path}")
    rows = raw.select(
        field("mmsi").alias("mmsi"), text.to_timestamp(field("ts")).alias("ts"), field("lon").try_cast("double").alias("lon"), field("lat").try_cast("double").alias("lat"),
        text.plain_number(field("sog")).alias("sog"), text.plain_number(field("cog")).alias("cog"), *(field(k).alias(k) for k in ("name", "vessel_type", "flag", "destination")),
    )
    rows = rows.where("mmsi IS NOT NULL AND ts IS NOT NULL AND abs(lat) <= 90 AND abs(lon) <= 180")
    if box:
        rows = rows.where(F.col("lon").between(box[0], box[2]) & F.col("lat").between(box[1], box[3]))
    if start:
        rows = rows.where(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end:
        rows = rows.where(F.col("ts") <= F.lit(end).cast("timestamp"))
    return rows


def incident_csv(spark: SparkSession, path: str, petroleum_only: bool = True) -> DataFrame:
    """Documented spills from the registry CSV: longitude wrapped to [-180, 180), petroleum by keyword."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    clean = raw.toDF(*(c.lstrip("﻿").strip() for c in raw.columns))
    lon, lat = text.to_number(F.col("lon")), text.to_number(F.col("lat"))
    rows = clean.select(
        F.concat(F.lit("noaa-"), F.col("id")).alias("incident_id"), "name", F.when(F.abs(lon) > 180, F.pmod(lon + 180.0, F.lit(360.0)) - 180.0).otherwise(lon).alias("lon"), lat.alias("lat"),
        text.to_date(F.col("open_date")).alias("occurred"), "commodity", "location", text.to_number(F.col("max_ptl_release_gallons")).alias("gallons"), "threat", F.substring("description", 1, 500).alias("description"),
    ).where("lon IS NOT NULL AND abs(lat) <= 90")
    return rows.where(text.is_petroleum(F.col("commodity"), F.col("name"))) if petroleum_only else rows


def hourly_wind(spark: SparkSession, path: str) -> DataFrame:
    """Hourly wind JSON, one file per cell and day: lat, lon, ts, speed, direction; hours with a null are left out."""
    schema = "latitude double, longitude double, hourly struct<time: array<string>, wind_speed_10m: array<double>, wind_direction_10m: array<double>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    hours = F.explode(F.arrays_zip(F.col("hourly.time").alias("time"), F.col("hourly.wind_speed_10m").alias("speed"), F.col("hourly.wind_direction_10m").alias("direction"))).alias("h")
    flat = raw.select("latitude", "longitude", hours)
    fields = [F.col("h")[k] for k in ("time", "speed", "direction")]
    rows = flat.select(F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), F.try_to_timestamp(fields[0], F.lit("yyyy-MM-dd'T'HH:mm")).alias("ts"), fields[1].alias("speed"), fields[2].alias("direction"))
    return rows.where("speed IS NOT NULL AND direction IS NOT NULL")


def calibration_lut(spark: SparkSession, path: str) -> DataFrame:
    """All sigma-nought values of calibration XML files: path, i, value."""
    whole = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    vectors = F.explode(F.regexp_extract_all("value", F.lit(r"<sigmaNought[^>]*>([^<]*)</sigmaNought>"), 1)).alias("v")
    return whole.select("path", vectors).select("path", F.posexplode(F.split(F.trim("v"), r"\s+")).alias("i", "x")).select("path", "i", F.col("x").try_cast("double").alias("value"))


def patch_metadata(spark: SparkSession, path: str, columns: int = 24) -> DataFrame:
    """Tab-separated annotation rows that begin with a product name; fields by position, boxes normalised."""
    rows = spark.read.text(path).where(F.col("value").rlike(r"^S1[A-C]_")).select(F.split("value", "\t").alias("f")).where(F.size("f") >= columns)
    number = lambda k: F.col("f")[k].try_cast("double")
    corner = lambda pick, a, b, c, d: pick(F.coalesce(number(a), number(c)), F.coalesce(number(b), number(d)))
    return rows.select(
        F.col("f")[0].alias("product"), F.col("f")[1].alias("patch"), corner(F.least, 8, 10, 4, 6).alias("west"), corner(F.greatest, 8, 10, 4, 6).alias("east"),
        corner(F.least, 9, 11, 5, 7).alias("south"), corner(F.greatest, 9, 11, 5, 7).alias("north"),
    )


class PagedSource(DataSource):
    """A REST listing read page by page: format("tidewatch.paged") with a `fetch` importable as module:function.

    fetch(offset) returns (rows, next offset or None); rows are tuples of the schema given. All pages are read, unless
    the option `most` asks for a number of rows. As a stream (readStream), `count` names a function that tells how many rows
    there are by now; offsets are row numbers, so a stream that is stopped goes on with the first row it hasn't
    committed, and each partition reads `page` rows of its own. The option `argument` (a URL, say) is handed to both.
    """

    @classmethod
    def name(cls) -> str:
        return "tidewatch.paged"

    def schema(self) -> str:
        return self.options["schema"]

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagedReader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return PagedStream(self.options)


def _called(options: dict, which: str) -> Callable:
    """The function that an option names; the option `argument`, if given, is handed to it by that name."""
    import importlib

    module, _, name = options[which].partition(":")
    function = getattr(importlib.import_module(module), name)
    return functools.partial(function, argument=options["argument"]) if "argument" in options else function


@dataclass
class Rows(InputPartition):
    """Rows first to last - 1 of a listing."""

    first: int
    last: int


class PagedStream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def initialOffset(self) -> dict:
        return {"row": 0}

    def latestOffset(self) -> dict:
        return {"row": int(_called(self.options, "count")())}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        page = int(self.options.get("page", "1000"))
        return [Rows(a, min(a + page, end["row"])) for a in range(start["row"], end["row"], page)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        fetch, at = _called(self.options, "fetch"), partition.first
        while at is not None and at < partition.last:
            rows, then = fetch(at)
            if not rows and then is not None and then <= at:
                raise ValueError(f"the listing gives no row at {at}")
            yield from rows[: partition.last - at]
            at = then if then is None else max(then, at + len(rows))

    def commit(self, end: dict) -> None:
        """Nothing to do: the listing keeps its rows."""


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        fetch = _called(self.options, "fetch")
        offset, left = 0, float(self.options.get("most", "inf"))
        while offset is not None and left > 0:
            rows, offset = fetch(offset)
            yield from rows[: int(min(left, len(rows)))]
            left -= len(rows)


def gap_events(pages: DataFrame, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Gap events of a REST service as gaps: the vessel resumes at the corner of its box farthest from where it was last seen.

    pages: mmsi, name, start, end, lon, lat, box array<double>.
    """
    far_lon = F.when(F.abs(F.col("box")[2] - F.col("lon")) >= F.abs(F.col("box")[0] - F.col("lon")), F.col("box")[2]).otherwise(F.col("box")[0])
    far_lat = F.when(F.abs(F.col("box")[3] - F.col("lat")) >= F.abs(F.col("box")[1] - F.col("lat")), F.col("box")[3]).otherwise(F.col("box")[1])
    rows = pages.where(F.col("lon").between(box[0], box[2]) & F.col("lat").between(box[1], box[3])) if box else pages
    return rows.select("mmsi", "name", text.to_timestamp(F.col("start")).alias("gap_start"), text.to_timestamp(F.col("end")).alias("gap_end"), F.col("lon").alias("last_lon"), F.col("lat").alias("last_lat"), far_lon.alias("resume_lon"), far_lat.alias("resume_lat"))


def daily_files(centre: str, hours_before: int = 8, hours_after: int = 6) -> list[str]:
    """The calendar days that a window around a time touches."""
    from datetime import datetime, timedelta

    at = datetime.fromisoformat(centre)
    first, last = (at - timedelta(hours=hours_before)).date(), (at + timedelta(hours=hours_after)).date()
    return [(first + timedelta(days=k)).isoformat() for k in range((last - first).days + 1)]
