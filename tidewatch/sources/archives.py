"""Vessel positions in zip archives of CSV files: format("tidewatch.archive").

One partition for each CSV member, read in blocks where it lies, never unpacked as a whole. Bounds on lon, lat and ts are
pushed into the reader (spark.sql.python.filterPushdown.enabled), so rows outside a box or a window never reach Spark;
archives named by their day are left out where ts can't lie in it. A member that lacks a required column is an error
that names it, rather than an empty table that reads as an empty sea.
"""

from __future__ import annotations

import datetime
import re
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.csv
import pyarrow.fs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from tidewatch.sources.readers import AIS_ALIASES

SCHEMA = "mmsi string, ts timestamp, lon double, lat double, sog double, cog double, name string, vessel_type string, archive string, member string"
REQUIRED = ("mmsi", "ts", "lon", "lat")
#: Bytes of text that a member is read by.
BLOCK = 4 << 20
_BOUNDS = {GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", EqualTo: "="}
_TESTS = {">": np.greater, ">=": np.greater_equal, "<": np.less, "<=": np.less_equal, "=": np.equal}


@dataclass
class Member(InputPartition):
    """A CSV file within an archive."""

    archive: str
    member: str


class PositionArchive(DataSource):
    """Option path: an archive, a folder of them, or several by comma; any address that pyarrow's file systems open."""

    @classmethod
    def name(cls) -> str:
        return "tidewatch.archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArchiveReader(self.options["path"])


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str):
        self.paths, self.bounds = path.split(","), []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Bounds on numbers are dealt with here; those on time too, but Spark looks at them again (its time zone counts)."""
        for f in filters:
            kind, column = _BOUNDS.get(type(f)), getattr(f, "attribute", ())
            if kind and column in (("lon",), ("lat",)) and isinstance(f.value, int | float):
                self.bounds.append((column[0], kind, float(f.value)))
                continue
            if kind and column == ("ts",) and isinstance(f.value, datetime.datetime):
                self.bounds.append(("ts", kind, _utc(f.value)))
            yield f

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in self.paths:
            system, root = _file_system(path)
            info = system.get_file_info(root)
            found = [info] if info.is_file else system.get_file_info(pyarrow.fs.FileSelector(root, recursive=True))
            for f in sorted((f for f in found if f.path.lower().endswith(".zip") and self._may_hold(f.base_name)), key=lambda f: f.path):
                with system.open_input_file(f.path) as raw, zipfile.ZipFile(raw) as z:
                    members = sorted(n for n in z.namelist() if n.lower().endswith(".csv"))
                if not members:
                    raise ValueError(f"no CSV in {f.path}")
                out += [Member(path if info.is_file else path.rstrip("/") + f.path[len(root.rstrip("/")) :], m) for m in members]
        return out or [Member("", "")]

    def _may_hold(self, name: str) -> bool:
        """Whether an archive named by its day can hold a time within the bounds; any other name can."""
        day = re.search(r"(\d{4})[-_]?(\d{2})[-_]?(\d{2})", name)
        if not day:
            return True
        first = np.datetime64("-".join(day.groups()), "us")
        last = first + np.timedelta64(1, "D")
        return all({">": last > v, ">=": last > v, "<": first < v, "<=": first <= v, "=": first <= v < last}[kind] for column, kind, v in self.bounds if column == "ts")

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        system, path = _file_system(partition.archive)
        with system.open_input_file(path) as raw, zipfile.ZipFile(raw) as z:
            with z.open(partition.member) as head:
                columns = head.readline().decode("utf-8-sig", "replace").strip().split(",")
            names = {c.strip().strip('"'): c.strip().strip('"') for c in columns}
            at = {key: next((a for a in aliases if a in names), None) for key, aliases in AIS_ALIASES.items()}
            missing = [key for key in REQUIRED if at.get(key) is None]
            if missing:
                raise ValueError(f"{partition.member} in {partition.archive} has no column for {', '.join(missing)}; it has {', '.join(names)}")
            wanted = {c for key in ("mmsi", "ts", "lon", "lat", "sog", "cog", "name", "vessel_type") if (c := at.get(key))}
            with z.open(partition.member) as rows:
                blocks = pyarrow.csv.open_csv(
                    rows, pyarrow.csv.ReadOptions(block_size=BLOCK, column_names=list(names), skip_rows=1), pyarrow.csv.ParseOptions(invalid_row_handler=lambda _: "skip"),
                    pyarrow.csv.ConvertOptions(column_types=dict.fromkeys(wanted, pa.string()), include_columns=sorted(wanted), strings_can_be_null=True),
                )
                for block in blocks:
                    yield self._kept(block, at, partition)

    def _kept(self, block: pa.RecordBatch, at: dict[str, str | None], partition: Member) -> pa.RecordBatch:
        text = {key: block.column(c).to_pandas() for key, c in at.items() if c in block.schema.names}
        number = {key: pd.to_numeric(text[key], errors="coerce").to_numpy(float) if key in text else np.full(block.num_rows, np.nan) for key in ("lon", "lat", "sog", "cog")}
        ts = pd.to_datetime(text["ts"], errors="coerce", utc=True, format="mixed").dt.tz_localize(None).to_numpy("datetime64[us]")
        with np.errstate(invalid="ignore"):
            on = text["mmsi"].notna().to_numpy() & ~np.isnat(ts) & (np.abs(number["lon"]) <= 180) & (np.abs(number["lat"]) <= 90)
            for column, kind, value in self.bounds:
                on &= _TESTS[kind](ts if column == "ts" else number[column], value)
        n = int(on.sum())
        strings = lambda key: pa.array(text[key][on], pa.string(), from_pandas=True) if key in text else pa.nulls(n, pa.string())
        numbers = {key: pa.array(number[key][on], from_pandas=True) for key in number}
        return pa.RecordBatch.from_arrays(
            [strings("mmsi"), pa.array(ts[on], pa.timestamp("us", "UTC")), numbers["lon"], numbers["lat"], numbers["sog"], numbers["cog"], strings("name"), strings("vessel_type"), pa.array([partition.archive] * n, pa.string()), pa.array([partition.member] * n, pa.string())],
            ["mmsi", "ts", "lon", "lat", "sog", "cog", "name", "vessel_type", "archive", "member"],
        )


def _utc(at: datetime.datetime) -> np.datetime64:
    return np.datetime64(at.astimezone(datetime.UTC).replace(tzinfo=None) if at.tzinfo else at, "us")


def _file_system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)
