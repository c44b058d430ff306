"""Positions in zip archives: a partition for each member, bounds in the reader, columns checked before anything is read."""

import zipfile

import pytest
from pyspark.sql import functions as F

from tidewatch.sources import archives

HEAD = "MMSI,BaseDateTime,LAT,LON,SOG,COG,VesselName,VesselType,Extra"


def row(k, day, hour):
    return f"{100 + k % 7},2024-01-{day:02d}T{hour:02d}:{k % 60:02d}:00,{9 + k % 20 / 10},{75 + k % 30 / 10},{k % 15}.5,{k % 360},\"V, {k % 7}\",70,x"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("zips")
    for day in (1, 2, 3):
        with zipfile.ZipFile(at / f"AIS_2024_01_{day:02d}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr(f"a{day}.csv", "\n".join([HEAD, *(row(k, day, k % 24) for k in range(500))]))
            z.writestr(f"more/b{day}.CSV", "\n".join(["﻿" + HEAD, *(row(k, day, k % 24) for k in range(500, 700))]))
            z.writestr("readme.txt", "nothing")
    with zipfile.ZipFile(at / "other.zip", "w") as z:
        bad = [",2024-01-02T00:00:00,9,75,1,1,,70,x", "1,never,9,75,1,1,,70,x", "2,2024-01-02T00:00:00,,75,1,1,,70,x", "3,2024-01-02T00:00:00,99,75,1,1,,70,x", "4,2024-01-02T00:00:00,9,75,,abc,,70,x", "5,too,short"]
        z.writestr("odd.csv", "\n".join([HEAD, *bad]))
    return at


@pytest.fixture(scope="module")
def read(spark, folder):
    spark.dataSource.register(archives.PositionArchive)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield spark.read.format("tidewatch.archive").option("path", str(folder)).load()
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_members_are_partitions_and_odd_rows_go(read):
    rows = read.collect()
    assert read.rdd.getNumPartitions() == 7 and len(rows) == 2101
    assert {r["member"] for r in rows if r["archive"].endswith("03.zip")} == {"a3.csv", "more/b3.CSV"}
    odd = [r for r in rows if r["member"] == "odd.csv"]
    assert [(r["mmsi"], r["sog"], r["cog"], r["name"]) for r in odd] == [("4", None, None, None)]
    one = next(r for r in rows if r["member"] == "a1.csv" and r["mmsi"] == "103")
    assert one["name"] == "V, 3" and one["sog"] == 3.5


def test_bounds_reach_the_reader(spark, folder, read):
    box = (F.col("lon") >= 76.0) & (F.col("lon") <= 77.0) & (F.col("lat") > 9.5)
    day = (F.col("ts") >= F.lit("2024-01-02 06:00:00").cast("timestamp")) & (F.col("ts") < F.lit("2024-01-02 18:00:00").cast("timestamp"))
    asked = read.where(box & day)
    want = sorted((r["mmsi"], r["ts"], r["lon"], r["lat"]) for r in read.collect() if 76 <= r["lon"] <= 77 and r["lat"] > 9.5 and r["ts"].day == 2 and 6 <= r["ts"].hour < 18)
    assert sorted((r["mmsi"], r["ts"], r["lon"], r["lat"]) for r in asked.collect()) == want and want
    assert asked.rdd.getNumPartitions() == 3  # the second day's two members, and the archive without a day
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert "76.0" not in plan.split("BatchScan")[0] and "2024-01-02 06:00" in plan  # Spark has no bound on lon left to test


def test_pushed_bounds_prune_and_pass_on():
    from pyspark.sql.datasource import GreaterThan, IsNotNull, LessThanOrEqual

    reader = archives.ArchiveReader("x")
    left = list(reader.pushFilters([GreaterThan(("lon",), 3), LessThanOrEqual(("mmsi",), "9"), IsNotNull(("lat",))]))
    assert len(left) == 2 and reader.bounds == [("lon", ">", 3.0)]
    assert reader._may_hold("AIS_2024_01_02.zip") and reader._may_hold("any.zip")


@pytest.mark.parametrize(("name", "head", "message"), [("lacks.zip", "MMSI,BaseDateTime,LAT", "no column for lon"), ("empty.zip", None, "no CSV")])
def test_missing_columns_are_an_error(spark, read, tmp_path, name, head, message):
    with zipfile.ZipFile(tmp_path / name, "w") as z:
        z.writestr("a.csv" if head else "a.txt", (head or "x") + "\n1,2024-01-01T00:00:00,9\n")
    with pytest.raises(Exception, match=message):
        spark.read.format("tidewatch.archive").option("path", str(tmp_path / name)).load().collect()


def test_an_empty_folder_has_no_rows(spark, read, tmp_path):
    assert spark.read.format("tidewatch.archive").option("path", str(tmp_path)).load().collect() == []
