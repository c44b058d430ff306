"""Streams in several batches: what closes, what stays in the state, what comes too late, and where a source goes on."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidewatch.sources import readers
from tidewatch.streaming import positions

T0 = datetime.datetime(2024, 1, 1)
SEEN = "observed timestamp, source string"
FIX = "mmsi long, event_id long, ts timestamp, lon double, lat double"


def hours(h):
    return T0 + datetime.timedelta(hours=h)


def add(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).parquet(str(folder))


def test_hours_close_once_and_late_rows_are_left_out(spark, tmp_path):
    at, source = f"file://{tmp_path}/run", tmp_path / "in"
    run = lambda: positions.drain(positions.active_detections(stream(spark, source, SEEN)), "d", at)
    add(spark, source, [(hours(0.1), "a"), (hours(0.9), "a"), (hours(0.2), "b"), (hours(5), "a")], SEEN)
    assert run().count() == 0 and positions.still_open(spark, at).count() == 3
    add(spark, source, [(hours(76), "a")], SEEN)  # the watermark goes to hour 4
    got = {(r["hour"], r["source"]): r["detections"] for r in run().collect()}
    assert got == {(hours(0), "a"): 2, (hours(0), "b"): 1}
    assert positions.still_open(spark, at).count() == 2
    add(spark, source, [(hours(0.5), "a"), (hours(5.5), "a"), (hours(200), "a")], SEEN)  # the first is too late, the second isn't
    got = {(r["hour"], r["source"]): r["detections"] for r in run().collect()}
    assert got == {(hours(0), "a"): 2, (hours(0), "b"): 1, (hours(5), "a"): 2, (hours(76), "a"): 1}
    held = positions.still_open(spark, at).select("key.window.start", "value.count").collect()
    assert [tuple(r) for r in held] == [(hours(200), 1)]


def test_sessions_close_when_the_watermark_passes(spark, tmp_path):
    at, source = f"file://{tmp_path}/run", tmp_path / "in"
    row = lambda m, h: (m, 0, hours(h), 0.0, 0.0)
    run = lambda: {(r["mmsi"], r["started"]): r["fixes"] for r in positions.drain(positions.silence_sessions(stream(spark, source, FIX)), "s", at).collect()}
    add(spark, source, [row(1, 0), row(1, 0.4), row(1, 1.5), row(2, 0)], FIX)
    assert run() == {}
    add(spark, source, [row(1, 0.7), row(3, 73)], FIX)  # joins vessel 1's first session; the watermark goes to hour 1
    assert run() == {(2, hours(0)): 1}
    add(spark, source, [row(3, 100)], FIX)
    assert run() == {(2, hours(0)): 1, (1, hours(0)): 3, (1, hours(1.5)): 1}
    assert positions.still_open(spark, at).count() == 2


def test_recent_fixes_end_after_their_time_to_live(spark, tmp_path):
    at, source = f"file://{tmp_path}/run", tmp_path / "in"
    row = lambda m, i, h: (m, i, hours(h), 0.0, 0.0)
    ended = {}

    def run():
        kept = positions.drain_updates(positions.recent_fixes(stream(spark, source, FIX), 3, 72), "r", "mmsi", at).collect()
        ended.update({r["mmsi"]: r["ended"] for r in kept})
        return {r["mmsi"]: list(r["event_ids"]) for r in kept}

    add(spark, source, [row(1, i, i) for i in range(6)] + [row(2, 9, 2), row(2, 8, 2)], FIX)
    assert run() == {1: [3, 4, 5], 2: [8, 9]} and not any(ended.values())
    add(spark, source, [row(1, 10, 4.5), row(1, 10, 4.5), row(3, 11, 30)], FIX)  # out of order and twice
    assert run() == {1: [4, 10, 5], 2: [8, 9], 3: [11]}
    add(spark, source, [row(3, 12, 77)], FIX)  # the watermark goes to hour 76: vessel 2 was last heard of at 2
    assert run() == {1: [4, 10, 5], 2: [8, 9], 3: [11, 12]} and ended == {1: False, 2: True, 3: False}
    assert positions.still_open(spark, at).count() == 2
    add(spark, source, [row(2, 20, 80), row(3, 13, 90)], FIX)  # vessel 2 starts afresh
    assert run() == {1: [4, 10, 5], 2: [20], 3: [11, 12, 13]} and ended == {1: True, 2: False, 3: False}


def test_paged_stream_goes_on_where_it_stopped(spark, tmp_path):
    """Rows are added between runs; pages are cut by row numbers, not by what the listing returns at a time."""
    listing = tmp_path / "listing.txt"
    listing.write_text("".join(f"v{k}\n" for k in range(5)))
    spark.dataSource.register(readers.PagedSource)
    options = {"schema": "k long, name string", "fetch": "tidewatch.sources.fixtures:lines", "count": "tidewatch.sources.fixtures:line_count", "argument": str(listing), "page": "4"}
    read = lambda: spark.readStream.format("tidewatch.paged").options(**options).load()
    at = f"file://{tmp_path}/run"

    def run():
        return sorted(r["k"] for r in positions.drain(read(), "pages", at).collect())

    assert run() == list(range(5))
    assert run() == list(range(5))  # nothing new
    listing.write_text("".join(f"v{k}\n" for k in range(14)))
    assert run() == list(range(14))
    out = positions.drain(read(), "pages", at)
    assert out.where(F.col("name") != F.concat(F.lit("v"), F.col("k").cast("string"))).count() == 0


def test_pages_split_a_range_of_rows():
    reader = readers.PagedStream({"page": "4"})
    parts = reader.partitions({"row": 3}, {"row": 12})
    assert [(p.first, p.last) for p in parts] == [(3, 7), (7, 11), (11, 12)] and reader.initialOffset() == {"row": 0}
    with pytest.raises(KeyError):
        list(reader.read(parts[0]))  # no function to fetch with
