"""Streaming queries over the events table, read as a stream and run to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.plans import sql
from tidewatch.plans.registry import query
from tidewatch.sources.relations import RELATIONS
from tidewatch.sources.shared import shared_dir
from tidewatch.streaming import positions


def position_stream(spark: SparkSession, d: str) -> DataFrame:
    """Vessel positions as a stream of the events file."""
    table, _, columns = RELATIONS["pos"]
    path = f"{d}/{table}.parquet"
    schema = spark.read.parquet(path).schema
    folder, name = path.rsplit("/", 1)
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{name.replace('events', 'event[s]')}").selectExpr(*(c.replace("VARCHAR(20)", "STRING") for c in columns))


@query(sql.with_relations("pos") + " SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, vessel_type AS source, count(*) AS detections FROM pos GROUP BY 1, 2")
def q01_q03_hourly_detections(spark: SparkSession, d: str) -> DataFrame:
    """Hours that the watermark has closed, and those still open in the state when the stream has been read."""
    stream = position_stream(spark, d).select(F.col("ts").alias("observed"), F.col("vessel_type").alias("source"))
    at = shared_dir(spark, "detections")
    closed = positions.drain(positions.active_detections(stream), "detections", at)
    held = positions.still_open(spark, at).select(F.col("key.window.start").alias("hour"), "key.source", F.col("value.count").alias("detections"))
    return closed.unionByName(held).withColumn("hour", F.col("hour").cast("timestamp_ntz"))


_SESSION = "g AS (SELECT mmsi, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM pos WINDOW w AS (PARTITION BY mmsi ORDER BY ts)), s AS (SELECT mmsi, ts, sum(fresh) OVER (PARTITION BY mmsi ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)"


@query(sql.with_relations("pos", then=_SESSION) + " SELECT mmsi, min(ts) AS started, max(ts) + INTERVAL 30 MINUTE AS ended, count(*) AS fixes FROM s GROUP BY mmsi, n")
def q02_silence_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions that the watermark has closed, and those still open in the state when the stream has been read."""
    at = shared_dir(spark, "sessions")
    closed = positions.drain(positions.silence_sessions(position_stream(spark, d)), "sessions", at)
    held = positions.still_open(spark, at).select("value.mmsi", F.col("value.session_window.start").alias("started"), F.col("value.session_window.end").alias("ended"), F.col("value.count").alias("fixes"))
    return closed.unionByName(held).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started", "ended")})


@query(sql.with_relations("pos") + " SELECT CAST(floor(lon / 0.05e0) AS BIGINT) AS cx, CAST(floor(lat / 0.05e0) AS BIGINT) AS cy FROM pos GROUP BY 1, 2")
def q06_first_seen_cells(spark: SparkSession, d: str) -> DataFrame:
    return positions.drain(positions.first_seen(position_stream(spark, d), late_hours=24 * 400), "cells").select("cx", "cy")


_LAST = "n AS (SELECT mmsi, ts, event_id, row_number() OVER (PARTITION BY mmsi ORDER BY ts DESC, event_id DESC) AS k FROM pos)"


@query(sql.with_relations("pos", then=_LAST) + " SELECT mmsi, max(k) OVER (PARTITION BY mmsi) - k + 1 AS place, event_id, ts AS at FROM n WHERE k <= 3")
def q04_recent_fixes(spark: SparkSession, d: str) -> DataFrame:
    """The last three fixes of every vessel, oldest first, kept in state that ends 100 days after a vessel's last fix."""
    kept = positions.drain_updates(positions.recent_fixes(position_stream(spark, d), 3, 24 * 100), "recent", "mmsi")
    each = kept.select("mmsi", F.posexplode(F.arrays_zip("at_us", "event_ids")).alias("k", "fix"))
    return each.select("mmsi", (F.col("k") + 1).cast("long").alias("place"), F.col("fix.event_ids").alias("event_id"), F.timestamp_micros("fix.at_us").cast("timestamp_ntz").alias("at"))
