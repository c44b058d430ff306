"""Structured Streaming over vessel positions and detections."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from tidewatch.sources.shared import shared_dir


def active_detections(stream: DataFrame, hours: int = 72) -> DataFrame:
    """Detections per hour of observation, closed once the watermark of `hours` passes."""
    timed = stream.withColumn("at", F.col("observed").cast("timestamp")).withWatermark("at", f"{hours} hours")
    return timed.groupBy(F.window("at", "1 hour").alias("w"), "source").agg(F.count("*").alias("detections")).select(F.col("w.start").alias("hour"), "source", "detections")


def silence_sessions(stream: DataFrame, gap_minutes: int = 30, late_hours: int = 72) -> DataFrame:
    """Runs of fixes of a vessel without a silence of gap_minutes: mmsi, first fix, end of the session, fixes."""
    timed = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", f"{late_hours} hours")
    sessions = timed.groupBy("mmsi", F.session_window("at", f"{gap_minutes} minutes").alias("s")).agg(F.count("*").alias("fixes"))
    return sessions.select("mmsi", F.col("s.start").alias("started"), F.col("s.end").alias("ended"), "fixes")


def first_seen(stream: DataFrame, cell_degrees: float = 0.05, late_hours: int = 72) -> DataFrame:
    """The first row of each grid cell within the watermark: later ones are recurrences."""
    timed = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", f"{late_hours} hours")
    celled = timed.withColumns({"cx": F.floor(F.col("lon") / cell_degrees), "cy": F.floor(F.col("lat") / cell_degrees)})
    return celled.select("cx", "cy", "at").dropDuplicatesWithinWatermark(["cx", "cy"])


def recent_fixes(stream: DataFrame, keep: int = 3, ttl_hours: int = 72, late_hours: int = 1) -> DataFrame:
    """The last `keep` fixes of each vessel (mmsi, at_us, event_ids, ended), given out anew in each batch that adds some.

    A vessel's state goes when the watermark is ttl_hours past its last fix; its last row then says ended, and fixes that come
    later start afresh. Needs update mode. State holds `keep` fixes for each vessel heard of within the time to live.
    """
    timed = stream.select("mmsi", "event_id", F.col("ts").cast("timestamp").alias("at")).withWatermark("at", f"{late_hours} hours")

    def row(mmsi: int, held: list[tuple[int, int]], ended: bool) -> pd.DataFrame:
        return pd.DataFrame({"mmsi": [mmsi], "at_us": [[t for t, _ in held]], "event_ids": [[i for _, i in held]], "ended": [ended]})

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get, strict=True)) if state.exists else []
        if state.hasTimedOut:
            state.remove()
            yield row(key[0], held, True)
            return
        for pdf in frames:
            at = pdf["at"].astype("datetime64[us]").astype("int64")
            held = sorted({*held, *zip(at.tolist(), pdf["event_id"].tolist(), strict=True)})[-keep:]
        state.update(([t for t, _ in held], [i for _, i in held]))
        state.setTimeoutTimestamp(max(held[-1][0] // 1000 + ttl_hours * 3_600_000, state.getCurrentWatermarkMs() + 1))
        yield row(key[0], held, False)

    return timed.groupBy("mmsi").applyInPandasWithState(step, "mmsi long, at_us array<long>, event_ids array<long>, ended boolean", "at_us array<long>, event_ids array<long>", "update", GroupStateTimeout.EventTimeTimeout)


def drain(stream: DataFrame, name: str, at: str | None = None) -> DataFrame:
    """Run a stream in append mode over all that is there, into Parquet below `at` (or a new shared folder); the table it wrote.

    A last batch without input closes what the watermark has passed. Called again with the same `at`, it goes on where it
    stopped.
    """
    at = at or shared_dir(stream.sparkSession, name)
    run = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{at}/state").option("path", f"{at}/out").trigger(availableNow=True).start()
    run.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{at}/out")


def still_open(spark: SparkSession, at: str) -> DataFrame:
    """key and value of what a drained stream holds in its state: groups that the watermark hasn't passed yet."""
    return spark.read.format("statestore").load(f"{at}/state").select("key", "value")


def drain_updates(stream: DataFrame, name: str, key: str, at: str | None = None) -> DataFrame:
    """Run a stream in update mode over all that is there; the last row given out for each key.

    Each batch has a folder of its own, which a batch that is run again replaces.
    """
    spark = stream.sparkSession
    at = at or shared_dir(spark, name)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={number}")

    run = stream.writeStream.outputMode("update").option("checkpointLocation", f"{at}/state").foreachBatch(keep).trigger(availableNow=True).start()
    run.awaitTermination()
    every = spark.read.option("basePath", f"{at}/out").schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(f"{at}/out")
    rest = [c for c in stream.columns if c != key]
    # a batch gives a key out once, as changed or as ended
    latest = every.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("last"))
    return latest.select(key, "last.*")
