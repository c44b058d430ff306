"""Sinks: keyed results, feature collections, manifests."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.physics import clean


def cache_key(version: str, scene: str, parameters: dict) -> str:
    """The first 16 digits of a SHA-256 over version, scene and parameters."""
    return hashlib.sha256(json.dumps([version, scene, parameters], sort_keys=True).encode()).hexdigest()[:16]


def json_safe(df: DataFrame) -> DataFrame:
    """NaN and infinite numbers to null."""
    return df.withColumns({name: clean(F.col(name)).alias(name) for name, kind in df.dtypes if kind in ("double", "float")})


def feature(lon: Column, lat: Column, ring: Column | None, properties: Column) -> Column:
    """A GeoJSON feature: a polygon for a ring of four points or more, else a point."""
    point = F.to_json(F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")))
    if ring is not None:
        polygon = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(F.transform(ring, lambda p: F.array(p["lon"], p["lat"]))).alias("coordinates")))
        point = F.when(F.size(ring) >= 4, polygon).otherwise(point)
    return F.concat(F.lit('{"type":"Feature","geometry":'), point, F.lit(',"properties":'), F.to_json(properties), F.lit("}"))


def write_by_scene(df: DataFrame, path: str, skip_existing: bool = False) -> None:
    """Results partitioned by scene_id; with skip_existing, scenes that are there already stay as they are."""
    if skip_existing:
        try:
            done = df.sparkSession.read.parquet(path).select("scene_id").distinct()
        except Exception as e:  # the first run finds no table
            if "PATH_NOT_FOUND" not in str(e):
                raise
        else:
            df = df.join(done, "scene_id", "left_anti")
    df.write.mode("append").partitionBy("scene_id").parquet(path)


def replace_scene(df: DataFrame, path: str) -> None:
    """Overwrite the partitions of the scenes in df only."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scene_id").parquet(path)


def write_once(df: DataFrame, folder: str, version: str, scene: str, parameters: dict) -> DataFrame:
    """Results kept under the key of (version, scene, parameters): read if they are there, else computed, written and read.

    Spark's committer makes a folder valid by its _SUCCESS mark, so a run that was cut off counts as none.
    """
    spark, path = df.sparkSession, f"{folder.rstrip('/')}/{cache_key(version, scene, parameters)}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_results(df: DataFrame, path: str) -> None:
    """Append results as JSON lines."""
    json_safe(df).write.mode("append").json(path)


def completed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Results of earlier runs; lines that were torn off in writing are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def world_index(candidates: DataFrame, path: str) -> None:
    """The index of the candidates that are shown, as JSON lines, each file whole."""
    json_safe(candidates).write.mode("overwrite").json(path)


def manifests(scenes: DataFrame, path: str) -> None:
    """Scene manifests as JSON, a folder for each scene."""
    scenes.withColumn("scene", F.col("scene_id")).write.mode("overwrite").partitionBy("scene").json(path)


def feature_table(features: DataFrame, path: str) -> None:
    """Features as CSV with a header."""
    features.write.mode("overwrite").option("header", True).csv(path)
