"""Evaluation of classifiers and of training runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def iou(predictions: DataFrame, truth: str, guess: str, classes: int) -> DataFrame:
    """Intersection over union of each class (null where it is neither true nor predicted), from the confusion counts."""
    n = predictions.groupBy(F.col(truth).alias("t"), F.col(guess).alias("g")).agg(F.count("*").alias("n"))
    of = n.withColumn("class", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(classes - 1).cast("long"))))
    both = F.sum(F.when((F.col("t") == F.col("class")) & (F.col("g") == F.col("class")), F.col("n")).otherwise(0))
    either = F.sum(F.when((F.col("t") == F.col("class")) | (F.col("g") == F.col("class")), F.col("n")).otherwise(0))
    return of.groupBy("class").agg(F.when(either > 0, both / either).alias("iou"))


def summarise_runs(runs: DataFrame) -> DataFrame:
    """Mean, sample deviation and median latency of each (model, n)."""
    return runs.groupBy("model", "n").agg(F.avg("iou").alias("mean_iou"), F.stddev_samp("iou").alias("sd"), F.percentile("latency", 0.5).alias("latency"))


def rank_under_ceiling(summary: DataFrame, ceiling: float) -> DataFrame:
    """Place of each candidate within the latency ceiling by score; the others follow without a place."""
    able = summary.where(F.col("latency") <= ceiling)
    w = Window.partitionBy().orderBy(F.desc("mean_iou"), "model", "n")  # one row per candidate model
    placed = able.withColumn("place", F.row_number().over(w).cast("long"))
    return placed.unionByName(summary.where(F.col("latency") > ceiling).withColumn("place", F.lit(None).cast("long")))


def balanced(rows: DataFrame, label: str, per_class: int, order: str) -> DataFrame:
    """The first per_class rows of each class."""
    w = Window.partitionBy(label).orderBy(order)
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= per_class).drop("__n")


def dice_focal(pixels: DataFrame, probability: str, truth: str, gamma: float = 2.0) -> DataFrame:
    """One row: dice loss, focal loss and their sum for probabilities of a binary mask."""
    p, t = F.col(probability), F.col(truth).cast("double")
    right = F.when(t == 1, p).otherwise(1 - p)
    focal = F.avg(-F.pow(1 - right, gamma) * F.log(F.greatest(right, F.lit(1e-7))))
    dice = 1 - (2 * F.sum(p * t) + 1) / (F.sum(p) + F.sum(t) + 1)
    return pixels.agg(dice.alias("dice"), focal.alias("focal")).withColumn("loss", F.col("dice") + F.col("focal"))
