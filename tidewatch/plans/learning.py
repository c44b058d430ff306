"""Queries of training, evaluation and bookkeeping."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import evaluation
from tidewatch.plans import screening, sql
from tidewatch.plans.registry import query
from tidewatch.plans.vessels import _r
from tidewatch.sources.relations import relation

_TRUTH = "(candidate_id * 29) % 3"
_GUESS = "(candidate_id * 13) % 3"
_CONFUSED = f"n AS (SELECT {_TRUTH} AS truth, {_GUESS} AS guess, count(*) AS n FROM slick GROUP BY 1, 2)"


def predictions(spark: SparkSession, d: str) -> DataFrame:
    return relation(spark, d, "slick").selectExpr("*", "(candidate_id * 29) % 3 AS truth", "(candidate_id * 13) % 3 AS guess")


@query(sql.with_relations("slick", then=_CONFUSED + ", c AS (SELECT unnest(range(3)) AS class)") + f"""
SELECT CAST(class AS BIGINT) AS class, {sql.r('coalesce(sum(n) FILTER (truth = class AND guess = class), 0) / nullif(CAST(coalesce(sum(n) FILTER (truth = class OR guess = class), 0) AS DOUBLE), 0)')} AS iou FROM c CROSS JOIN n GROUP BY class""")
def a22_class_iou(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.iou(predictions(spark, d), "truth", "guess", 3).select("class", _r("iou"))


@query(sql.with_relations("slick") + f" SELECT scene_id % 7 AS cluster, {sql.r(f'avg(CASE WHEN {_GUESS} = 1 AND {_TRUTH} <> 1 THEN 1e0 ELSE 0e0 END)')} AS false_positive_rate, {sql.r(f'avg(CASE WHEN {_GUESS} = {_TRUTH} THEN 1e0 ELSE 0e0 END)')} AS accuracy FROM slick GROUP BY 1")
def a23_cluster_rates(spark: SparkSession, d: str) -> DataFrame:
    p = predictions(spark, d).withColumn("cluster", F.col("scene_id") % 7)
    wrong = F.when((F.col("guess") == 1) & (F.col("truth") != 1), 1.0).otherwise(0.0)
    return p.groupBy("cluster").agg(_r("false_positive_rate", F.avg(wrong)), _r("accuracy", F.avg(F.when(F.col("guess") == F.col("truth"), 1.0).otherwise(0.0))))


_RUNS = "runs AS (SELECT scene_id % 6 AS n, candidate_id % 4 AS model, area_km2 AS iou, wind_ms AS latency FROM slick), means AS (SELECT model, n, avg(iou) AS mean_iou, stddev_samp(iou) AS sd, quantile_cont(latency, 0.5) AS latency FROM runs GROUP BY model, n)"


def bake_off(spark: SparkSession, d: str) -> DataFrame:
    runs = relation(spark, d, "slick").selectExpr("scene_id % 6 AS n", "candidate_id % 4 AS model", "area_km2 AS iou", "wind_ms AS latency")
    return evaluation.summarise_runs(runs)


@query(sql.with_relations("slick", then=_RUNS) + f" SELECT model, n, {sql.r('mean_iou')} AS mean_iou, {sql.r('sd')} AS sd, {sql.r('latency')} AS latency FROM means")
def a24_bake_off(spark: SparkSession, d: str) -> DataFrame:
    return bake_off(spark, d).select("model", "n", _r("mean_iou"), _r("sd"), _r("latency"))


@query(sql.with_relations("slick", then=_RUNS) + " SELECT model, n, CASE WHEN latency <= 8.5e0 THEN CAST(row_number() OVER (PARTITION BY latency <= 8.5e0 ORDER BY mean_iou DESC, model, n) AS VARCHAR) END AS place FROM means")
def w14_u06_ranked_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Candidates under the latency ceiling by score; those above it are kept without a place."""
    return evaluation.rank_under_ceiling(bake_off(spark, d), 8.5).select("model", "n", F.col("place").cast("string").alias("place"))


@query("SELECT d.lang AS class, count(*) AS n, " + sql.r("avg(CAST(l.quality AS DOUBLE))") + " AS quality FROM documents d JOIN labels l USING (doc_id) GROUP BY d.lang")
def a26_class_counts(spark: SparkSession, d: str) -> DataFrame:
    both = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    return both.groupBy(F.col("lang").alias("class")).agg(F.count("*").alias("n"), _r("quality", F.avg(F.col("quality").cast("double"))))


@query(sql.with_relations("slick", then="o AS (SELECT *, CASE WHEN elongation >= 6 THEN 1 ELSE 0 END AS kind FROM slick), k AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY candidate_id) AS n FROM o)") + " SELECT candidate_id, CAST(kind AS BIGINT) AS kind FROM k WHERE n <= 20")
def o11_s40_balanced_sample(spark: SparkSession, d: str) -> DataFrame:
    """The sampling operator: the first 20 of each class."""
    s = relation(spark, d, "slick").withColumn("kind", (F.col("elongation") >= 6).cast("long"))
    return evaluation.balanced(s, "kind", 20, "candidate_id").select("candidate_id", "kind")


@query(sql.with_relations("slick") + f" SELECT scene_id % 9 AS model, count(*) AS epochs, arg_max(area_km2, candidate_id) AS last_iou, {sql.r('max(area_km2)')} AS best_iou FROM slick GROUP BY 1")
def a32_run_summary(spark: SparkSession, d: str) -> DataFrame:
    runs = relation(spark, d, "slick").withColumn("model", F.col("scene_id") % 9)
    return runs.groupBy("model").agg(F.count("*").alias("epochs"), F.max_by("area_km2", "candidate_id").alias("last_iou"), _r("best_iou", F.max("area_km2")))


@query(sql.with_relations("slick", "source", "incident", "pos", then=screening._DECIDED) + """
SELECT bool_or(reason IS NULL) AS any_attributed, bool_and(rejected OR p_oil >= 0.5e0) AS accepted_are_likely, count(*) FILTER (NOT rejected AND gate IS NOT NULL) AS gated_but_kept, min(candidate_id) FILTER (NOT rejected) AS first_kept FROM decided""")
def a31_validation_checks(spark: SparkSession, d: str) -> DataFrame:
    return screening.decided(spark, d).agg(
        F.bool_or(F.col("reason").isNull()).alias("any_attributed"), F.bool_and(F.col("rejected") | (F.col("p_oil") >= 0.5)).alias("accepted_are_likely"),
        F.count_if(~F.col("rejected") & F.col("gate").isNotNull()).alias("gated_but_kept"), F.min(F.when(~F.col("rejected"), F.col("candidate_id"))).alias("first_kept"),
    )


@query()
def l02_logistic_fit(spark: SparkSession, d: str) -> DataFrame:
    """Fit the look-alike model: balanced class weights, a hashed 70 / 30 split; term, weight and held-out accuracy."""
    j = screening.judged(relation(spark, d, "slick"))
    terms = list(sql.TERMS)
    rows = j.select(*(F.col("contributions")[t].alias(t) for t in terms), (~F.col("rejected")).cast("double").alias("label"), (F.pmod(F.xxhash64("candidate_id"), F.lit(10)) < 7).alias("train"))
    totals = rows.agg(F.count("*").alias("n"), F.sum("label").alias("positive"))  # one row
    balance = F.col("n") / (2.0 * F.when(F.col("label") == 1, F.col("positive")).otherwise(F.col("n") - F.col("positive")))
    weighted = VectorAssembler(inputCols=terms, outputCol="features").transform(rows.join(F.broadcast(totals)).withColumn("weight", balance))
    model = LogisticRegression(weightCol="weight", regParam=0.01, maxIter=50).fit(weighted.where("train"))
    right = model.transform(weighted.where("NOT train")).agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"))
    weights = spark.createDataFrame([(t, float(w)) for t, w in zip(terms, model.coefficients, strict=True)], "term string, weight double")
    return weights.join(F.broadcast(right))
