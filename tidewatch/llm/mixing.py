"""Mix sources to target weights: word totals per source, repetition rates, whole copies plus one hash-seeded draw.

A source's target is its share of all words by weight, at most `cap` times its own words; what a capped source can't
take is shared out again by weight. With sources ordered by cap over weight this is one running sum, so it is a window
over one row per source. Rate = target / own words; each document is taken floor(rate) times and once more with
probability rate - floor(rate).

The extra draws are Bernoulli with exactly that probability, seeded by a hash. Documents of a source are dealt by hash
into strata of about STRATUM rows, ordered by size, and the draws of a stratum share one hash-seeded start u: the r-th
document is drawn if floor(p r + u) > floor(p (r - 1) + u). So each stratum draws its share of long and of short
documents, sums stay near the targets even for a few documents with very uneven sizes, and no source, however large,
meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import written

WORD = r"[^\x20\x09-\x0D]+"
STRATUM = 1024
#: One row per source is broadcast up to here; beyond, Spark joins by shuffle and splits large sources.
BROADCAST_SOURCES = 20_000
#: Draws (two numbers each) are broadcast up to here.
BROADCAST_ROWS = 1_000_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit(text: Column) -> Column:
    """A uniform number in [0, 1) from the first 32 bits of a text's MD5."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """One row per source: source, source_size, documents, target. Weights repeat over sources by code point, null last."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("long")
    capped = totals.withColumn("weight", weight).withColumn("most", F.col("source_size") * cap)
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("most").over(before), F.lit(0))) / F.sum("weight").over(rest)
    above = capped.withColumn("level", level).withColumn("full", F.col("most") / F.col("weight") <= F.col("level"))
    final = F.min(F.when(~F.col("full"), F.struct(F.col("most") / F.col("weight"), "level"))).over(Window.partitionBy())["level"]
    target = F.when(F.col("full") | final.isNull(), F.col("most").cast("double")).otherwise(F.col("weight") * final)
    return above.select("source", "source_size", "documents", target.alias("target"))


def copies(sized: DataFrame, targets: DataFrame, seed: str = "mix", doc_id: str = "doc_id", source: str = "source", size: str = "size") -> DataFrame:
    """Add __source_size, __target and __copies to rows with doc_id, source, size."""
    if targets.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    t = targets.toDF("__of", "__source_size", "__documents", "__target")
    joined = sized.join(t, sized[source].eqNullSafe(t["__of"]), "left").drop("__of")
    name = F.coalesce(F.col(source), F.lit(""))
    key = F.concat_ws("|", F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")))
    strata = F.ceil(F.col("__documents") / STRATUM)
    stratum = F.floor(unit(F.concat(key, F.lit("|stratum"))) * strata)
    rate = F.when(F.col("__source_size") > 0, F.col("__target") / F.col("__source_size")).otherwise(F.lit(0.0))
    part = F.col("__rate") - F.floor("__rate")
    rank = F.row_number().over(Window.partitionBy(source, "__stratum").orderBy(F.desc(size), F.md5(key.cast("binary")), doc_id))
    start = unit(F.concat_ws("|", F.lit(seed), name, F.col("__stratum").cast("string")))
    drawn = F.floor(part * F.col("__rank") + F.col("__start")) - F.floor(part * (F.col("__rank") - 1) + F.col("__start"))
    ranked = joined.withColumns({"__stratum": stratum, "__rate": rate}).withColumns({"__rank": rank, "__start": start})
    return ranked.withColumn("__copies", (F.floor("__rate") + drawn).cast("long")).drop("__documents", "__stratum", "__rate", "__rank", "__start")


def mix_report(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: str = "mix") -> DataFrame:
    """What the mix takes of each document: doc_id, size, source_size, target, taken (words, repeats counted).

    A null text has no words. Documents without words are taken as often as others of their source; they add none. A
    null source is a source of its own. Repeated rows are drawn each for itself. An empty table gives an empty result.
    """
    sized = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    mixed = copies(sized, source_targets(sized, weights, cap), seed)
    return mixed.select("doc_id", "size", F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("size") * F.col("__copies")).alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: str = "mix") -> DataFrame:
    """The mixed corpus: every document as often as it is taken, with the columns of docs, whatever their names.

    Cases are handled as in mix_report. Rows are numbered and written once; what is sorted and drawn are numbers, sources
    and sizes. The draws are broadcast to the texts up to BROADCAST_ROWS, beyond that both are shuffled by number.
    """
    names = docs.columns
    plain = docs.toDF(*(f"_{k}" for k in range(len(names))))  # the names of docs can't clash with those used here
    doc_id, source, text = (f"_{names.index(c)}" for c in ("doc_id", "source", "text"))
    rows = written(plain.withColumns({"__row": F.monotonically_increasing_id(), "__size": word_count(F.col(text))}), "numbered")
    narrow = rows.select("__row", doc_id, source, "__size")
    targets = written(source_targets(narrow.select(F.col(source).alias("source"), F.col("__size").alias("size")), weights, cap), "targets")
    taken = written(copies(narrow, targets, seed, doc_id, source, "__size").where("__copies > 0").select("__row", "__copies"), "taken")
    if taken.count() <= BROADCAST_ROWS:
        taken = F.broadcast(taken)
    each = rows.join(taken, "__row").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return each.select(*plain.columns).toDF(*names)


#: The whole mix in DuckDB SQL; {stratum} rows to a stratum.
REPORT_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS documents,
         CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS weight
  FROM sized GROUP BY source
), levelled AS (
  SELECT *, 3 * source_size AS most,
         CAST(sum(source_size) OVER () AS DOUBLE) AS everything,
         coalesce(sum(3 * source_size) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken_before,
         sum(weight) OVER (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left
  FROM totals WINDOW r AS (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, source NULLS LAST)
), marked AS (
  SELECT *, (everything - CAST(taken_before AS DOUBLE)) / CAST(weight_left AS DOUBLE) AS level,
         CAST(most AS DOUBLE) / weight <= (everything - CAST(taken_before AS DOUBLE)) / CAST(weight_left AS DOUBLE) AS is_full
  FROM levelled
), final AS (
  SELECT arg_min(level, CAST(most AS DOUBLE) / weight) AS final_level FROM marked WHERE NOT is_full
), targets AS (
  SELECT source, source_size, documents,
         CASE WHEN is_full OR final_level IS NULL THEN CAST(most AS DOUBLE) ELSE weight * final_level END AS target
  FROM marked, final
), dealt AS (
  SELECT s.doc_id, s.source, s.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0e0 END AS rate,
         'mix|' || coalesce(CAST(s.doc_id AS VARCHAR), 'null') AS k, t.documents
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), strata AS (
  SELECT *, CAST(floor(CAST(('0x' || substr(md5(k || '|stratum'), 1, 8)) AS BIGINT) / 4294967296e0 * ceil(documents / {stratum}e0)) AS BIGINT) AS stratum
  FROM dealt
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source, stratum ORDER BY size DESC, md5(k), doc_id) AS n,
         CAST(('0x' || substr(md5('mix|' || coalesce(source, '') || '|' || CAST(stratum AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296e0 AS u
  FROM strata
)
SELECT doc_id, size, source_size, target,
       size * CAST(floor(rate) + floor((rate - floor(rate)) * n + u) - floor((rate - floor(rate)) * (n - 1) + u) AS BIGINT) AS taken
FROM ranked
""".replace("{stratum}", str(STRATUM))
