"""Exact quantiles of a whole column by distributed selection.

Spark's own exact percentile gathers every distinct value in one task where there is no key. Here each round counts the
values in BUCKETS ranges and goes on with the ranges that hold a rank sought, until a range holds one value only or
few enough rows to look at. What returns to the driver is bounded by BUCKETS and FEW, whatever the number of values.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.sources.shared import written

BUCKETS, FEW = 2048, 2000


def _steps(v: float) -> float:
    """A scale that rises over all finite doubles and whose range is short: signed logarithms, with 0 between them."""
    return math.copysign(math.log(abs(v)) + 746.0, v) if v else 0.0


def _bucket(low: float, high: float) -> Column:
    """The range of a value between two finite ones, rising with the value; infinite values lie beyond the first and the last.

    Ranges are even in logarithms where values differ by orders of magnitude, so that a few rounds do for any of them.
    """
    v = F.col("v")
    wide = low <= 0 <= high or max(abs(low), abs(high)) > 1000 * min(abs(low), abs(high))
    scale = F.when(v == 0, 0.0).otherwise(F.signum(v) * (F.log(F.abs(v)) + 746.0)) if wide else v
    start, stop = (_steps(low), _steps(high)) if wide else (low, high)
    step = (stop - start) / BUCKETS or 1.0
    inside = F.least(F.greatest(F.floor((scale - start) / step), F.lit(0)), F.lit(BUCKETS - 1)).cast("int")
    return F.when(v == -math.inf, -1).when(v == math.inf, BUCKETS).otherwise(inside)


def exact_quantiles(df: DataFrame, column: str | Column, shares: list[float]) -> list[float | None]:
    """The quantiles of a column, linear between neighbouring ranks, as F.percentile has them; nulls and NaN don't count.

    A column without a value has nulls. The values are written to the shared folder once, and each round reads them.
    """
    x = F.col(column) if isinstance(column, str) else column
    values = written(df.select(x.cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)"), "values")
    finite = F.when(F.abs("v") < math.inf, F.col("v"))
    head = values.agg(F.count("*").alias("n"), F.min(finite).alias("low"), F.max(finite).alias("high")).first()
    n = head["n"]
    if not n:
        return [None] * len(shares)
    ranks = {r for p in shares for r in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))}
    found: dict[int, float] = {}
    spans = [(-math.inf, math.inf, head["low"] if head["low"] is not None else 0.0, head["high"] if head["high"] is not None else 0.0, 0, n)]
    while spans:
        wide, narrow = [s for s in spans if s[5] > FEW], [s for s in spans if s[5] <= FEW]
        if narrow:  # FEW values each
            rows = [r["v"] for r in values.where(_within(narrow)).collect()]
            for least, most, _, _, before, _ in narrow:
                own = sorted(v for v in rows if least <= v <= most)
                found |= {r: own[r - before] for r in ranks if before <= r < before + len(own)}
        spans = []
        if wide:
            span = F.lit(None).cast("int")
            bucket = F.lit(None).cast("int")
            for k, (least, most, low, high, _, _) in enumerate(wide):
                inside = F.col("v").between(least, most)
                span, bucket = F.when(inside, k).otherwise(span), F.when(inside, _bucket(low, high)).otherwise(bucket)
            counted = values.where(_within(wide)).groupBy(span.alias("span"), bucket.alias("bucket")).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most")).collect()
            for k, (_, _, _, _, before, _) in enumerate(wide):
                for r in sorted((r for r in counted if r["span"] == k), key=lambda r: r["bucket"]):
                    held = [rank for rank in ranks if before <= rank < before + r["n"]]
                    if held and r["least"] == r["most"]:
                        found |= dict.fromkeys(held, r["least"])
                    elif held:
                        spans.append((r["least"], r["most"], r["least"], r["most"], before, r["n"]))
                    before += r["n"]
    out = []
    for p in shares:
        at = p * (n - 1)
        low, high, part = found[math.floor(at)], found[math.ceil(at)], at - math.floor(at)
        out.append(low if low == high else (1 - part) * low + part * high)
    return out


def _within(spans: list[tuple]) -> Column:
    some = F.lit(False)
    for least, most, *_ in spans:
        some = some | F.col("v").between(least, most)
    return some
