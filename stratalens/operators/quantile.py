"""Exact interpolated quantiles without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import sized

_ACCURACY = 10000
_MARGIN = 4.0 / _ACCURACY


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """One row per (``by``, prob) with the linearly interpolated quantile ``q`` and the number of values ``n``.

    Two passes over ``df``, neither of which moves its rows. The first takes a bounded, mergeable sketch per group and reads from it a narrow bracket
    around every wanted rank. The second counts what lies below and above the bracket and groups what lies inside by
    value; both combine on the map side, so a group of any size leaves a task as a few thousandths of its values. The
    wanted ranks are then read off the counts. The answer is exact; a bracket that missed its rank would raise.
    """
    by = list(by)
    data = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("__v"))
    marks = [m for p in probs for m in (max(0.0, p - _MARGIN), min(1.0, p + _MARGIN))]
    sketch = F.struct(F.count("__v").alias("n"),
                      F.percentile_approx("__v", F.array(*[F.lit(m) for m in marks]), _ACCURACY).alias("m"))
    brackets = data.groupBy(*by).agg(sketch.alias("__s"))
    placed = data.join(sized(brackets), by) if by else data.withColumn("__s", brackets.scalar())
    spans = F.array(*[
        F.struct(F.lit(float(p)).alias("prob"), F.col("__s.m")[2 * i].alias("lo"), F.col("__s.m")[2 * i + 1].alias("hi"))
        for i, p in enumerate(probs)])
    zone = F.when(F.col("__v") < F.col("s.lo"), -1).when(F.col("__v") > F.col("s.hi"), 1).otherwise(0)
    counted = (
        placed.select(*by, "__v", F.col("__s.n").alias("n"), F.explode(spans).alias("s"))
        .select(*by, "n", F.col("s.prob").alias("prob"), zone.alias("zone"), "__v")
        .groupBy(*by, "prob", "n", "zone", F.when(F.col("zone") == 0, F.col("__v")).alias("inside"))
        .agg(F.count("*").alias("c"), F.min("__v").alias("low"), F.max("__v").alias("high"))
        .withColumn("v", F.when(F.col("zone") < 0, F.col("high")).otherwise(F.col("low")))
    )
    order = Window.partitionBy(*by, "prob").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    at = (F.col("n") - 1) * F.col("prob")
    ranks = counted.withColumn("cum", F.sum("c").over(order)).groupBy(*by, "prob", "n").agg(
        F.min(F.when(F.col("cum") > F.floor(at), F.col("v"))).alias("v0"),
        F.min(F.when(F.col("cum") > F.ceil(at), F.col("v"))).alias("v1"),
        F.coalesce(F.max(F.when(F.col("zone") < 0, F.col("cum"))), F.lit(0)).alias("below"),
        F.coalesce(F.max(F.when(F.col("zone") <= 0, F.col("cum"))), F.lit(0)).alias("within"))
    safe = (F.col("below") - 1 <= F.floor(at)) & (F.col("within") >= F.ceil(at))
    q = F.col("v0") + (F.col("v1") - F.col("v0")) * (at - F.floor(at))
    return ranks.select(
        *by, "prob", F.when(safe, q).otherwise(F.raise_error(F.lit("quantile bracket missed its rank"))).alias("q"), "n")
