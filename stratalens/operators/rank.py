"""Percentile ranks and top-k inside groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import sized


_MARKS = 1024


def pct_rank(df: DataFrame, by: Sequence[str], value: str, out: str, slice_rows: int = 500_000) -> DataFrame:
    """``df`` with the percentile rank of ``value`` in its group, ties averaged, NULL for NULL.

    Ranks are worked out on one row per distinct value (counted on the map side, so a value shared by many rows is
    one row). A sketch per group cuts its value range into slices of about ``slice_rows`` rows, as many as the size of
    the group asks for: counts per slice give the rank at which a slice starts, the window only runs inside
    (group, slice). The ranks return by an equi-join on (group, value), which rows without a value do not enter.
    """
    by = list(by)
    known = df.where(F.col(value).isNotNull())
    values = known.groupBy(*by, value).agg(F.count("*").alias("__n"))
    marks = F.array(*[F.lit(i / _MARKS) for i in range(1, _MARKS)])
    n = F.least(F.lit(_MARKS), F.ceil(F.count("*") / slice_rows)).cast("int")
    cuts = sized(known.groupBy(*by).agg(F.percentile_approx(value, marks, 10 * _MARKS).alias("__marks"), n.alias("__slices")).select(
        *by, F.when(F.col("__slices") > 1, F.transform(F.sequence(F.lit(1), F.col("__slices") - 1), lambda k: F.get("__marks", F.floor(k * _MARKS / F.col("__slices")).cast("int") - 1))).alias("__cuts")))
    over = F.coalesce(F.size(F.filter("__cuts", lambda c: c < F.col(value))), F.lit(-1))
    sliced = values.join(cuts, by, "left").withColumn("__slice", over).drop("__cuts")
    sizes = sliced.groupBy(*by, "__slice").agg(F.sum("__n").alias("__m"))
    before = Window.partitionBy(*by).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*by, "__slice", F.coalesce(F.sum("__m").over(before), F.lit(0)).alias("__start"),
                          F.sum("__m").over(Window.partitionBy(*by)).alias("__all"))
    inside = Window.partitionBy(*by, "__slice").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranks = (
        sliced.withColumn("__cum", F.sum("__n").over(inside))
        .join(starts, [*by, "__slice"])
        .select(*by, value,
                ((F.col("__start") + F.col("__cum") - (F.col("__n") - 1) / 2.0) / F.col("__all")).alias(out))
    )
    ranked = known.join(ranks, [*by, value], "left").select(*df.columns, out)
    return ranked.unionByName(df.where(F.col(value).isNull()).withColumn(out, F.lit(None).cast("double")))


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per group; the limit is applied before the exchange, so hot groups send ``k`` rows per task."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)
