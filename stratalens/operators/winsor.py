"""Robust clipping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.columns import clip
from ..session import sized
from .quantile import exact_quantiles


def long_form(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep…, feature, value) rows."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(*keep, F.explode(pairs).alias("p")).select(*keep, "p.feature", "p.value")


def mad_bounds(df: DataFrame, columns: Sequence[str], n_mad: float = C.WINSOR_MAD,
               by: Sequence[str] = ()) -> DataFrame:
    """(by…, feature, median, mad, low, high): median ± n·MAD of every column; no bounds where the MAD is zero."""
    keys = [*by, "feature"]
    values = long_form(df, columns, by)
    mid = exact_quantiles(values, keys, "value", [0.5]).select(*keys, F.col("q").alias("median"))
    mid = sized(mid)
    gaps = values.join(mid, keys).withColumn("gap", F.abs(F.col("value") - F.col("median")))
    mad = exact_quantiles(gaps, keys, "gap", [0.5]).select(*keys, F.col("q").alias("mad"))
    width = F.when(F.col("mad") > 0, F.lit(float(n_mad)) * F.col("mad"))
    return mid.join(mad, keys, "left").select(
        *keys, "median", "mad", (F.col("median") - width).alias("low"), (F.col("median") + width).alias("high"))


def winsorize(df: DataFrame, columns: Sequence[str], n_mad: float = C.WINSOR_MAD,
              by: Sequence[str] = ()) -> DataFrame:
    """Clip ``columns`` to median ± n·MAD over all rows, or per ``by`` group.

    The input is read several times, so pass a stored table. Bounds are a handful of values in one struct with a field
    per column: without ``by`` it enters from a scalar subquery, with ``by`` one per group through an equi-join.
    """
    bounds = mad_bounds(df, columns, n_mad, by)
    pair = F.struct("low", "high")
    rows = bounds.groupBy(*by).agg(F.struct(*[
        F.first(F.when(F.col("feature") == c, pair), ignorenulls=True).alias(c) for c in columns]).alias("__bounds"))
    work = df.join(sized(rows), list(by), "left") if by else df.withColumn("__bounds", rows.scalar())
    chosen = set(columns)

    def clipped(name: str):
        b = F.col("__bounds").getField(name)
        return clip(F.col(name), b["low"], b["high"]).alias(name)

    return work.select(*[clipped(c) if c in chosen else F.col(c) for c in df.columns])


def winsorize_percentiles(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """Clip one column at two percentiles (0 to 100, linear interpolation)."""
    q = exact_quantiles(df, [], column, [low / 100.0, high / 100.0])
    pair = q.agg(F.struct(F.min("q").alias("low"), F.max("q").alias("high")).alias("b"))
    work = df.withColumn("__b", pair.scalar())
    return work.select(*[clip(F.col(c), F.col("__b.low"), F.col("__b.high")).alias(c) if c == column else F.col(c)
                         for c in df.columns])
