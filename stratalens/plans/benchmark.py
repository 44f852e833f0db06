"""Index series: nearest prices, holding-period returns, resampling. A series has one row per day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.asof import asof_nearest


def _keyed(df: DataFrame) -> DataFrame:
    return df if "series" in df.columns else df.withColumn("series", F.lit("index"))


def nearest_levels(dates: DataFrame, index: DataFrame, on: str = "date") -> DataFrame:
    """Level of the trading day closest to each date; at equal distance the later day."""
    source = _keyed(index).select("series", F.col("date").alias("__day"), F.col("level"))
    return asof_nearest(_keyed(dates), source, ["series"], on, "__day", ["level"])


def holding_returns(dates: DataFrame, index: DataFrame, months: int = 3) -> DataFrame:
    """(date, index_return) from each date to the date ``months`` later, all dates in one plan."""
    ends = dates.select("date", F.lit("start").alias("leg"), F.col("date").alias("at")).unionByName(
        dates.select("date", F.lit("end").alias("leg"), F.add_months("date", months).alias("at")))
    priced = nearest_levels(ends, index, on="at")
    a = priced.groupBy("date").agg(F.max(F.when(F.col("leg") == "start", F.col("level"))).alias("p0"),
                                   F.max(F.when(F.col("leg") == "end", F.col("level"))).alias("p1"))
    return a.select("date", F.when(F.col("p0") > 0, (F.col("p1") - F.col("p0")) / F.col("p0")).alias("index_return"))


def cumulative_returns(index: DataFrame) -> DataFrame:
    w = Window.partitionBy("series").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return _keyed(index).select("series", "date", (F.col("level") / F.first("level").over(w) - 1).alias("cum_return"))


def quarter_end(d: Column) -> Column:
    return F.date_sub(F.add_months(F.trunc(d, "quarter"), 3), 1)


def resampled_returns(index: DataFrame, period: str = "month") -> DataFrame:
    """Last level per month or quarter and its change on the period before; the first period has none and leaves."""
    end = F.last_day("date") if period == "month" else quarter_end(F.col("date"))
    bars = _keyed(index).groupBy("series", end.alias("period_end")).agg(F.max_by("level", "date").alias("level"))
    w = Window.partitionBy("series").orderBy("period_end")
    return bars.select("series", "period_end", (F.col("level") / F.lag("level").over(w) - 1).alias("ret")).where(
        F.col("ret").isNotNull())


def in_range(index: DataFrame, start: str, end: str) -> DataFrame:
    return index.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def coverage(index: DataFrame, start: str, end: str) -> DataFrame:
    """First and last day of the series, and whether they enclose the wanted range."""
    return index.agg(F.min("date").alias("first_day"), F.max("date").alias("last_day"), F.count("*").alias("n_days"),
                     ((F.min("date") <= F.lit(start).cast("date")) & (F.max("date") >= F.lit(end).cast("date"))).alias("covers"))
