"""Agreement of two vendors: overlap, latest fundamentals, prices, coverage, recommendation. All tickers are used."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.winsor import long_form

METRICS = ["revenue", "net_income", "total_assets", "total_equity", "operating_cash"]
MIN_ROWS = 10


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Tickers of each side and of both, in one grouped pass over the union."""
    marked = a.select("ticker", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select("ticker", F.lit(0).alias("a"), F.lit(1).alias("b")))
    t = marked.where(F.col("ticker").isNotNull()).groupBy("ticker").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    both = F.sum(F.col("a") * F.col("b"))
    n_a = F.coalesce(F.sum("a"), F.lit(0))
    return t.agg(n_a.alias("n_a"), F.coalesce(F.sum("b"), F.lit(0)).alias("n_b"), F.coalesce(both, F.lit(0)).alias("n_both"),
                 (F.coalesce(both, F.lit(0)) / F.greatest(n_a, F.lit(1)) * 100).alias("overlap_pct"))


def common_tickers(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("ticker").intersect(b.select("ticker"))


def latest(df: DataFrame, metrics: Sequence[str], date: str = "publish_date", ties: Sequence[str] = ()) -> DataFrame:
    """Last non-null value of every metric per ticker."""
    def last(c: str):
        at = F.struct(date, *ties)
        return F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c)

    return df.groupBy("ticker").agg(*[last(c) for c in metrics])


def compare_fundamentals(a: DataFrame, b: DataFrame, metrics: Sequence[str] = METRICS, ties: Sequence[str] = ()) -> DataFrame:
    """Per metric: rows compared, correlation, symmetric mean percentage difference, share within ten percent."""
    shared = [m for m in metrics if m in a.columns and m in b.columns]
    la = long_form(latest(a, shared, ties=ties), shared, ["ticker"]).withColumnRenamed("value", "x")
    lb = long_form(latest(b, shared, ties=ties), shared, ["ticker"]).withColumnRenamed("value", "y")
    pairs = la.join(lb, ["ticker", "feature"])
    valid = pairs.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    gap = F.try_divide(F.abs(F.col("x") - F.col("y")), (F.abs("x") + F.abs("y")) / 2)
    stats = valid.groupBy("feature").agg(
        F.count("*").alias("n"), F.corr("x", "y").alias("r"), F.avg(gap).alias("mape"), F.avg(F.coalesce(gap < 0.10, F.lit(False)).cast("double")).alias("hit"))
    seen = pairs.groupBy("feature").agg(F.count("*").alias("n_joined"))
    listed = a.sparkSession.createDataFrame([(m, m in shared) for m in metrics], "feature string, shared boolean")
    enough = F.coalesce("n", F.lit(0)) >= 2
    status = F.when(~F.col("shared"), "missing_column").when(F.col("n_joined").isNull(), "no_overlap").when(
        ~enough, "insufficient_data").otherwise("compared")
    return listed.join(seen, "feature", "left").join(stats, "feature", "left").select(
        F.col("feature").alias("metric"), status.alias("status"), F.coalesce("n", F.lit(0)).alias("n_compared"),
        *[F.when(enough, F.round(c, d)).alias(name) for name, c, d in (
            ("correlation", F.col("r"), 4), ("mape_pct", F.col("mape") * 100, 2), ("match_rate_10pct", F.col("hit") * 100, 2))])


def price_correlations(a: DataFrame, b: DataFrame) -> DataFrame:
    """Correlation per ticker over common days, for tickers with ten rows on each side and in common."""
    def enough(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("ticker").agg(F.count("*").alias("c")).where(F.col("c") >= MIN_ROWS).select("ticker")

    joined = a.select("ticker", "date", F.col("adj_close").alias("x")).join(b.select("ticker", "date", F.col("adj_close").alias("y")), ["ticker", "date"])
    per = joined.groupBy("ticker").agg(F.count("*").alias("n_days"), F.corr("x", "y").alias("correlation")).where(F.col("n_days") >= MIN_ROWS)
    return per.join(enough(a, "a"), "ticker", "left_semi").join(enough(b, "b"), "ticker", "left_semi").where(
        F.col("correlation").isNotNull() & ~F.isnan("correlation"))


def compare_prices(a: DataFrame, b: DataFrame) -> DataFrame:
    r = F.col("correlation")
    return price_correlations(a, b).agg(
        F.count("*").alias("tickers_compared"), F.round(F.avg(r), 4).alias("mean_correlation"),
        F.round(F.min(r), 4).alias("min_correlation"), F.round(F.max(r), 4).alias("max_correlation"))


def coverage(sources: dict[str, DataFrame], date: str) -> DataFrame:
    """Per source: tickers, rows, first and last date."""
    out = None
    for name, df in sources.items():
        part = df.agg(F.count_distinct("ticker").alias("n_tickers"), F.count("*").alias("n_rows"), F.min(date).alias("first_date"),
                      F.max(date).alias("last_date")).select(F.lit(name).alias("source"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def recommendation(fundamentals: DataFrame, prices: DataFrame, overlaps: DataFrame) -> DataFrame:
    """One row with the findings: low metric correlations, low mean price correlation, small ticker overlap."""
    low = fundamentals.where((F.col("status") == "compared") & (F.coalesce("correlation", F.lit(1.0)) < 0.9)).agg(
        F.array_join(F.array_sort(F.collect_list("metric")), ", ").alias("low"))
    f = overlaps.select("overlap_pct").withColumn("low", low.scalar()).withColumn(
        "price_r", F.coalesce(prices.select("mean_correlation").scalar(), F.lit(1.0)))
    parts = F.filter(F.array(
        F.when(F.col("low") != "", F.concat(F.lit("Low correlation for: "), "low")),
        F.when(F.col("price_r") < 0.99, F.format_string("Price correlation is %.2f%%", F.col("price_r") * 100)),
        F.when(F.col("overlap_pct") < 80, F.format_string("Only %.1f%% ticker overlap", F.col("overlap_pct")))), lambda x: x.isNotNull())
    return f.select(F.when(F.size(parts) == 0, "Both data sources appear consistent. Either can be used.").otherwise(
        F.concat(F.lit("Review needed: "), F.array_join(parts, "; "))).alias("recommendation"))
