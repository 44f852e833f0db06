"""Report tables of a run: periods, selections, summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import metrics as M


def period_table(periods: DataFrame, selections: DataFrame, by: Sequence[str] = ("strategy",)) -> DataFrame:
    """Per date: returns, excess, growth, drawdown and its worst so far, mean/deviation so far, turnover, fees and the
    first ten tickers. ``periods`` has portfolio_return, universe_return, index_return, turnover, fees."""
    by = list(by)
    order = "public_date"
    p = M.drawdowns(periods, by, "portfolio_return", order, include_start=True)
    p = M.expanding_sharpe(p, by, "portfolio_return", order, "rolling_sharpe")
    head = selections.where(F.col("position") <= 10).groupBy(*by, order).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "TICKER"))), lambda s: s["TICKER"]), ", ").alias("head"))
    sizes = selections.groupBy(*by, order).agg(F.count("*").alias("n_stocks"))
    w = Window.partitionBy(*by).orderBy(order)
    c = F.col
    return p.drop("n_stocks").join(sizes, [*by, order]).join(head, [*by, order]).select(
        *by, F.row_number().over(w).alias("period"), order, "portfolio_return", "universe_return", "index_return",
        (c("portfolio_return") - c("universe_return")).alias("excess_vs_universe"),
        (c("portfolio_return") - c("index_return")).alias("excess_vs_index"),
        (c("cum") - 1).alias("cumulative_return"), (-c("drawdown")).alias("drawdown"),
        (-c("max_drawdown_to_date")).alias("max_drawdown_to_date"), "rolling_sharpe", "n_stocks", "turnover", "fees",
        F.concat("head", F.when(c("n_stocks") > 10, "...").otherwise("")).alias("stocks"))


def selection_table(selections: DataFrame, periods: DataFrame, actual: str, by: Sequence[str] = ("strategy",)) -> DataFrame:
    """Each selected ticker with its rank, its return and its return over the universe."""
    keys = [*by, "public_date"]
    joined = selections.join(periods.select(*keys, "universe_return"), keys)
    gap = F.col(actual) - F.col("universe_return")
    return joined.select(*keys, "TICKER", "predicted_rank", F.col(actual).alias("actual_return"),
                         (gap > 0).alias("beat_benchmark"), gap.alias("excess_return"))


def run_summary(periods: DataFrame, selections: DataFrame, actual: str, by: Sequence[str] = ("strategy",)) -> DataFrame:
    """Win rate and mean excess over universe and index, fees and turnover, and stock-level statistics."""
    by = list(by)
    u = F.col("portfolio_return") - F.col("universe_return")
    i = F.col("portfolio_return") - F.col("index_return")
    p = periods.groupBy(*by).agg(
        F.count("*").alias("n_periods"), F.avg((u > 0).cast("double")).alias("win_rate_universe"),
        F.avg(u).alias("avg_excess_universe"), F.avg((i > 0).cast("double")).alias("win_rate_index"),
        F.avg(i).alias("avg_excess_index"), F.sum("fees").alias("total_fees"), F.avg("turnover").alias("avg_turnover"))
    # A strategy's selections number dates times portfolio size, so the exact median stays a small group.
    a = F.col(actual)
    s = selections.groupBy(*by).agg(
        F.count(actual).alias("n_selections"), F.avg(actual).alias("avg_stock_return"),
        F.median(actual).alias("median_stock_return"), F.stddev_pop(actual).alias("std_stock_return"),
        F.avg((a > 0).cast("double")).alias("pct_positive"))
    return p.join(s, by, "left")


def metric_sets(periods: DataFrame, periods_per_year: int, by: Sequence[str] = ("strategy",)) -> DataFrame:
    """Four metric rows per strategy: portfolio against universe, against index, universe alone, index alone."""
    by = list(by)
    base = periods.withColumnRenamed("public_date", "date")
    sets = [("portfolio_vs_universe", "portfolio_return", "universe_return"),
            ("portfolio_vs_index", "portfolio_return", "index_return"),
            ("universe", "universe_return", None), ("index", "index_return", None)]
    long = None
    none = F.lit(None).cast("double")
    for name, series, bench in sets:
        part = base.select(*by, "date", F.lit(name).alias("metric_set"), F.col(series).alias("ret"),
                           (F.col(bench) if bench else none).alias("bench"))
        long = part if long is None else long.unionByName(part)
    return M.performance(long, [*by, "metric_set"], "ret", "date", "bench", periods_per_year=periods_per_year)
