"""Performance metrics and report windows over period returns, one group per strategy.

A returns table has one row per (strategy, date), so a strategy's history is as long as its calendar.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_FIELDS = ["total_return", "annualized_return", "avg_period_return", "best_period", "worst_period", "volatility",
           "downside_deviation", "max_drawdown", "max_drawdown_duration", "sharpe_ratio", "sortino_ratio",
           "calmar_ratio", "information_ratio", "alpha", "beta", "tracking_error", "excess_return", "win_rate"]


def _ordered(by: Sequence[str], order: str):
    return Window.partitionBy(*by).orderBy(order)


def growth(df: DataFrame, by: Sequence[str], ret: str, order: str = "date", out: str = "cum") -> DataFrame:
    """Compounded growth of 1, as a running product (also right for returns of -100 %)."""
    w = _ordered(by, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.product(1 + F.col(ret)).over(w))


def drawdowns(df: DataFrame, by: Sequence[str], ret: str, order: str = "date", include_start: bool = False) -> DataFrame:
    """Adds cum, peak, drawdown (zero or negative), max_drawdown_to_date and the current underwater run.

    ``include_start`` lets the peak begin at 1, as the period report does; otherwise at the first period's value.
    """
    w = _ordered(by, order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    peak = F.max("cum").over(so_far)
    if include_start:
        peak = F.greatest(F.lit(1.0), peak)
    out = growth(df, by, ret, order).withColumn("peak", peak).withColumn(
        "drawdown", (F.col("cum") - F.col("peak")) / F.col("peak"))
    row = F.row_number().over(w)
    dry = F.last(F.when(F.col("drawdown") >= 0, F.col("__row")), ignorenulls=True).over(so_far)
    return (out.withColumn("__row", row)
            .withColumn("max_drawdown_to_date", F.min("drawdown").over(so_far))
            .withColumn("underwater", F.col("__row") - F.coalesce(dry, F.lit(0)))
            .drop("__row"))


def performance(returns: DataFrame, by: Sequence[str] = ("strategy",), ret: str = "ret", order: str = "date",
                bench: str | None = None, risk_free: float = 0.02, periods_per_year: float | str = 4,
                include_start: bool = False) -> DataFrame:
    """One row of metrics per group; a group without returns gets zeros. ``bench`` names an aligned column."""
    by = list(by)
    ppy = F.col(periods_per_year) if isinstance(periods_per_year, str) else F.lit(float(periods_per_year))
    extra = [c for c in [bench, periods_per_year if isinstance(periods_per_year, str) else None] if c]
    work = returns.where(F.col(ret).isNotNull()).select(*by, order, ret, *extra)
    work = drawdowns(work, by, ret, order, include_start)
    r = F.col(ret)
    aggs = [
        F.count(ret).alias("n_periods"), (F.product(1 + r) - 1).alias("total_return"),
        F.avg(ret).alias("avg_period_return"), F.max(ret).alias("best_period"), F.min(ret).alias("worst_period"),
        F.stddev(ret).alias("sd"), F.count_if(r < 0).alias("n_neg"), F.stddev(F.when(r < 0, r)).alias("sd_neg"),
        F.abs(F.min("drawdown")).alias("max_drawdown"), F.max("underwater").cast("long").alias("max_drawdown_duration"),
        F.max(ppy).alias("ppy"),
    ]
    if bench:
        both = F.col(bench).isNotNull()
        s, b = F.when(both, r), F.when(both, F.col(bench))
        aggs += [F.count(b).alias("n_both"), F.covar_samp(s, b).alias("cov"), F.var_samp(b).alias("var_b"),
                 (F.product(1 + b) - 1).alias("bench_total"), F.stddev(s - b).alias("sd_gap"), F.avg(s - b).alias("gap"),
                 F.avg((s > b).cast("double")).alias("wins")]
    a = work.groupBy(*by).agg(*aggs)
    ppy = F.col("ppy")

    def annual(total: Column, n: Column) -> Column:
        return F.pow(1 + total, ppy / n) - 1

    def over(top: Column, bottom: Column) -> Column:
        return F.when(bottom > 0, F.try_divide(top, bottom)).otherwise(F.lit(0.0))

    a = a.withColumn("annualized_return", annual(F.col("total_return"), F.col("n_periods")))
    a = a.withColumn("volatility", F.col("sd") * F.sqrt(ppy))
    a = a.withColumn("downside_deviation", F.when(F.col("n_neg") > 0, F.col("sd_neg") * F.sqrt(ppy)).otherwise(F.lit(0.0)))
    extra_return = F.col("annualized_return") - F.lit(float(risk_free))
    a = a.withColumn("sharpe_ratio", over(extra_return, F.col("volatility")))
    a = a.withColumn("sortino_ratio", over(extra_return, F.col("downside_deviation")))
    a = a.withColumn("calmar_ratio", over(F.col("annualized_return"), F.col("max_drawdown")))
    zero = F.lit(0.0)
    if bench:
        enough = F.col("n_both") > 1
        beta = over(F.col("cov"), F.col("var_b"))
        bench_ann = annual(F.col("bench_total"), F.col("n_both"))
        gap_sd = F.col("sd_gap") * F.sqrt(ppy)
        values = {
            "beta": beta,
            "alpha": extra_return - beta * (bench_ann - F.lit(float(risk_free))),
            "tracking_error": gap_sd,
            "information_ratio": over(F.col("gap") * ppy, gap_sd),
            "excess_return": F.col("annualized_return") - bench_ann,
            "win_rate": F.col("wins"),
        }
        a = a.select("*", *[F.when(enough, v).otherwise(zero).alias(k) for k, v in values.items()])
    else:
        a = a.select("*", *[zero.alias(k) for k in ("beta", "alpha", "tracking_error", "information_ratio",
                                                    "excess_return", "win_rate")])
    found = a.select(*by, *_FIELDS, "n_periods", F.col("ppy").cast("int").alias("periods_per_year"))
    if by:
        found = returns.select(*by).distinct().join(found, by, "left")
    empty = F.coalesce(F.col("n_periods"), F.lit(0)) == 0
    default_ppy = F.lit(0) if isinstance(periods_per_year, str) else F.lit(int(periods_per_year))
    return found.select(
        *by, *[F.when(empty, F.lit(0).cast(found.schema[c].dataType)).otherwise(F.col(c)).alias(c) for c in _FIELDS],
        F.coalesce("n_periods", F.lit(0)).alias("n_periods"),
        F.coalesce("periods_per_year", default_ppy).alias("periods_per_year"))


def compare_strategies(metrics: DataFrame) -> DataFrame:
    """The comparison columns of a metrics table, as percentages and ratios rounded for display."""
    c = F.col
    return metrics.select(
        "strategy", F.round(c("total_return") * 100, 1).alias("total_return_pct"),
        F.round(c("annualized_return") * 100, 1).alias("annual_return_pct"),
        F.round(c("volatility") * 100, 1).alias("volatility_pct"), F.round("sharpe_ratio", 2).alias("sharpe"),
        F.round(c("max_drawdown") * 100, 1).alias("max_drawdown_pct"), F.round(c("win_rate") * 100, 0).alias("win_rate_pct"))


def yearly_returns(df: DataFrame, by: Sequence[str], columns: Sequence[str], date: str = "date") -> DataFrame:
    """Compounded return per calendar year of every column."""
    return df.groupBy(*by, F.year(date).alias("year")).agg(*[(F.product(1 + F.col(c)) - 1).alias(c) for c in columns])


def rolling_stats(df: DataFrame, by: Sequence[str], ret: str, window: int = 3, periods_per_year: float = 4.0,
                  order: str = "date") -> DataFrame:
    """Rolling mean (from the first row), mean/deviation (from two rows), return and volatility (full windows only)."""
    w = _ordered(by, order).rowsBetween(1 - window, 0)
    n, mean, sd = F.count(ret).over(w), F.avg(ret).over(w), F.stddev(ret).over(w)
    full = n == window
    return df.select(
        "*", mean.alias("rolling_mean"),
        F.when(n >= 2, F.when(sd > 0, mean / sd).otherwise(F.lit(0.0))).alias("rolling_sharpe"),
        F.when(full, mean * window).alias("rolling_return"),
        F.when(full, sd * F.lit(float(periods_per_year) ** 0.5)).alias("rolling_volatility"))


def expanding_sharpe(df: DataFrame, by: Sequence[str], ret: str, order: str = "date", out: str = "sharpe_to_date") -> DataFrame:
    """Mean over deviation of all returns so far; 0 for one row or no deviation."""
    w = _ordered(by, order).rowsBetween(Window.unboundedPreceding, 0)
    sd = F.stddev(ret).over(w)
    return df.withColumn(out, F.when(sd > 0, F.avg(ret).over(w) / sd).otherwise(F.lit(0.0)))
