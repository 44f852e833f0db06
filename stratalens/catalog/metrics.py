"""Metric, benchmark and report-window queries and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..fixtures import sig, sig_sql, with_sql
from ..plans import benchmark as B
from ..plans import metrics as M
from ..plans import panel as P
from .panel import BARS_NAMES, all_ctes, rounded, rounded_sql

FIELDS = ["total_return", "annualized_return", "avg_period_return", "best_period", "worst_period", "volatility",
          "downside_deviation", "max_drawdown", "sharpe_ratio", "sortino_ratio", "calmar_ratio", "information_ratio",
          "alpha", "beta", "tracking_error", "excess_return", "win_rate"]


def returns(spark, sf):
    """Monthly return per sector: mean of the members' one-month returns, each clipped."""
    bars = P.month_bars(X.prices(spark, sf), X.TIES).select("TICKER", "public_date", "1mo_return")
    r = F.least(F.greatest(F.col("1mo_return"), F.lit(-0.3)), F.lit(0.35))
    return (bars.where(F.col("1mo_return").isNotNull()).join(X.sectors(spark, sf), "TICKER")
            .groupBy(F.col("sector").alias("strategy"), F.col("public_date").alias("date")).agg(F.round(F.avg(r), 9).alias("ret")))


def index_months(spark, sf):
    return B.resampled_returns(X.benchmark_daily(spark, sf)).select(F.col("period_end").alias("date"), F.col("ret").alias("bench"))


def aligned(spark, sf):
    return returns(spark, sf).join(index_months(spark, sf), "date", "left")


def performance(spark, sf):
    d = M.performance(aligned(spark, sf), bench="bench", periods_per_year=12)
    return rounded(d, ["strategy", "max_drawdown_duration", "n_periods", "periods_per_year"], FIELDS)


def comparison(spark, sf):
    return M.compare_strategies(M.performance(aligned(spark, sf), bench="bench", periods_per_year=12))


def yearly(spark, sf):
    d = aligned(spark, sf).withColumn("bench", F.coalesce("bench", F.lit(0.0)))
    return rounded(M.yearly_returns(d, ["strategy"], ["ret", "bench"]), ["strategy", "year"], ["ret", "bench"])


def curve(spark, sf):
    d = M.drawdowns(returns(spark, sf), ["strategy"], "ret")
    return d.select("strategy", "date", F.col("underwater").cast("long").alias("underwater"), sig("ret").alias("ret"),
                    sig("cum").alias("cum"), sig("peak").alias("peak"), sig(F.round("drawdown", 9)).alias("drawdown"),
                    sig(F.round("max_drawdown_to_date", 9)).alias("max_drawdown_to_date"))


def rolling(spark, sf):
    d = M.rolling_stats(returns(spark, sf), ["strategy"], "ret", 3, 12)
    d = M.expanding_sharpe(d, ["strategy"], "ret")
    return rounded(d, ["strategy", "date"], ["rolling_mean", "rolling_sharpe", "rolling_return", "rolling_volatility", "sharpe_to_date"])


def sparse_index(spark, sf):
    """Trading days only on days of the month up to the 20th, so that month ends have no exact day."""
    return X.benchmark_daily(spark, sf).where(F.dayofmonth("date") <= 20)


def nearest(spark, sf):
    ends = X.benchmark_daily(spark, sf).select(F.last_day("date").alias("date")).distinct()
    return B.nearest_levels(ends, sparse_index(spark, sf)).select("date", sig("level").alias("level"))


def holding(spark, sf):
    ends = X.benchmark_daily(spark, sf).select(F.last_day("date").alias("date")).distinct()
    return rounded(B.holding_returns(ends, sparse_index(spark, sf), 12), ["date"], ["index_return"])


def cumulative(spark, sf):
    return rounded(B.cumulative_returns(X.benchmark_daily(spark, sf)), ["date"], ["cum_return"])


def months(spark, sf):
    return rounded(B.resampled_returns(X.benchmark_daily(spark, sf)), ["period_end"], ["ret"])


def quarters(spark, sf):
    return rounded(B.resampled_returns(X.benchmark_daily(spark, sf), "quarter"), ["period_end"], ["ret"])


def cover(spark, sf):
    return B.coverage(B.in_range(X.benchmark_daily(spark, sf), "1996-01-01", "2000-12-31"), "1996-02-01", "2000-12-01")


RET = {
    "returns": """SELECT c.sector AS strategy, public_date AS date, round(avg(least(greatest("1mo_return", -0.3), 0.35)), 9) AS ret
  FROM bars b JOIN companies c ON b.TICKER = c.ticker WHERE "1mo_return" IS NOT NULL GROUP BY 1, 2""",
    "index_m": """SELECT date, level / lag(level) OVER (ORDER BY date) - 1 AS bench FROM (SELECT last_day(date) AS date,
  arg_max(level, date) AS level FROM benchmark_daily GROUP BY 1)""",
    "aligned": "SELECT r.*, i.bench FROM returns r LEFT JOIN index_m i ON r.date = i.date",
    "grown": "SELECT *, product(1 + ret) OVER w AS cum, row_number() OVER w AS rn FROM aligned WINDOW w AS (PARTITION BY strategy ORDER BY date)",
    "peaked": "SELECT *, max(cum) OVER (PARTITION BY strategy ORDER BY date) AS peak FROM grown",
    "dips": """SELECT *, (cum - peak) / peak AS dd, rn - coalesce(max(CASE WHEN cum >= peak THEN rn END) OVER
  (PARTITION BY strategy ORDER BY date), 0) AS under FROM peaked""",
    "stats": """SELECT strategy, count(*) AS n, product(1 + ret) - 1 AS total, avg(ret) AS mean, max(ret) AS best, min(ret) AS worst,
  stddev_samp(ret) * sqrt(12) AS vol, CASE WHEN count(*) FILTER (ret < 0) > 0 THEN stddev_samp(ret) FILTER (ret < 0) * sqrt(12) ELSE 0 END AS down,
  abs(min(dd)) AS mdd, max(under) AS dur, covar_samp(ret, bench) / var_samp(bench) FILTER (ret IS NOT NULL) AS beta,
  product(1 + bench) - 1 AS btotal, count(bench) AS nb, stddev_samp(ret - bench) * sqrt(12) AS te, avg(ret - bench) * 12 AS gap,
  avg((ret > bench)::INT) AS wins FROM dips GROUP BY 1""",
    "yearsd": "SELECT *, pow(1 + total, 12.0 / n) - 1 AS ann, pow(1 + btotal, 12.0 / nb) - 1 AS bann FROM stats",
    "perf": """SELECT strategy, dur AS max_drawdown_duration, n AS n_periods, 12 AS periods_per_year, total AS total_return,
  ann AS annualized_return, mean AS avg_period_return, best AS best_period, worst AS worst_period, vol AS volatility,
  down AS downside_deviation, mdd AS max_drawdown, CASE WHEN vol > 0 THEN (ann - 0.02) / vol ELSE 0 END AS sharpe_ratio,
  CASE WHEN down > 0 THEN (ann - 0.02) / down ELSE 0 END AS sortino_ratio, CASE WHEN mdd > 0 THEN ann / mdd ELSE 0 END AS calmar_ratio,
  CASE WHEN te > 0 THEN gap / te ELSE 0 END AS information_ratio, ann - 0.02 - beta * (bann - 0.02) AS alpha, beta,
  te AS tracking_error, ann - bann AS excess_return, wins AS win_rate FROM yearsd""",
}
RET_NAMES = [*BARS_NAMES, "companies", "benchmark_daily", "returns", "index_m", "aligned"]
CURVE_NAMES = [*RET_NAMES, "grown", "peaked", "dips"]
PERF_NAMES = [*CURVE_NAMES, "stats", "yearsd", "perf"]
NEAR = {
    "ends": "SELECT DISTINCT last_day(date) AS date FROM benchmark_daily",
    "sparse": "SELECT * FROM benchmark_daily WHERE day(date) <= 20",
}


def near_sql(at: str) -> str:
    return f"(SELECT s.level FROM sparse s ORDER BY abs(date_diff('day', s.date, {at})), s.date DESC LIMIT 1)"


def sql(names, select):
    return with_sql(names, select, {**all_ctes(), **RET, **NEAR})


QUERIES = {
    "a31_performance": (performance, sql(PERF_NAMES, "SELECT " + rounded_sql(
        ["strategy", "max_drawdown_duration", "n_periods", "periods_per_year"], FIELDS) + " FROM perf")),
    "a32_strategy_comparison": (comparison, sql(PERF_NAMES, """SELECT strategy, round(total_return * 100, 1) AS total_return_pct,
  round(annualized_return * 100, 1) AS annual_return_pct, round(volatility * 100, 1) AS volatility_pct, round(sharpe_ratio, 2) AS sharpe,
  round(max_drawdown * 100, 1) AS max_drawdown_pct, round(win_rate * 100, 0) AS win_rate_pct FROM perf""")),
    "a18_yearly_returns": (yearly, sql(RET_NAMES, f"""SELECT strategy, year(date)::INT AS year, {sig_sql('product(1 + ret) - 1')} AS ret,
  {sig_sql('product(1 + coalesce(bench, 0)) - 1')} AS bench FROM aligned GROUP BY 1, 2""")),
    "w11_w12_w13_drawdowns": (curve, sql(CURVE_NAMES, f"""SELECT strategy, date, under AS underwater, {sig_sql('ret')} AS ret, {sig_sql('cum')} AS cum,
  {sig_sql('peak')} AS peak, {sig_sql('round(dd, 9)')} AS drawdown,
  {sig_sql('round(min(dd) OVER (PARTITION BY strategy ORDER BY date), 9)')} AS max_drawdown_to_date FROM dips""")),
    "w14_w15_rolling": (rolling, sql(RET_NAMES, "SELECT strategy, date, " + ", ".join(f"{sig_sql(e)} AS {n}" for n, e in {
        "rolling_mean": "avg(ret) OVER w3", "rolling_sharpe": "CASE WHEN count(ret) OVER w3 >= 2 THEN CASE WHEN stddev_samp(ret) OVER w3 > 0 "
        "THEN avg(ret) OVER w3 / stddev_samp(ret) OVER w3 ELSE 0 END END",
        "rolling_return": "CASE WHEN count(ret) OVER w3 = 3 THEN avg(ret) OVER w3 * 3 END",
        "rolling_volatility": "CASE WHEN count(ret) OVER w3 = 3 THEN stddev_samp(ret) OVER w3 * sqrt(12) END",
        "sharpe_to_date": "CASE WHEN stddev_samp(ret) OVER w > 0 THEN avg(ret) OVER w / stddev_samp(ret) OVER w ELSE 0 END"}.items())
        + " FROM aligned WINDOW w AS (PARTITION BY strategy ORDER BY date), w3 AS (PARTITION BY strategy ORDER BY date ROWS 2 PRECEDING)")),
    "j12_nearest_levels": (nearest, sql(["benchmark_daily", "ends", "sparse"],
                                        f"SELECT date, {sig_sql(near_sql('e.date'))} AS level FROM ends e")),
    "j19_b4_holding_returns": (holding, sql(
        ["benchmark_daily", "ends", "sparse"], f"""SELECT date, {sig_sql('(b - a) / a')} AS index_return FROM (SELECT date,
  {near_sql('e.date')} AS a, {near_sql('CAST(e.date + INTERVAL 12 MONTH AS DATE)')} AS b FROM ends e)""")),
    "w19_cumulative_index": (cumulative, sql(["benchmark_daily"],
        f"SELECT date, {sig_sql('level / first_value(level) OVER (ORDER BY date) - 1')} AS cum_return FROM benchmark_daily")),
    "a23_monthly_index": (months, sql(["benchmark_daily", "index_m"],
        f"SELECT date AS period_end, {sig_sql('bench')} AS ret FROM index_m WHERE bench IS NOT NULL")),
    "a23_quarterly_index": (quarters, sql(["benchmark_daily"], f"""SELECT period_end, ret FROM (SELECT period_end,
  {sig_sql('level / lag(level) OVER (ORDER BY period_end) - 1')} AS ret FROM (SELECT CAST(date_trunc('quarter', date) + INTERVAL 3 MONTH AS DATE) - 1
  AS period_end, arg_max(level, date) AS level FROM benchmark_daily GROUP BY 1)) WHERE ret IS NOT NULL""")),
    "s11_index_coverage": (cover, sql(["benchmark_daily"], """SELECT min(date) AS first_day, max(date) AS last_day, count(*) AS n_days,
  min(date) <= DATE '1996-02-01' AND max(date) >= DATE '2000-12-01' AS covers FROM benchmark_daily
  WHERE date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'""")),
}
