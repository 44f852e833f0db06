"""Data-quality and vendor-comparison queries and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as C
from .. import fixtures as X
from ..fixtures import sig, sig_sql, with_sql
from ..plans import compare as V
from ..plans import panel as P
from ..plans import quality as Q
from ..session import materialize
from .panel import RATED_NAMES, all_ctes, q, rounded, rounded_sql

COLUMNS = ["TICKER", "public_date", "MthPrc", "MthCap", "1mo_return", "3mo_return", "1yr_return", "roe", "roa", "ptb", "de_ratio", "bm"]
_STORED: dict = {}


def rated(spark, sf):
    key = (spark.sparkContext.applicationId, sf)
    if key not in _STORED:
        _STORED[key] = materialize(P.merge_and_rate(X.tables(spark, sf, macro=False), X.TIES).select(*COLUMNS))
    return _STORED[key]


def checks(spark, sf):
    d = Q.validate_panel(rated(spark, sf))
    return d.select("check", "severity", "n", sig("rate").alias("rate"), "raised")


def verdicts(spark, sf):
    d = Q.validate_panel(rated(spark, sf))
    a, b = Q.verdict(d), Q.verdict(d, strict=True)
    return a.withColumn("mode", F.lit("normal")).unionByName(b.withColumn("mode", F.lit("strict")))


def duplicates(spark, sf):
    d = X.prices(spark, sf).select(F.col("ticker").alias("TICKER"), F.col("date").alias("public_date"))
    return Q.duplicate_check(d).select("check", "severity", "n", sig("rate").alias("rate"), "raised")


def breaks(spark, sf):
    d = X.read(spark, sf, "orders").select(F.concat(F.lit("C"), "o_custkey").alias("TICKER"), F.col("o_orderdate").cast("date").alias("public_date"),
                                            F.col("o_orderkey").alias("seq"))
    return Q.order_breaks(d, "seq", width=1000)


def compliance(spark, sf):
    d = rated(spark, sf).withColumn("outcome_date", F.when(F.month("public_date") == 5, F.col("public_date")).otherwise(F.add_months("public_date", 12)))
    return Q.pit_compliance(d)


def summary(spark, sf):
    return Q.shape(rated(spark, sf))


def nulls(spark, sf):
    return rounded(Q.null_shares(rated(spark, sf)), ["column"], ["missing_share"])


def null_totals(spark, sf):
    return Q.null_summary(Q.null_shares(rated(spark, sf))).select(sig("mean_missing_rate").alias("mean_missing_rate"), "cols_over_half", "cols_complete")


def sector_counts(spark, sf):
    return Q.value_counts(P.add_sectors(rated(spark, sf), X.sectors(spark, sf)), "sector")


def cap_counts(spark, sf):
    return Q.value_counts(P.add_cap_buckets(rated(spark, sf), False), "cap")


def stats(spark, sf):
    return rounded(Q.return_stats(rated(spark, sf)), [], ["mean", "std", "min", "max", "valid_share"])


def vendor_b_fundamentals(spark, sf):
    """Second vendor: other revenue scale for a third of the tickers, some tickers missing."""
    d = X.fundamentals(spark, sf)
    n = F.substring("ticker", 2, 20).cast("long")
    return d.where(n % 4 != 0).withColumn("revenue", F.when(n % 3 == 0, F.col("revenue") * 1.3).otherwise(F.col("revenue") * 1.01)).withColumn(
        "net_income", F.col("net_income") * F.when(n % 2 == 0, -1.0).otherwise(1.0))


def daily(df):
    return df.groupBy("ticker", "date").agg(F.avg("adj_close").alias("adj_close"))


def a_days(spark, sf):
    return daily(X.prices(spark, sf))


def b_days(spark, sf):
    return daily(X.vendor_b_prices(spark, sf))


def overlap(spark, sf):
    return V.overlap(X.fundamentals(spark, sf), vendor_b_fundamentals(spark, sf)).select("n_a", "n_b", "n_both", sig("overlap_pct").alias("overlap_pct"))


def common(spark, sf):
    return V.common_tickers(X.fundamentals(spark, sf), vendor_b_fundamentals(spark, sf))


def latest(spark, sf):
    return rounded(V.latest(X.fundamentals(spark, sf), V.METRICS, ties=["fiscal_year", "fiscal_period"]), ["ticker"], V.METRICS)


def metric_agreement(spark, sf):
    return V.compare_fundamentals(X.fundamentals(spark, sf), vendor_b_fundamentals(spark, sf), [*V.METRICS, "headcount"])


def price_agreement(spark, sf):
    return rounded(V.price_correlations(a_days(spark, sf), b_days(spark, sf)), ["ticker", "n_days"], ["correlation"])


def price_summary(spark, sf):
    return V.compare_prices(a_days(spark, sf), b_days(spark, sf))


def covered(spark, sf):
    return V.coverage({"A": X.prices(spark, sf), "B": X.vendor_b_prices(spark, sf)}, "date")


def advice(spark, sf):
    a, b = X.fundamentals(spark, sf), vendor_b_fundamentals(spark, sf)
    return V.recommendation(V.compare_fundamentals(a, b), V.compare_prices(a_days(spark, sf), b_days(spark, sf)), V.overlap(a, b))


# --- oracle side ----------------------------------------------------------------------------------------------

def sql(names, select, extra=None):
    return with_sql(names, select, {**all_ctes(), **VB, **(extra or {})})


PAN = {"pan": "SELECT " + ", ".join(q(c) for c in COLUMNS) + " FROM rated"}
PAN_NAMES = [*RATED_NAMES, "pan"]
VB = {
    **PAN,
    "b_fund": """SELECT * REPLACE (revenue * CASE WHEN CAST(ticker[2:] AS INT) % 3 = 0 THEN 1.3 ELSE 1.01 END AS revenue,
  net_income * CASE WHEN CAST(ticker[2:] AS INT) % 2 = 0 THEN -1 ELSE 1 END AS net_income) FROM merged WHERE CAST(ticker[2:] AS INT) % 4 <> 0""",
    "a_day": "SELECT ticker, date, avg(adj_close) AS p FROM prices GROUP BY 1, 2",
    "b_day": "SELECT ticker, date, avg(adj_close * (1 + l_tax)) AS p FROM prices WHERE l_linestatus = 'F' GROUP BY 1, 2",
    "pair": """SELECT a.ticker, count(*) AS n_days, corr(a.p, b.p) AS correlation FROM a_day a JOIN b_day b ON a.ticker = b.ticker AND a.date = b.date
  GROUP BY 1 HAVING count(*) >= 10""",
    **{f"last_{v}": "SELECT ticker, " + ", ".join(f"arg_max({m}, publish_date) FILTER ({m} IS NOT NULL) AS {m}" for m in V.METRICS)
       + f" FROM {t} GROUP BY 1" for v, t in (("a", "merged"), ("b", "b_fund"))},
    "agree": " UNION ALL ".join(f"""SELECT '{m}' AS metric, count(*) AS n, corr(a.{m}, b.{m}) AS r, avg(abs(a.{m} - b.{m}) / nullif((abs(a.{m}) + abs(b.{m})) / 2, 0)) AS e,
  avg((coalesce(abs(a.{m} - b.{m}) / nullif((abs(a.{m}) + abs(b.{m})) / 2, 0), 1) < 0.1)::INT) AS h FROM last_a a JOIN last_b b ON a.ticker = b.ticker
  WHERE a.{m} IS NOT NULL AND b.{m} IS NOT NULL""" for m in V.METRICS),
}
STATEMENTS = ["income", "balance", "cashflow", "merged"]
AGREE = [*STATEMENTS, "b_fund", "last_a", "last_b", "agree"]
DAYS = ["prices", "a_day", "b_day", "pair"]


def check_sql() -> str:
    rows = [("negative price", "issue", "MthPrc < 0"), ("penny price", "warning", "MthPrc < 1"), ("cap not positive", "issue", "MthCap <= 0"),
            ("extreme return", "warning", '"1yr_return" < -0.99 OR "1yr_return" > 10')]
    parts = [f"SELECT '{n}' AS \"check\", '{s}' AS severity, count(*) FILTER ({c}) AS n, {sig_sql(f'count(*) FILTER ({c}) / count(*)')} AS rate, count(*) FILTER ({c}) > 0 AS raised FROM pan"
             for n, s, c in rows]
    for name, c, limit in [("missing target", '"1yr_return"', 0.5), *[(f"missing {x}", x, 0.7) for x in Q.CRITICAL]]:
        parts.append(f"SELECT '{name}', 'warning', count(*) - count({c}), {sig_sql(f'1 - count({c}) / count(*)')}, 1 - count({c}) / count(*) > {limit} FROM pan")
    cells = " + ".join(f"(count(*) - count({q(c)}))" for c in COLUMNS)
    parts.append(f"SELECT 'missing cells', 'warning', {cells}, {sig_sql(f'({cells}) / (count(*) * {len(COLUMNS)})')}, ({cells}) / (count(*) * {len(COLUMNS)}) > 0.3 FROM pan")
    parts.append(f"SELECT 'duplicate keys', 'warning', count(*) - count(DISTINCT (TICKER, public_date)), {sig_sql('(count(*) - count(DISTINCT (TICKER, public_date))) / count(*)')}, "
                 "count(*) > count(DISTINCT (TICKER, public_date)) FROM pan")
    fixed = [(f"missing column {c}", "issue", 0, "NULL", "false") for c in Q.REQUIRED] + [("type public_date", "issue", 0, "NULL", "false")]
    fixed += [(f"type {c}", "issue", 0, "NULL", "false") for c in ("MthPrc", "MthCap", "1yr_return")]
    for category, names in C.FEATURE_CATEGORIES.items():
        have = sum(n in COLUMNS for n in names)
        fixed.append((f"features {category}", "warning", have, repr(have / len(names)), "true" if have < len(names) / 2 else "false"))
    parts += [f"SELECT '{n}', '{s}', {k}, {'CAST(NULL AS DOUBLE)' if r == 'NULL' else sig_sql(r)}, {u}" for n, s, k, r, u in fixed]
    return " UNION ALL ".join(parts)


QUERIES = {
    "d1_d5_panel_checks": (checks, sql(PAN_NAMES, check_sql())),
    "d7_verdict": (verdicts, sql([*PAN_NAMES, "chk"], """SELECT *, n_issues = 0 AS is_valid, 'normal' AS mode FROM (SELECT count(*) FILTER (raised AND severity = 'issue') AS n_issues,
  count(*) FILTER (raised AND severity = 'warning') AS n_warnings FROM chk) UNION ALL SELECT *, n_issues + n_warnings = 0, 'strict' FROM (SELECT count(*) FILTER (raised AND severity = 'issue') AS n_issues,
  count(*) FILTER (raised AND severity = 'warning') AS n_warnings FROM chk)""", {"chk": check_sql()})),
    "d4_a11_duplicates": (duplicates, with_sql(["prices"], f"""SELECT 'duplicate keys' AS "check", 'warning' AS severity, count(*) - count(DISTINCT (ticker, date)) AS n,
  {sig_sql('(count(*) - count(DISTINCT (ticker, date))) / count(*)')} AS rate, count(*) > count(DISTINCT (ticker, date)) AS raised FROM prices""")),
    "d4_w17_date_order": (breaks, """SELECT 'C' || o_custkey AS TICKER, count(*) FILTER (prev > d) AS breaks FROM (SELECT o_custkey, CAST(o_orderdate AS DATE) AS d,
  lag(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev FROM orders) GROUP BY 1"""),
    "d6_pit_compliance": (compliance, sql(PAN_NAMES, """SELECT count(*) AS n_rows, count(*) FILTER (o <= public_date) AS violations,
  count(*) FILTER (date_diff('day', public_date, o) NOT BETWEEN 335 AND 395) AS odd_periods, count(*) FILTER (o <= public_date) = 0
  AND count(*) FILTER (date_diff('day', public_date, o) NOT BETWEEN 335 AND 395) <= count(*) * 0.1 AS is_compliant FROM (SELECT *, CASE WHEN month(public_date) = 5 THEN public_date
  ELSE CAST(public_date + INTERVAL 12 MONTH AS DATE) END AS o FROM pan)""")),
    "d8_a5_shape": (summary, sql(PAN_NAMES, """SELECT count(*) AS n_rows, count(DISTINCT TICKER) AS n_tickers, count(DISTINCT public_date) AS n_months,
  min(public_date) AS first_date, max(public_date) AS last_date FROM pan""")),
    "d3_a10_null_shares": (nulls, sql(PAN_NAMES, " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {sig_sql(f'1 - count({q(c)}) / count(*)')} AS missing_share FROM pan" for c in COLUMNS))),
    "d8_a10_null_summary": (null_totals, sql([*PAN_NAMES, "ns"], f"SELECT {sig_sql('avg(m)')} AS mean_missing_rate, count(*) FILTER (m > 0.5) AS cols_over_half, count(*) FILTER (m = 0) AS cols_complete FROM ns",
        {"ns": " UNION ALL ".join(f"SELECT 1 - count({q(c)}) / count(*) AS m FROM pan" for c in COLUMNS)})),
    "a12_sector_counts": (sector_counts, sql([*PAN_NAMES, "companies"], "SELECT c.sector, count(*) AS n FROM pan p JOIN companies c ON p.TICKER = c.ticker WHERE c.sector <> 'Financial Services' GROUP BY 1")),
    "a12_cap_counts": (cap_counts, sql(PAN_NAMES, """SELECT CASE WHEN MthCap < 50e6 THEN 'Nano Cap' WHEN MthCap < 300e6 THEN 'Micro Cap' WHEN MthCap < 2e9 THEN 'Small Cap'
  WHEN MthCap < 10e9 THEN 'Mid Cap' WHEN MthCap < 200e9 THEN 'Large Cap' ELSE 'Mega Cap' END AS cap, count(*) AS n FROM pan WHERE MthCap IS NOT NULL GROUP BY 1""")),
    "a13_return_stats": (stats, sql(PAN_NAMES, "SELECT " + rounded_sql([], ["mean", "std", "min", "max", "valid_share"]) + """ FROM (SELECT avg("1yr_return") AS mean, stddev_samp("1yr_return") AS std,
  min("1yr_return") AS min, max("1yr_return") AS max, count("1yr_return") / count(*) AS valid_share FROM pan)""")),
    "j17_overlap": (overlap, sql([*STATEMENTS, "b_fund"], f"""SELECT n_a, n_b, n_both, {sig_sql('n_both / n_a * 100')} AS overlap_pct FROM (SELECT (SELECT count(DISTINCT ticker) FROM merged) AS n_a,
  (SELECT count(DISTINCT ticker) FROM b_fund) AS n_b, (SELECT count(DISTINCT m.ticker) FROM merged m WHERE EXISTS (SELECT 1 FROM b_fund b WHERE b.ticker = m.ticker)) AS n_both)""")),
    "u1_common_tickers": (common, sql([*STATEMENTS, "b_fund"], "SELECT ticker FROM merged INTERSECT SELECT ticker FROM b_fund")),
    "a6_latest_values": (latest, sql([*STATEMENTS, "last_a"], f"SELECT {rounded_sql(['ticker'], V.METRICS)} FROM last_a")),
    "d9_j10_a7_metric_agreement": (metric_agreement, sql(AGREE, """SELECT metric, CASE WHEN n >= 2 THEN 'compared' ELSE 'insufficient_data' END AS status, n AS n_compared, round(r, 4) AS correlation,
  round(e * 100, 2) AS mape_pct, round(h * 100, 2) AS match_rate_10pct FROM agree UNION ALL SELECT 'headcount', 'missing_column', 0, NULL, NULL, NULL""")),
    "j11_a8_price_correlations": (price_agreement, sql(DAYS, f"SELECT ticker, n_days, {sig_sql('correlation')} AS correlation FROM pair")),
    "d10_price_agreement": (price_summary, sql(DAYS, """SELECT count(*) AS tickers_compared, round(avg(correlation), 4) AS mean_correlation, round(min(correlation), 4) AS min_correlation,
  round(max(correlation), 4) AS max_correlation FROM pair""")),
    "a9_coverage": (covered, with_sql(["prices"], """SELECT 'A' AS source, count(DISTINCT ticker) AS n_tickers, count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date FROM prices
  UNION ALL SELECT 'B', count(DISTINCT ticker), count(*), min(date), max(date) FROM prices WHERE l_linestatus = 'F'""")),
    "d11_recommendation": (advice, sql([*AGREE, *DAYS, "found"], """SELECT CASE WHEN low IS NULL AND pr >= 0.99 AND op >= 80 THEN 'Both data sources appear consistent. Either can be used.'
  ELSE 'Review needed: ' || concat_ws('; ', 'Low correlation for: ' || low, CASE WHEN pr < 0.99 THEN printf('Price correlation is %.2f%%', pr * 100) END,
  CASE WHEN op < 80 THEN printf('Only %.1f%% ticker overlap', op) END) END AS recommendation FROM found""",
        {"found": """SELECT (SELECT string_agg(metric, ', ' ORDER BY metric) FROM agree WHERE round(r, 4) < 0.9) AS low, (SELECT round(avg(correlation), 4) FROM pair) AS pr,
  (SELECT count(DISTINCT ticker) FROM b_fund) / (SELECT count(DISTINCT ticker) FROM merged) * 100 AS op"""})),
}
