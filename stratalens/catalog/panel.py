"""Panel queries and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from .. import schemas as S
from ..fixtures import sig, sig_sql, with_sql
from ..functions import columns as K
from ..functions.ratios import (AMOUNTS, BASIC_RATIOS, ratio_texts, ratio_names, with_averages, with_basic_ratios,
                                with_previous)
from ..operators.asof import asof_join
from ..operators.winsor import mad_bounds, winsorize
from ..plans import panel as P
from ..session import materialize

HORIZONS = {"1mo_return": 1, "3mo_return": 3, "6mo_return": 6, "1yr_return": 12}
TIE_DESC = "date DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_extendedprice DESC, l_quantity DESC"


def q(name: str) -> str:
    return f'"{name}"'


def bars_ctes(source: str) -> dict[str, str]:
    ahead = ",\n".join(
        f"CASE WHEN m1.MthPrc > 0 THEN (f{n}.MthPrc - m1.MthPrc) / (m1.MthPrc + 1e-12) END AS {q(c)}"
        for c, n in HORIZONS.items())
    joins = "\n".join(
        f"LEFT JOIN m0 f{n} ON f{n}.TICKER = m1.TICKER AND f{n}.public_date = last_day(m1.public_date + INTERVAL {n} MONTH)"
        for n in HORIZONS.values())
    return {
        "month_rows": f"""SELECT *, last_day(date) AS public_date,
  row_number() OVER (PARTITION BY ticker, last_day(date) ORDER BY {TIE_DESC}) AS rn FROM {source}""",
        "m0": """SELECT r.ticker AS TICKER, r.public_date, r.id AS gvkey, r.adj_close AS MthPrc, r.shares, d.div_m
  FROM month_rows r JOIN (SELECT ticker, public_date, sum(dividend) AS div_m FROM month_rows GROUP BY 1, 2) d
  ON r.ticker = d.ticker AND r.public_date = d.public_date WHERE rn = 1""",
        "m1": """SELECT TICKER, public_date, gvkey, MthPrc,
  last_value(shares IGNORE NULLS) OVER (PARTITION BY TICKER ORDER BY public_date ROWS UNBOUNDED PRECEDING) AS shares,
  sum(div_m) OVER (PARTITION BY TICKER ORDER BY public_date ROWS 11 PRECEDING) AS Div_ttm FROM m0""",
        "bars": f"""SELECT m1.TICKER, m1.gvkey, m1.public_date, m1.MthPrc, m1.shares, m1.Div_ttm,
  m1.MthPrc * m1.shares AS MthCap, CASE WHEN m1.MthPrc > 0 THEN coalesce(m1.Div_ttm, 0) / m1.MthPrc END AS divyield,
  {ahead} FROM m1 {joins}""",
    }


FUND = {
    "merged": """SELECT * FROM income FULL JOIN balance USING (ticker, fiscal_year, fiscal_period, publish_date)
  FULL JOIN cashflow USING (ticker, fiscal_year, fiscal_period, publish_date)""",
    "fund": "SELECT *, coalesce(short_term_debt, 0) + coalesce(long_term_debt, 0) AS total_debt,\n" + ",\n".join(
        f"CASE WHEN count({i}) OVER w = 4 THEN sum({i}) OVER w END AS {i}_ttm" for i in S.FLOW_ITEMS)
    + " FROM merged WINDOW w AS (PARTITION BY ticker ORDER BY fiscal_year, fiscal_period, publish_date ROWS 3 PRECEDING)",
}
FUND_NAMES = ["income", "balance", "cashflow", "merged", "fund"]
BARS_NAMES = ["prices", "month_rows", "m0", "m1", "bars"]
FUND_COLS = [*S.KEYS[1:], *S.INCOME_ITEMS, *S.BALANCE_ITEMS, *S.CASHFLOW_ITEMS, "total_debt",
             *[f"{i}_ttm" for i in S.FLOW_ITEMS]]
PIT = {
    "pit": "SELECT b.*, " + ", ".join(f"f.{c}" for c in FUND_COLS) + """
  FROM bars b ASOF LEFT JOIN (SELECT *, CAST(publish_date + INTERVAL 1 MONTH AS DATE) AS known_from FROM fund) f
  ON b.TICKER = f.ticker AND b.public_date > f.known_from""",
    "prev": "SELECT *, " + ", ".join(
        f"lag({i}) OVER (PARTITION BY TICKER ORDER BY public_date) AS {i}_prev" for i in S.AVERAGED_ITEMS) + " FROM pit",
}
PIT_NAMES = [*BARS_NAMES, *FUND_NAMES, "pit", "prev"]

# Ratio formulas once more, as SQL text: the oracle side of the ratio library.
RATIO_SQL = {
    "bm": "total_equity / (MthCap + e)", "ptb": "(MthCap + e) / (total_equity + e)",
    "ps": "(MthCap + e) / (revenue_ttm + e)", "pcf": "(MthCap + e) / (operating_cash_ttm + e)",
    "npm": "net_income_ttm / (revenue_ttm + e)", "gpm": "gross_profit_ttm / (revenue_ttm + e)",
    "roa": "net_income_ttm / (total_assets + e)", "roe": "net_income_ttm / (total_equity + e)",
    "aftret_eq": "net_income_ttm / ((total_equity + total_equity_prev) / 2 + e)",
    "aftret_equity": "net_income_ttm / ((total_equity + total_equity_prev) / 2 + e)",
    "EBIT_ttm": "operating_income_ttm", "EBITDA_ttm": "operating_income_ttm + depreciation_ttm",
    "roce": "operating_income_ttm / (total_assets - current_liabilities + e)",
    "pretret_noa": "operating_income_ttm / ((total_assets - current_liabilities + total_assets_prev"
                   " - current_liabilities_prev) / 2 + e)",
    "cash": "cash_items", "EV": "MthCap + total_debt - coalesce(cash_items, 0)",
    "evm": "(MthCap + total_debt - coalesce(cash_items, 0)) / (operating_income_ttm + depreciation_ttm + e)",
    "debt_ebitda": "total_debt / (operating_income_ttm + depreciation_ttm + e)",
    "pe_inc": "MthCap / (net_income_ttm + e)", "pe_exi": "MthCap / (net_income_common_ttm + e)",
    "pe_op_basic": "MthCap / (operating_income_ttm + e)", "pe_op_dil": "MthCap / (operating_income_ttm + e)",
    "opmbd": "operating_income_ttm / (revenue_ttm + e)",
    "opmad": "(operating_income_ttm + depreciation_ttm) / (revenue_ttm + e)",
    "ptpm": "pretax_income_ttm / (revenue_ttm + e)", "cfm": "operating_cash_ttm / (revenue_ttm + e)",
    "dpr": "-coalesce(dividends_paid_ttm, 0) / (net_income_ttm + e)", "de_ratio": "total_debt / (total_equity + e)",
    "capital_ratio": "total_equity / (total_assets + e)", "debt_at": "total_debt / (total_assets + e)",
    "debt_assets": "total_debt / (total_assets + e)", "debt_capital": "total_debt / (total_debt + total_equity + e)",
    "dltt_be": "long_term_debt / (total_equity + e)",
    "intcov": "operating_income_ttm / (abs(interest_expense_ttm) + e)",
    "intcov_ratio": "operating_income_ttm / (abs(interest_expense_ttm) + e)",
    "int_debt": "abs(interest_expense_ttm) / (total_debt + e)",
    "int_totdebt": "abs(interest_expense_ttm) / (total_debt + e)",
    "curr_ratio": "current_assets / (current_liabilities + e)",
    "quick_ratio": "(current_assets - inventories) / (current_liabilities + e)",
    "cash_ratio": "cash_items / (current_liabilities + e)", "cash_conversion": "operating_cash_ttm / (net_income_ttm + e)",
    "cash_lt": "cash_items / (total_assets + e)", "invt_act": "inventories / (current_assets + e)",
    "rect_act": "receivables / (current_assets + e)", "short_debt": "short_term_debt / (total_debt + e)",
    "curr_debt": "short_term_debt / (total_debt + e)", "lt_debt": "long_term_debt / (total_debt + e)",
    "profit_lct": "net_income_ttm / (current_liabilities + e)", "ocf_lct": "operating_cash_ttm / (current_liabilities + e)",
    "cash_debt": "cash_items / (total_debt + e)",
    "capex_ttm": "CASE WHEN fixed_asset_change_ttm > 0 THEN 0 ELSE -fixed_asset_change_ttm END",
    "fcf_ttm": "operating_cash_ttm - CASE WHEN fixed_asset_change_ttm > 0 THEN 0 ELSE -fixed_asset_change_ttm END",
    "fcf_ocf": "(operating_cash_ttm - CASE WHEN fixed_asset_change_ttm > 0 THEN 0 ELSE -fixed_asset_change_ttm END)"
               " / (operating_cash_ttm + e)",
    "at_turn": "revenue_ttm / ((total_assets + total_assets_prev) / 2 + e)",
    "inv_turn": "cost_of_revenue_ttm / ((inventories + inventories_prev) / 2 + e)",
    "rect_turn": "revenue_ttm / ((receivables + receivables_prev) / 2 + e)",
    "pay_turn": "cost_of_revenue_ttm / ((payables + payables_prev) / 2 + e)",
    "invcap": "total_equity + total_debt - coalesce(cash_items, 0)",
    "sale_invcap": "revenue_ttm / (total_equity + total_debt - coalesce(cash_items, 0) + e)",
    "sale_equity": "revenue_ttm / (total_equity + e)", "sale_nwc": "revenue_ttm / (current_assets - current_liabilities + e)",
    "accrual": "(net_income_ttm - operating_cash_ttm) / (total_assets + e)",
    "GProf": "gross_profit_ttm / (total_assets + e)", "rd_sale": "research_ttm / (revenue_ttm + e)",
    "lt_ppent": "ppe / (total_assets + e)", "efftax": "income_tax_ttm / (pretax_income_ttm + e)",
}
RATED = {
    "rated": "SELECT pit_e.*, " + ", ".join(f"{v} AS {q(k)}" for k, v in RATIO_SQL.items())
             + " FROM (SELECT *, 1e-12 AS e FROM prev) pit_e",
    "sectored": """SELECT r.*, coalesce(c.sector, 'Unknown') AS sector FROM rated r LEFT JOIN companies c
  ON r.TICKER = c.ticker WHERE NOT EXISTS (SELECT 1 FROM companies f WHERE f.ticker = r.TICKER AND f.sector = 'MIDDLE EAST')
  AND coalesce(c.sector, 'Unknown') <> 'Financial Services'""",
    "clean": "SELECT * FROM sectored WHERE MthPrc >= 1 AND MthCap >= 5e6 AND total_equity > 0 AND "
             + " AND ".join(f"({q(c)} IS NULL OR {q(c)} BETWEEN -0.99 AND 10)" for c in HORIZONS)
             + " AND (revenue_ttm IS NULL OR revenue_ttm > 0)",
    "capped": """SELECT p.*, CASE WHEN MthCap IS NULL THEN NULL WHEN MthCap < 50e6 * s THEN 'Nano Cap'
  WHEN MthCap < 300e6 * s THEN 'Micro Cap' WHEN MthCap < 2e9 * s THEN 'Small Cap' WHEN MthCap < 10e9 * s THEN 'Mid Cap'
  WHEN MthCap < 200e9 * s THEN 'Large Cap' ELSE 'Mega Cap' END AS cap
  FROM clean p JOIN (SELECT y, m / (SELECT median(MthCap) FROM clean WHERE year(public_date) = 2000) AS s
  FROM (SELECT year(public_date) AS y, median(MthCap) AS m FROM clean GROUP BY 1)) k ON year(p.public_date) = k.y""",
}
RATED_NAMES = [*PIT_NAMES, "rated"]
CLEAN_NAMES = [*RATED_NAMES, "companies", "sectored", "clean"]
CAPPED_NAMES = [*CLEAN_NAMES, "capped"]


def winsor_ctes(source: str, columns: list[str]) -> dict[str, str]:
    cols = ", ".join(q(c) for c in columns)
    clipped = ", ".join(
        f"CASE WHEN {q(c)} IS NULL THEN NULL ELSE least(greatest({q(c)}, coalesce((SELECT low FROM bounds WHERE feature = '{c}'),"
        f" {q(c)})), coalesce((SELECT high FROM bounds WHERE feature = '{c}'), {q(c)})) END AS {q(c)}" for c in columns)
    return {
        "longed": f"SELECT feature, value FROM (SELECT {cols} FROM {source}) UNPIVOT (value FOR feature IN ({cols}))",
        "mids": "SELECT feature, median(value) AS m FROM longed GROUP BY 1",
        "mads": "SELECT l.feature, any_value(m) AS m, median(abs(value - m)) AS d FROM longed l JOIN mids USING (feature) GROUP BY 1",
        "bounds": "SELECT feature, m AS median, d AS mad, CASE WHEN d > 0 THEN m - 5 * d END AS low,"
                  " CASE WHEN d > 0 THEN m + 5 * d END AS high FROM mads",
        "winsored": f"SELECT * REPLACE ({clipped}) FROM {source}",
    }


def all_ctes(source: str = "prices") -> dict[str, str]:
    return {**bars_ctes(source), **FUND, **PIT, **RATED, **winsor_ctes("capped", ratio_names())}


def sql(names, select, source="prices"):
    return with_sql(names, select, all_ctes(source))


MACRO = {
    "macro_wide": """SELECT date AS public_date, max(CASE WHEN indicator = 'F' THEN value END) AS F,
  max(CASE WHEN indicator = 'O' THEN value END) AS O, max(CASE WHEN indicator = 'P' THEN value END) AS P
  FROM macro_long GROUP BY 1""",
    "macro_lagged": """SELECT public_date, lag(F) OVER w AS F, lag(O) OVER w AS O, lag(P) OVER w AS P
  FROM macro_wide WINDOW w AS (ORDER BY public_date)""",
}

BAR_COLS = ["MthPrc", "shares", "Div_ttm", "MthCap", "divyield", *HORIZONS]


def rounded(df, keys, doubles):
    return df.select(*keys, *[sig(c).alias(c) for c in doubles])


def rounded_sql(keys, doubles):
    return ", ".join([*keys, *[f"{sig_sql(q(c))} AS {q(c)}" for c in doubles]])


# --- Spark sides ----------------------------------------------------------------------------------------------

def bars(spark, sf, sparse=False):
    return P.month_bars(X.prices(spark, sf, sparse), X.TIES)


def rated(spark, sf):
    return P.merge_and_rate(X.tables(spark, sf, macro=False), X.TIES)


def clean(spark, sf):
    t = X.tables(spark, sf, macro=False)
    return P.quality_filter(P.clean_returns(P.add_sectors(P.merge_and_rate(t, X.TIES), t.sectors, t.financials)))


_STORED: dict = {}


def stored_clean(spark, sf):
    """The filtered panel as a table, written once per session and folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _STORED:
        _STORED[key] = materialize(clean(spark, sf))
    return _STORED[key]


def panel(spark, sf, macro=True):
    return P.build_panel(X.tables(spark, sf, macro), ties=X.TIES, base_year=2000)


def month_rows(spark, sf):
    d = P.last_rows_of_month(X.prices(spark, sf), X.TIES)
    return rounded(d, ["TICKER", "public_date", "gvkey", "last_date"], ["MthPrc", "shares", "Div_m"])


def merged_statements(spark, sf):
    return rounded(X.fundamentals(spark, sf), S.KEYS, [*S.INCOME_ITEMS, *S.BALANCE_ITEMS, *S.CASHFLOW_ITEMS])


def fundamentals(spark, sf):
    return rounded(P.quarterly_fundamentals(X.fundamentals(spark, sf)), S.KEYS,
                   ["total_debt", *[f"{i}_ttm" for i in S.FLOW_ITEMS]])


def asof_strict(spark, sf):
    d = P.merge_point_in_time(bars(spark, sf), P.quarterly_fundamentals(X.fundamentals(spark, sf)))
    return rounded(d, ["TICKER", "public_date", "fiscal_year", "fiscal_period", "publish_date"],
                   ["revenue", "total_equity", "operating_cash", "net_income_ttm"])


def shares_table(spark, sf):
    return X.balance(spark, sf).select("ticker", F.col("publish_date").alias("date"),
                                       (F.col("current_liabilities") * 10).alias("shares"))


def asof_inclusive(spark, sf):
    days = X.prices(spark, sf).select("ticker", "date", *X.TIES)
    got = asof_join(days, shares_table(spark, sf).withColumnRenamed("date", "known"), ["ticker"], "date", "known",
                    ["known", "shares"], bucket=lambda d: F.trunc(d, "month"))
    return got.select("ticker", "date", "l_orderkey", "l_linenumber", "l_partkey", sig("l_extendedprice").alias("ep"),
                      "known", sig("shares").alias("shares"))


def bars_shares_asof(spark, sf):
    d = P.month_bars(X.prices(spark, sf), X.TIES, shares_table(spark, sf))
    return rounded(d, ["TICKER", "public_date"], ["MthPrc", "shares", "MthCap"])


def averages(spark, sf):
    d = with_averages(X.balance(spark, sf), "ticker", "publish_date")
    return rounded(d, ["ticker", "publish_date"], [f"{i}_avg" for i in S.AVERAGED_ITEMS])


def ratios(spark, sf):
    return rounded(rated(spark, sf), ["TICKER", "public_date"], list(ratio_texts()))


def basic_ratios(spark, sf):
    d = P.merge_point_in_time(bars(spark, sf), P.quarterly_fundamentals(X.fundamentals(spark, sf)))
    return rounded(with_basic_ratios(with_averages(d)), ["TICKER", "public_date"], list(BASIC_RATIOS))


def sectored(spark, sf):
    t = X.tables(spark, sf, macro=False)
    d = P.add_sectors(P.keep_domestic(bars(spark, sf)), t.sectors, t.financials)
    return rounded(d, ["TICKER", "public_date", "sector"], ["MthPrc"])


def finite_returns(spark, sf):
    d = bars(spark, sf).withColumn("1mo_return", F.when(F.month("public_date") == 1, F.lit(float("inf"))).otherwise(
        F.col("1mo_return")))
    return rounded(P.clean_returns(d), ["TICKER", "public_date"], list(HORIZONS))


def quality_report(spark, sf):
    t = X.tables(spark, sf, macro=False)
    return P.quality_report(P.add_sectors(P.merge_and_rate(t, X.TIES), t.sectors, t.financials))


def filtered(spark, sf):
    return rounded(clean(spark, sf), ["TICKER", "public_date", "sector"], ["MthPrc", "MthCap", "total_equity"])


def cap_medians(spark, sf):
    return P.cap_medians(bars(spark, sf)).select("year", sig("median_cap").alias("median_cap"))


def static_caps(spark, sf):
    return P.add_cap_buckets(bars(spark, sf), year_adjusted=False).select("TICKER", "public_date", "cap")


def year_caps(spark, sf):
    return P.add_cap_buckets(stored_clean(spark, sf), base_year=2000).select("TICKER", "public_date", "cap")


def bounds(spark, sf):
    d = mad_bounds(stored_clean(spark, sf), ratio_names())
    return rounded(d, ["feature"], ["median", "mad", "low", "high"])


def winsored(spark, sf):
    d = winsorize(stored_clean(spark, sf), ratio_names())
    return rounded(d, ["TICKER", "public_date"], ratio_names())


def winsored_per_date(spark, sf):
    d = winsorize(bars(spark, sf), ["MthPrc", "divyield"], 3.0, ["public_date"])
    return rounded(d, ["TICKER", "public_date"], ["MthPrc", "divyield"])


def macro_wide(spark, sf):
    return rounded(P.pivot_macro(X.macro_long(spark, sf), ["F", "O", "P"]), ["public_date"], ["F", "O", "P"])


def macro_lagged(spark, sf):
    return rounded(P.lag_macro(P.pivot_macro(X.macro_long(spark, sf), ["F", "O", "P"])), ["public_date"], ["F", "O", "P"])


MONTHS = {
    "seen": "SELECT last_day(date) AS public_date, arg_max(level, date) AS level FROM benchmark_daily WHERE month(date) <> 4 GROUP BY 1",
    "every": """SELECT last_day(m::DATE) AS public_date FROM (SELECT unnest(generate_series(date_trunc('month', min(public_date))::TIMESTAMP, max(public_date)::TIMESTAMP, INTERVAL 1 MONTH)) AS m FROM seen)""",
    "filled": "SELECT e.public_date, s.level, year(e.public_date) * 12 + month(e.public_date) AS n FROM every e ASOF LEFT JOIN seen s ON e.public_date >= s.public_date",
}


def macro_changes(spark, sf):
    daily = X.benchmark_daily(spark, sf).where(F.month("date") != 4)
    m = P.month_end_macro(daily, ["level"])
    m = P.add_changes(m, {"1mo_change": ("level", 1), "1yr_change": ("level", 12)})
    return rounded(m, ["public_date"], ["level", "1mo_change", "1yr_change"])


def macro_joined(spark, sf):
    d = P.add_macro(bars(spark, sf), P.pivot_macro(X.macro_long(spark, sf), ["F", "O", "P"]))
    return rounded(d, ["TICKER", "public_date"], ["MthPrc", "F", "O", "P"])


def macro_asof(spark, sf):
    wide = P.pivot_macro(X.macro_long(spark, sf), ["F", "O", "P"]).where(F.month("public_date").isin(3, 9))
    d = P.add_macro(bars(spark, sf), wide, 0, as_of=True)
    return rounded(d, ["TICKER", "public_date"], ["F", "O", "P"])


def full_panel(spark, sf):
    d = panel(spark, sf)
    return rounded(d, ["TICKER", "gvkey", "public_date", "fiscal_year", "fiscal_period", "sector", "cap"],
                   [*BAR_COLS, *ratio_names(), *AMOUNTS, "F", "O", "P"])


def forward_by_rows(spark, sf):
    from ..plans.features import forward_returns
    d = forward_returns(bars(spark, sf, sparse=True).select("TICKER", "public_date", "MthPrc"), 3)
    return rounded(d, ["TICKER", "public_date"], ["3mo_return"])


SHARES_SQL = ("SELECT ticker, publish_date AS known, current_liabilities * 10 AS shares FROM balance")
WIN_NAMES = [*CLEAN_NAMES, "longed", "mids", "mads", "bounds"]


def clean_sql(names, select):
    ctes = {**all_ctes(), **winsor_ctes("clean", ratio_names())}
    return with_sql(names, select, ctes)


QUERIES = {
    "a1_a2_month_rows": (month_rows, sql(
        BARS_NAMES[:2], "SELECT r.ticker AS TICKER, r.public_date, id AS gvkey, date AS last_date, "
        f"{sig_sql('adj_close')} AS MthPrc, {sig_sql('shares')} AS shares, {sig_sql('div_m')} AS Div_m FROM month_rows r JOIN "
        "(SELECT ticker, public_date, sum(dividend) AS div_m FROM month_rows GROUP BY 1, 2) d ON r.ticker = d.ticker "
        "AND r.public_date = d.public_date WHERE rn = 1")),
    "w1_w3_j5_p24_month_bars": (
        lambda s, sf: rounded(bars(s, sf), ["TICKER", "gvkey", "public_date"], BAR_COLS),
        sql(BARS_NAMES, f"SELECT {rounded_sql(['TICKER', 'gvkey', 'public_date'], BAR_COLS)} FROM bars")),
    "j5_forward_returns_gaps": (
        lambda s, sf: rounded(bars(s, sf, True), ["TICKER", "public_date"], ["MthPrc", *HORIZONS]),
        sql(["prices_sparse", "month_rows", "m0", "m1", "bars"],
            f"SELECT {rounded_sql(['TICKER', 'public_date'], ['MthPrc', *HORIZONS])} FROM bars", "prices_sparse")),
    "w5_forward_returns_by_rows": (forward_by_rows, sql(
        ["prices_sparse", "month_rows", "m0"],
        "SELECT TICKER, public_date, " + sig_sql("""CASE WHEN MthPrc > 0 AND date_diff('day', public_date, nd) BETWEEN 67.5
  AND 112.5 THEN (np - MthPrc) / (MthPrc + 1e-12) END""") + """ AS "3mo_return" FROM (SELECT *,
  lead(MthPrc, 3) OVER (PARTITION BY TICKER ORDER BY public_date) AS np,
  lead(public_date, 3) OVER (PARTITION BY TICKER ORDER BY public_date) AS nd FROM m0)""", "prices_sparse")),
    "j3_merged_statements": (merged_statements, sql(
        FUND_NAMES[:4], f"SELECT {rounded_sql(S.KEYS, [*S.INCOME_ITEMS, *S.BALANCE_ITEMS, *S.CASHFLOW_ITEMS])} FROM merged")),
    "w2_p23_trailing_sums": (fundamentals, sql(
        FUND_NAMES, f"SELECT {rounded_sql(S.KEYS, ['total_debt', *[f'{i}_ttm' for i in S.FLOW_ITEMS]])} FROM fund")),
    "j2_asof_strict": (asof_strict, sql(
        PIT_NAMES[:-1], "SELECT " + rounded_sql(
            ["TICKER", "public_date", "fiscal_year", "fiscal_period", "publish_date"],
            ["revenue", "total_equity", "operating_cash", "net_income_ttm"]) + " FROM pit")),
    "j1_asof_inclusive_daily": (asof_inclusive, with_sql(
        ["prices", "balance", "sh"], f"""SELECT p.ticker, p.date, l_orderkey, l_linenumber, l_partkey,
  {sig_sql('l_extendedprice')} AS ep, known, {sig_sql('s.shares')} AS shares
  FROM prices p ASOF LEFT JOIN sh s ON p.ticker = s.ticker AND p.date >= s.known""", {"sh": SHARES_SQL})),
    "s9_j1_bars_with_share_table": (bars_shares_asof, with_sql(
        ["prices", "balance", "sh", "month_rows", "m0"], f"""SELECT TICKER, public_date, {sig_sql('MthPrc')} AS MthPrc,
  {sig_sql('shares')} AS shares, {sig_sql('MthPrc * shares')} AS MthCap FROM (SELECT TICKER, public_date, MthPrc,
  last_value(shares IGNORE NULLS) OVER (PARTITION BY TICKER ORDER BY public_date ROWS UNBOUNDED PRECEDING) AS shares
  FROM m0)""",
        {**bars_ctes("(SELECT p.* REPLACE (s.shares AS shares) FROM prices p ASOF LEFT JOIN sh s"
                     " ON p.ticker = s.ticker AND p.date >= s.known)"), "sh": SHARES_SQL})),
    "w4_row_averages": (averages, with_sql(
        ["balance"], "SELECT ticker, publish_date, " + ", ".join(
            sig_sql(f"({i} + lag({i}) OVER (PARTITION BY ticker ORDER BY publish_date)) / 2") + f" AS {i}_avg"
            for i in S.AVERAGED_ITEMS) + " FROM balance")),
    "p25_ratios": (ratios, sql(RATED_NAMES, f"SELECT {rounded_sql(['TICKER', 'public_date'], list(ratio_texts()))} FROM rated")),
    "p26_basic_ratios": (basic_ratios, sql(
        RATED_NAMES, f"SELECT {rounded_sql(['TICKER', 'public_date'], list(BASIC_RATIOS))} FROM rated")),
    "j6_j7_p12_sectors": (sectored, sql(
        [*BARS_NAMES, "companies"], f"""SELECT b.TICKER, public_date, coalesce(c.sector, 'Unknown') AS sector,
  {sig_sql('MthPrc')} AS MthPrc FROM bars b LEFT JOIN companies c ON b.TICKER = c.ticker
  WHERE coalesce(c.sector, 'Unknown') NOT IN ('MIDDLE EAST', 'Financial Services')
  AND length(b.TICKER) >= 2 AND NOT (length(b.TICKER) >= 5 AND right(b.TICKER, 1) IN ('F', 'Y'))""")),
    "p11_finite_returns": (finite_returns, sql(
        BARS_NAMES, "SELECT " + rounded_sql(["TICKER", "public_date"], list(HORIZONS))
        + """ FROM (SELECT * REPLACE (CASE WHEN month(public_date) <> 1 THEN "1mo_return" END AS "1mo_return") FROM bars)""")),
    "p10_quality_filter": (filtered, sql(
        CLEAN_NAMES, "SELECT " + rounded_sql(["TICKER", "public_date", "sector"], ["MthPrc", "MthCap", "total_equity"])
        + " FROM clean")),
    "p10_quality_report": (quality_report, sql(CLEAN_NAMES, """SELECT count(*) AS rows_before,
  (SELECT count(*) FROM clean) AS rows_after, count(*) FILTER (NOT coalesce(MthPrc >= 1, false)) AS fail_price,
  count(*) FILTER (NOT coalesce(MthCap >= 5e6, false)) AS fail_cap,
  count(*) FILTER (NOT coalesce(total_equity > 0, false)) AS fail_equity,
  count(*) FILTER (""" + " OR ".join(f"{q(c)} < -0.99 OR {q(c)} > 10" for c in HORIZONS) + """) AS fail_returns,
  count(*) FILTER (revenue_ttm <= 0) AS fail_revenue FROM sectored""")),
    "a3_cap_medians": (cap_medians, sql(
        BARS_NAMES, f"SELECT year(public_date)::INT AS year, {sig_sql('median(MthCap)')} AS median_cap FROM bars"
        " WHERE MthCap IS NOT NULL GROUP BY 1")),
    "p14_static_caps": (static_caps, sql(BARS_NAMES, """SELECT TICKER, public_date, CASE WHEN MthCap IS NULL THEN NULL
  WHEN MthCap < 50e6 THEN 'Nano Cap' WHEN MthCap < 300e6 THEN 'Micro Cap' WHEN MthCap < 2e9 THEN 'Small Cap'
  WHEN MthCap < 10e9 THEN 'Mid Cap' WHEN MthCap < 200e9 THEN 'Large Cap' ELSE 'Mega Cap' END AS cap FROM bars""")),
    "p15_year_caps": (year_caps, sql(CAPPED_NAMES, "SELECT TICKER, public_date, cap FROM capped")),
    "a4_winsor_bounds": (bounds, clean_sql(
        WIN_NAMES, f"SELECT {rounded_sql(['feature'], ['median', 'mad', 'low', 'high'])} FROM bounds")),
    "a4_winsorized": (winsored, clean_sql(
        [*WIN_NAMES, "winsored"], f"SELECT {rounded_sql(['TICKER', 'public_date'], ratio_names())} FROM winsored")),
    "a4_k2_winsorized_per_date": (winsored_per_date, sql(BARS_NAMES, "SELECT TICKER, public_date, " + ", ".join(
        sig_sql(f"CASE WHEN d_{c} > 0 AND {c} IS NOT NULL THEN least(greatest({c}, m_{c} - 3 * d_{c}), m_{c} + 3 * d_{c}) ELSE {c} END")
        + f" AS {c}" for c in ("MthPrc", "divyield")) + """ FROM bars JOIN (SELECT public_date, any_value(m1) AS m_MthPrc,
  any_value(m2) AS m_divyield, median(abs(MthPrc - m1)) AS d_MthPrc, median(abs(divyield - m2)) AS d_divyield
  FROM bars JOIN (SELECT public_date, median(MthPrc) AS m1, median(divyield) AS m2 FROM bars GROUP BY 1) USING (public_date)
  GROUP BY 1) USING (public_date)""")),
    "s8_macro_pivot": (macro_wide, with_sql(
        ["macro_long", "macro_wide"], f"SELECT {rounded_sql(['public_date'], ['F', 'O', 'P'])} FROM macro_wide", MACRO)),
    "w6_macro_lag": (macro_lagged, with_sql(
        ["macro_long", "macro_wide", "macro_lagged"],
        f"SELECT {rounded_sql(['public_date'], ['F', 'O', 'P'])} FROM macro_lagged", MACRO)),
    "w7_macro_changes": (macro_changes, with_sql(["benchmark_daily", "seen", "every", "filled"], f"""SELECT a.public_date, {sig_sql('a.level')} AS level, {sig_sql('a.level / b.level - 1')} AS "1mo_change",
  {sig_sql('a.level / c.level - 1')} AS "1yr_change" FROM filled a LEFT JOIN filled b ON a.n = b.n + 1 LEFT JOIN filled c ON a.n = c.n + 12""", MONTHS)),
    "j9_macro_join": (macro_joined, with_sql(
        [*BARS_NAMES, "macro_long", "macro_wide", "macro_lagged"],
        f"SELECT {rounded_sql(['TICKER', 'public_date'], ['MthPrc', 'F', 'O', 'P'])} FROM bars LEFT JOIN macro_lagged USING (public_date)",
        {**all_ctes(), **MACRO})),
    "k12_macro_asof": (macro_asof, with_sql(
        [*BARS_NAMES, "macro_long", "macro_wide"],
        f"SELECT b.TICKER, b.public_date, {sig_sql('F')} AS F, {sig_sql('O')} AS O, {sig_sql('P')} AS P FROM bars b ASOF LEFT JOIN"
        " (SELECT * FROM macro_wide WHERE month(public_date) IN (3, 9)) m ON b.public_date >= m.public_date",
        {**all_ctes(), **MACRO})),
    "panel_build": (full_panel, with_sql(
        [*CAPPED_NAMES, "longed", "mids", "mads", "bounds", "winsored", "macro_long", "macro_wide", "macro_lagged"],
        "SELECT " + rounded_sql(["TICKER", "gvkey", "public_date", "fiscal_year", "fiscal_period", "sector", "cap"],
                                [*BAR_COLS, *ratio_names(), *AMOUNTS, "F", "O", "P"])
        + " FROM winsored LEFT JOIN macro_lagged USING (public_date) WHERE MthCap IS NOT NULL",
        {**all_ctes(), **MACRO})),
}
