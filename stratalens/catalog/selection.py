"""Feature, selection and walk-forward queries without a fitted model, and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as C
from .. import fixtures as X
from ..fixtures import sig, sig_sql, with_sql
from ..functions.ratios import ratio_texts
from ..operators.rank import pct_rank
from ..plans import benchmark as B
from ..plans import features as T
from ..plans import panel as P
from ..plans import report as R
from ..plans import selection as L
from ..session import materialize
from .panel import CAPPED_NAMES, CLEAN_NAMES, all_ctes, q, rounded, rounded_sql, stored_clean

# Every feature that the panel has.
FEATS = [f for f in C.ALL_FEATURES if f in {*ratio_texts(), "MthCap", "divyield"}]
# These are one constant up to rounding throughout the test tables; their z-scores are rounding errors over rounding errors.
CONSTANT = ["gpm", "opmbd", "opmad", "ptpm", "efftax", "cash_ratio", "invt_act", "rect_act", "rd_sale", "lt_ppent"]
SCORED = [f for f in FEATS if f not in CONSTANT]
TARGET = "3mo_return"
N = 10
START, END = "1990-01-01", "2010-12-31"


def sql(names, select, extra=None):
    return with_sql(names, select, {**all_ctes(), **(extra or {})})


def clean(spark, sf):
    return stored_clean(spark, sf)


def capped(spark, sf):
    return P.add_cap_buckets(stored_clean(spark, sf), base_year=2000)


KEYS = ["TICKER", "public_date"]


def neutralized(spark, sf):
    return rounded(T.neutralize(clean(spark, sf), SCORED), KEYS, SCORED)


def rank_target(spark, sf):
    return rounded(T.rank_target(clean(spark, sf), TARGET), KEYS, ["target_rank"])


def winsor_target(spark, sf):
    return rounded(T.winsorize_target(clean(spark, sf), TARGET), KEYS, [TARGET])


def missing(spark, sf):
    return T.missing_shares(clean(spark, sf), FEATS).select("feature", "n_rows", sig("missing_share").alias("missing_share"))


def medians(spark, sf):
    return rounded(T.feature_medians(clean(spark, sf), FEATS), ["feature"], ["median"])


def complete(spark, sf):
    d = clean(spark, sf)
    kept = T.complete_features(d, FEATS, 0.3)
    return T.complete_rows(d, kept).groupBy("public_date").agg(
        F.count("*").alias("n_rows"), F.lit(len(kept)).cast("long").alias("n_features"))


def imputed(spark, sf):
    d = clean(spark, sf)
    wide = d.select(*KEYS, *FEATS)
    done = T.impute(wide, [*FEATS, "rd_missing"], T.median_map(d, FEATS))
    return rounded(done, KEYS, [*FEATS, "rd_missing"])


def outliers(spark, sf):
    return rounded(T.outlier_shares(clean(spark, sf), SCORED, 1.5), KEYS, ["outlier_share"])


def screened(spark, sf):
    d = T.drop_outliers(T.outlier_shares(clean(spark, sf), SCORED, 1.5), 0.12, 20)
    return d.select(*KEYS, sig("outlier_share").alias("outlier_share"))


def universe(spark, sf):
    return L.filter_universe(capped(spark, sf), "Mid Cap").select(*KEYS, "cap")


def cap_weighted(spark, sf):
    return rounded(L.universe_returns(clean(spark, sf), TARGET), ["public_date"], ["universe_return"])


def equal_weighted(spark, sf):
    return rounded(L.universe_returns(clean(spark, sf), TARGET, "equal_weighted"), ["public_date"], ["universe_return"])


def inferred(spark, sf):
    d = clean(spark, sf).drop("sector")
    return L.infer_sectors(d).select(*KEYS, "sector")


def outcome(spark, sf):
    d = clean(spark, sf).select(*KEYS)
    from ..functions.columns import outcome_date
    return d.select(*KEYS, outcome_date(F.col("public_date"), 3).alias("snapped"),
                    outcome_date(F.col("public_date"), 3, snap=False).alias("shifted"),
                    outcome_date(F.col("public_date"), 12, 3, snap=False).alias("lagged"))


def dates(spark, sf):
    d = clean(spark, sf)
    out = None
    for freq, month in (("M", 3), ("Q", 3), ("S", 3), ("A", 9)):
        part = L.rebalance_dates(d, START, END, freq, month).withColumn("freq", F.lit(freq))
        out = part if out is None else out.unionByName(part)
    return out.select("freq", "public_date")


def prepared(spark, sf, target=TARGET):
    d = L.prepare(clean(spark, sf).select(*KEYS, "sector", "MthCap", "roe", "bm", *C.HORIZONS), target)
    return materialize(d)


def split(spark, sf):
    d = prepared(spark, sf)
    return L.split_counts(d, L.rebalance_dates(d, START, END, "Q"), TARGET, N)


def latest_split(spark, sf):
    d = clean(spark, sf)
    last = d.agg(F.max("public_date").alias("m"))
    cut = F.add_months(last.scalar(), -3)
    return d.select(*KEYS, TARGET).where(F.col("public_date") <= cut).agg(
        F.count("*").alias("n_train"), F.count(TARGET).alias("n_known"), F.max("public_date").alias("train_end"))


def scored(spark, sf):
    d = clean(spark, sf).withColumn("model_score", -F.col("ptb"))
    top = L.select_top(L.final_scores(d, weight=0.3), N)
    return top.select(*KEYS, F.col("position").cast("long").alias("position"), sig("roe_rank").alias("roe_rank"),
                      sig("model_rank").alias("model_rank"), sig("predicted_rank").alias("predicted_rank"))


def factor(spark, sf):
    d = prepared(spark, sf)
    periods, chosen = L.factor_run(d, L.rebalance_dates(d, START, END, "Q"), TARGET, "roe", N)
    return periods, chosen


def factor_periods(spark, sf):
    return factor(spark, sf)[0].select("public_date", "n_stocks", *[sig(c).alias(c) for c in (
        "portfolio_return", "universe_return", "turnover")])


def factor_selection(spark, sf):
    return factor(spark, sf)[1].select(*KEYS, F.col("position").cast("long").alias("position"),
                                       sig("predicted_rank").alias("predicted_rank"))


def full_run(spark, sf):
    """Periods with index return, fees and capital, and the selections; stored because the reports read both often."""
    periods, chosen = factor(spark, sf)
    periods = materialize(periods)
    index = B.holding_returns(periods.select(F.col("public_date").alias("date")), X.benchmark_daily(spark, sf), 3)
    periods = periods.join(index.select(F.col("date").alias("public_date"), "index_return"), "public_date").withColumn(
        "strategy", F.lit("roe"))
    money = L.capital_path(periods, N)
    chosen = chosen.withColumn("strategy", F.lit("roe")).withColumn("actual", L.realized(chosen, TARGET))
    return materialize(periods.join(money, ["strategy", "public_date"])), materialize(chosen)


MONEY = ["portfolio_return", "universe_return", "index_return", "turnover", "fees", "capital"]


def capital(spark, sf):
    return rounded(full_run(spark, sf)[0], ["strategy", "public_date"], MONEY)


PERIOD_NUMBERS = ["portfolio_return", "universe_return", "index_return", "excess_vs_universe", "excess_vs_index",
                  "cumulative_return", "drawdown", "max_drawdown_to_date", "rolling_sharpe", "turnover", "fees"]


def period_report(spark, sf):
    p, s = full_run(spark, sf)
    d = R.period_table(p, s)
    return d.select("strategy", F.col("period").cast("long").alias("period"), "public_date", "n_stocks", "stocks",
                    *[sig(F.round(c, 9)).alias(c) for c in PERIOD_NUMBERS])


def selection_report(spark, sf):
    p, s = full_run(spark, sf)
    return rounded(R.selection_table(s, p, "actual"), ["strategy", "public_date", "TICKER", "beat_benchmark"],
                   ["predicted_rank", "actual_return", "excess_return"])


SUMMARY = ["win_rate_universe", "avg_excess_universe", "win_rate_index", "avg_excess_index", "total_fees",
           "avg_turnover", "avg_stock_return", "median_stock_return", "std_stock_return", "pct_positive"]


def summary_report(spark, sf):
    p, s = full_run(spark, sf)
    return rounded(R.run_summary(p, s, "actual"), ["strategy", "n_periods", "n_selections"], SUMMARY)


def feature_counts(spark, sf):
    d = clean(spark, sf)
    table = T.feature_table(spark, d)
    counts = T.long_form(d, T.feature_list(d)).groupBy("feature").agg(F.count("value").alias("n_values"))
    return table.join(counts, "feature", "left").select("category", "feature", "present",
                                                        F.coalesce("n_values", F.lit(0)).alias("n_values"))


# --- oracle side ----------------------------------------------------------------------------------------------

def z_sql(f: str) -> str:
    return f"({q(f)} - avg({q(f)}) OVER g) / (stddev_samp({q(f)}) OVER g + 1e-12)"


def neutral_sql() -> str:
    parts = [f"{sig_sql(f'coalesce({z_sql(f)}, 0)')} AS {q(f)}" if f != "MthCap" else f"{sig_sql(q(f))} AS {q(f)}" for f in SCORED]
    return f"SELECT TICKER, public_date, {', '.join(parts)} FROM clean WINDOW g AS (PARTITION BY sector, public_date)"


OUT = {
    "shares_out": "SELECT TICKER, public_date, (" + " + ".join(
        f"coalesce(CASE WHEN stddev_samp({q(f)}) OVER g > 0 THEN (abs(({q(f)} - avg({q(f)}) OVER g) / stddev_samp({q(f)}) OVER g) > 1.5)::INT END, 0)"
        for f in SCORED) + f") / {float(len(SCORED))} AS outlier_share FROM clean WINDOW g AS (PARTITION BY public_date)",
    "kept_out": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY public_date ORDER BY outlier_share, TICKER DESC) AS rn,
  count(*) OVER (PARTITION BY public_date) AS n, count(*) FILTER (outlier_share > 0.12) OVER (PARTITION BY public_date) AS bad
  FROM shares_out) WHERE CASE WHEN n - bad >= 20 THEN outlier_share <= 0.12 ELSE rn <= 20 END""",
}

RANK = "(rank() OVER (PARTITION BY public_date ORDER BY {0}) + (count(*) OVER (PARTITION BY public_date, {0}) - 1) / 2.0) / count({0}) OVER (PARTITION BY public_date)"

CAPW = {
    "weights": """SELECT c.public_date, "3mo_return" AS r, coalesce(MthCap, 0) AS w, cut FROM clean c JOIN (
  SELECT public_date, quantile_cont(coalesce(MthCap, 0), 0.995) AS cut FROM clean WHERE "3mo_return" IS NOT NULL GROUP BY 1) k
  ON c.public_date = k.public_date WHERE "3mo_return" IS NOT NULL""",
    "univ": """SELECT d.public_date, coalesce(CASE WHEN w > 0 THEN rw / w ELSE mean END, 0) AS universe_return
  FROM (SELECT DISTINCT public_date FROM clean) d LEFT JOIN (SELECT public_date, sum(r * least(w, cut)) AS rw,
  sum(least(w, cut)) AS w, avg(r) AS mean FROM weights GROUP BY 1) a ON d.public_date = a.public_date""",
}


def near_sql(day: str) -> str:
    return f"(SELECT s.level FROM benchmark_daily s ORDER BY abs(date_diff('day', s.date, {day})), s.date DESC LIMIT 1)"


SPLIT = {
    "reb": f"""SELECT DISTINCT public_date FROM clean WHERE month(public_date) IN (3, 6, 9, 12)
  AND public_date BETWEEN DATE '{START}' AND DATE '{END}'""",
    "splits": """SELECT r.public_date, (SELECT count(*) FROM clean c WHERE "3mo_return" IS NOT NULL AND
  last_day(c.public_date + INTERVAL 3 MONTH) < r.public_date) AS n_train, count(*) AS n_test, count("3mo_return") AS n_valid
  FROM reb r JOIN clean t ON t.public_date = r.public_date GROUP BY 1""",
    "runs": "SELECT public_date FROM splits WHERE n_train >= 500 AND n_test >= 10 AND n_valid >= n_test * 0.5",
    "ranked": f"""SELECT c.*, coalesce(CASE WHEN roe IS NOT NULL THEN {RANK.format('roe')} END, 0.5) AS predicted_rank
  FROM clean c WHERE public_date IN (SELECT public_date FROM runs)""",
    "chosen": """SELECT *, coalesce("3mo_return", -0.3) AS actual FROM (SELECT *, row_number() OVER (PARTITION BY public_date
  ORDER BY predicted_rank DESC, TICKER) AS position FROM ranked) WHERE position <= 10""",
    "turn": """SELECT n.public_date, 1 - count(b.TICKER) / count(*) AS turnover FROM (SELECT c.public_date, c.TICKER, d.prev
  FROM chosen c JOIN (SELECT public_date, lag(public_date) OVER (ORDER BY public_date) AS prev FROM runs) d
  ON c.public_date = d.public_date) n LEFT JOIN chosen b ON b.public_date = n.prev AND b.TICKER = n.TICKER GROUP BY 1""",
    "periods": """SELECT c.public_date, avg(actual) AS portfolio_return, count(*) AS n_stocks, any_value(universe_return) AS universe_return,
  any_value(turnover) AS turnover FROM chosen c JOIN univ u ON c.public_date = u.public_date JOIN turn t
  ON c.public_date = t.public_date GROUP BY 1""",
    "indexed": f"""SELECT p.*, (p1 - p0) / p0 AS index_return FROM (SELECT p.*, {near_sql('p.public_date')} AS p0,
  {near_sql('CAST(p.public_date + INTERVAL 3 MONTH AS DATE)')} AS p1 FROM periods p) p""",
    "numbered": "SELECT *, row_number() OVER (ORDER BY public_date) AS i FROM indexed",
}


def fee_sql(cap: str) -> str:
    shares = f"floor({cap} / 10 / 100)"
    return (f"CASE WHEN {shares} > 0 AND n.turnover > 0 THEN floor(10 * n.turnover * 2) * greatest(least(greatest({shares} * 0.0035, 0.35),"
            f" {shares} * 100 * 0.01) + {shares} * 0.003, 0) ELSE 0 END")


# The recursive part needs WITH RECURSIVE, so the run's statement is put together here.
RUN_NAMES = [*CLEAN_NAMES, "benchmark_daily", "weights", "univ", "reb", "splits", "runs", "ranked", "chosen", "turn", "periods",
             "indexed", "numbered"]
PATH = f"""SELECT n.i, n.public_date, {fee_sql('30000.0')} AS fees, 30000.0 * (1 + portfolio_return) - {fee_sql('30000.0')} AS capital
  FROM numbered n WHERE n.i = 1 UNION ALL SELECT n.i, n.public_date, {fee_sql('p.capital')}, p.capital * (1 + n.portfolio_return) - {fee_sql('p.capital')}
  FROM path p JOIN numbered n ON n.i = p.i + 1"""


def run_sql(select: str, extra: dict | None = None) -> str:
    text = sql([*RUN_NAMES, "path", "done", *(extra or {})], select, {
        **CAPW, **SPLIT, "path": PATH,
        "done": "SELECT 'roe' AS strategy, n.*, fees, capital FROM numbered n JOIN path p ON n.i = p.i", **(extra or {})})
    return "WITH RECURSIVE " + text[len("WITH "):]


CURVE = {
    "curve": """SELECT *, product(1 + portfolio_return) OVER w AS cum, avg(portfolio_return) OVER w AS mean_to,
  stddev_samp(portfolio_return) OVER w AS sd_to FROM done WINDOW w AS (ORDER BY public_date)""",
    "dipped": "SELECT *, greatest(1, max(cum) OVER (ORDER BY public_date)) AS peak FROM curve",
}
FEATURE_CASES = [(c, f) for c, names in C.FEATURE_CATEGORIES.items() for f in names]
HAVE = {f for f in C.ALL_FEATURES if f not in C.FEATURE_CATEGORIES["macro"]}

QUERIES = {
    "w8_neutralized": (neutralized, sql(CLEAN_NAMES, neutral_sql())),
    "w9_rank_target": (rank_target, sql(
        CLEAN_NAMES, f"SELECT TICKER, public_date, {sig_sql('CASE WHEN t IS NOT NULL THEN ' + RANK.format('t') + ' END')} AS target_rank "
        "FROM (SELECT *, \"3mo_return\" AS t FROM clean)")),
    "a21_winsor_target": (winsor_target, sql(
        CLEAN_NAMES, f"""SELECT TICKER, public_date, {sig_sql('CASE WHEN "3mo_return" IS NOT NULL THEN least(greatest("3mo_return", lo), hi) END')} AS "3mo_return"
  FROM clean, (SELECT quantile_cont("3mo_return", 0.01) AS lo, quantile_cont("3mo_return", 0.99) AS hi FROM clean)""")),
    "a22_missing_shares": (missing, sql(CLEAN_NAMES, " UNION ALL ".join(
        f"SELECT '{f}' AS feature, count(*) AS n_rows, {sig_sql(f'1 - count({q(f)}) / count(*)')} AS missing_share FROM clean" for f in FEATS))),
    "a22_feature_medians": (medians, sql(CLEAN_NAMES, " UNION ALL ".join(
        f"SELECT '{f}' AS feature, {sig_sql(f'median({q(f)})')} AS median FROM clean" for f in FEATS))),
    "a22_complete_rows": (complete, sql(
        [*CLEAN_NAMES, "shares_missing", "counted"],
        "SELECT public_date, count(*) AS n_rows, any_value(k) AS n_features FROM counted WHERE present / k >= 0.8 GROUP BY 1",
        {"shares_missing": "SELECT " + ", ".join(f"(1 - count({q(f)}) / count(*) <= 0.3)::INT AS {q(f)}" for f in FEATS) + " FROM clean",
         "counted": "SELECT public_date, " + " + ".join(f"s.{q(f)}" for f in FEATS) + " AS k, " + " + ".join(
             f"s.{q(f)} * (c.{q(f)} IS NOT NULL)::INT" for f in FEATS) + " AS present FROM clean c, shares_missing s"})),
    "p27_imputed": (imputed, sql(
        [*CLEAN_NAMES, "mid"], "SELECT TICKER, public_date, " + ", ".join(
            f"{sig_sql(f'coalesce(c.{q(f)}, m.{q(f)}, 0)')} AS {q(f)}" for f in FEATS) + ", CAST(0 AS DOUBLE) AS rd_missing FROM clean c, mid m",
        {"mid": "SELECT " + ", ".join(f"median({q(f)}) AS {q(f)}" for f in FEATS) + " FROM clean"})),
    "w10_outlier_shares": (outliers, sql(
        [*CLEAN_NAMES, "shares_out"], f"SELECT TICKER, public_date, {sig_sql('outlier_share')} AS outlier_share FROM shares_out", OUT)),
    "o2_outlier_screen": (screened, sql(
        [*CLEAN_NAMES, "shares_out", "kept_out"],
        f"SELECT TICKER, public_date, {sig_sql('outlier_share')} AS outlier_share FROM kept_out", OUT)),
    "p13_universe": (universe, sql(
        CAPPED_NAMES, "SELECT TICKER, public_date, cap FROM capped WHERE cap IN ('Mid Cap', 'Large Cap', 'Mega Cap')")),
    "a14_universe_cap_weighted": (cap_weighted, sql(
        [*CLEAN_NAMES, "weights", "univ"], f"SELECT public_date, {sig_sql('universe_return')} AS universe_return FROM univ", CAPW)),
    "a15_universe_equal_weighted": (equal_weighted, sql(
        CLEAN_NAMES, f"""SELECT public_date, {sig_sql('coalesce(avg("3mo_return"), 0)')} AS universe_return FROM clean GROUP BY 1""")),
    "a16_pseudo_sectors": (inferred, sql(
        [*CLEAN_NAMES, "tick", "rows_t"], """SELECT TICKER, public_date, (CASE WHEN mc IS NULL THEN 'nan' WHEN mc <= c1 THEN 'Small'
  WHEN mc <= c2 THEN 'Mid' ELSE 'Large' END) || '-' || (CASE WHEN mr IS NULL THEN 'nan' WHEN mr <= r1 THEN 'Low' WHEN mr <= r2 THEN 'Med'
  ELSE 'High' END) AS sector FROM rows_t, (SELECT quantile_cont(mc, 1.0/3) AS c1, quantile_cont(mc, 2.0/3) AS c2,
  quantile_cont(mr, 1.0/3) AS r1, quantile_cont(mr, 2.0/3) AS r2 FROM rows_t)""",
        {"tick": "SELECT TICKER, median(MthCap) AS mc, median(roe) AS mr FROM clean GROUP BY 1",
         "rows_t": "SELECT c.TICKER, c.public_date, mc, mr FROM clean c JOIN tick USING (TICKER)"})),
    "p17_outcome_dates": (outcome, sql(CLEAN_NAMES, """SELECT TICKER, public_date, last_day(public_date + INTERVAL 3 MONTH) AS snapped,
  CAST(public_date + INTERVAL 3 MONTH AS DATE) AS shifted, CAST(public_date + INTERVAL 12 MONTH AS DATE) + 3 AS lagged FROM clean""")),
    "p18_rebalance_dates": (dates, sql(CLEAN_NAMES, " UNION ALL ".join(
        f"SELECT DISTINCT '{f}' AS freq, public_date FROM clean WHERE public_date BETWEEN DATE '{START}' AND DATE '{END}' AND month(public_date) IN ({m})"
        for f, m in (("M", "1,2,3,4,5,6,7,8,9,10,11,12"), ("Q", "3,6,9,12"), ("S", "6,12"), ("A", "9"))))),
    "p19_split_counts": (split, sql(
        [*CLEAN_NAMES, "reb", "splits"],
        "SELECT *, n_train >= 500 AND n_test >= 10 AND n_valid >= n_test * 0.5 AS is_run FROM splits", SPLIT)),
    "p20_latest_split": (latest_split, sql(CLEAN_NAMES, """SELECT count(*) AS n_train, count("3mo_return") AS n_known,
  max(public_date) AS train_end FROM clean WHERE public_date <= (SELECT CAST(max(public_date) - INTERVAL 3 MONTH AS DATE) FROM clean)""")),
    "w18_m5_o1_final_scores": (scored, sql(
        [*CLEAN_NAMES, "parts"], f"""SELECT TICKER, public_date, position, {sig_sql('roe_rank')} AS roe_rank, {sig_sql('model_rank')} AS model_rank,
  {sig_sql('0.7 * model_rank + 0.3 * roe_rank')} AS predicted_rank FROM (SELECT *, row_number() OVER (PARTITION BY public_date
  ORDER BY 0.7 * model_rank + 0.3 * roe_rank DESC NULLS LAST, TICKER) AS position FROM parts) WHERE position <= 10""",
        {"parts": f"""SELECT TICKER, public_date, coalesce(CASE WHEN roe IS NOT NULL THEN {RANK.format('roe')} END, 0.5) AS roe_rank,
  CASE WHEN max(-ptb) OVER d > min(-ptb) OVER d THEN (-ptb - min(-ptb) OVER d) / (max(-ptb) OVER d - min(-ptb) OVER d) ELSE 0.5 END AS model_rank
  FROM clean WINDOW d AS (PARTITION BY public_date)"""})),
    "b2_a17_w16_factor_periods": (factor_periods, sql(
        RUN_NAMES[:-2], f"SELECT public_date, n_stocks, {rounded_sql([], ['portfolio_return', 'universe_return', 'turnover'])} FROM periods",
        {**CAPW, **SPLIT})),
    "b2_factor_selection": (factor_selection, sql(
        RUN_NAMES[:-4], f"SELECT TICKER, public_date, position, {sig_sql('predicted_rank')} AS predicted_rank FROM chosen", {**CAPW, **SPLIT})),
    "w20_f10_b4_capital_path": (capital, run_sql(f"SELECT {rounded_sql(['strategy', 'public_date'], MONEY)} FROM done")),
    "b5_w12_w15_period_report": (period_report, run_sql(
        "SELECT strategy, d.i AS period, d.public_date, n_stocks, stocks, " + ", ".join(
            f"{sig_sql(f'round({e}, 9)')} AS {n}" for n, e in {
                "portfolio_return": "portfolio_return", "universe_return": "universe_return", "index_return": "index_return",
                "excess_vs_universe": "portfolio_return - universe_return", "excess_vs_index": "portfolio_return - index_return",
                "cumulative_return": "cum - 1", "drawdown": "(peak - cum) / peak",
                "max_drawdown_to_date": "max((peak - cum) / peak) OVER (ORDER BY d.public_date)",
                "rolling_sharpe": "CASE WHEN sd_to > 0 THEN mean_to / sd_to ELSE 0 END", "turnover": "turnover", "fees": "fees"}.items())
        + """ FROM dipped d JOIN (SELECT public_date, string_agg(TICKER, ', ' ORDER BY position) AS stocks FROM chosen GROUP BY 1) s
  ON s.public_date = d.public_date""", CURVE)),
    "b5_selection_report": (selection_report, run_sql(
        f"""SELECT strategy, c.public_date, TICKER, actual - d.universe_return > 0 AS beat_benchmark, {sig_sql('predicted_rank')} AS predicted_rank,
  {sig_sql('actual')} AS actual_return, {sig_sql('actual - d.universe_return')} AS excess_return FROM chosen c JOIN done d ON c.public_date = d.public_date""")),
    "a19_a20_run_summary": (summary_report, run_sql(
        "SELECT strategy, n_periods, n_selections, " + rounded_sql([], SUMMARY) + """ FROM (SELECT strategy, count(*) AS n_periods,
  avg((portfolio_return > universe_return)::INT) AS win_rate_universe, avg(portfolio_return - universe_return) AS avg_excess_universe,
  avg((portfolio_return > index_return)::INT) AS win_rate_index, avg(portfolio_return - index_return) AS avg_excess_index,
  sum(fees) AS total_fees, avg(turnover) AS avg_turnover FROM done GROUP BY 1), (SELECT count(*) AS n_selections, avg(actual) AS avg_stock_return,
  median(actual) AS median_stock_return, stddev_pop(actual) AS std_stock_return, avg((actual > 0)::INT) AS pct_positive FROM chosen)""")),
    "p22_d5_feature_counts": (feature_counts, sql(CLEAN_NAMES, " UNION ALL ".join(
        f"SELECT '{c}' AS category, '{f}' AS feature, {'true' if f in HAVE else 'false'} AS present, "
        + (f"count({q(f)}) AS n_values FROM clean" if f in HAVE else "0::BIGINT AS n_values FROM (SELECT count(*) FROM clean)")
        for c, f in FEATURE_CASES))),
}
