"""Model-free parts of the walk-forward run, for all dates in one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import columns as X
from ..operators.asof import asof_join
from ..operators.quantile import exact_quantiles
from ..operators.rank import pct_rank, top_k
from ..session import sized


def target_months(target: str) -> int:
    return C.HORIZONS.get(target, 3)


def prepare(panel: DataFrame, target: str, snap: bool = True) -> DataFrame:
    """Month-end dates, domestic tickers only, and the date at which the target is known.

    The target runs to a month end, so the outcome date is snapped to it; ``snap=False`` keeps the plain shifted day.
    """
    out = panel.withColumn("public_date", F.last_day("public_date")).where(X.is_domestic_ticker(F.col("TICKER")))
    if "outcome_date" in out.columns:
        return out
    return out.withColumn("outcome_date", X.outcome_date(F.col("public_date"), target_months(target), snap=snap))


def filter_universe(panel: DataFrame, min_cap: str = C.MIN_CAP) -> DataFrame:
    if "cap" not in panel.columns or min_cap == C.CAP_ORDER[0] or min_cap not in C.CAP_ORDER:
        return panel
    return panel.where(F.col("cap").isin(X.caps_from(min_cap)))


def infer_sectors(panel: DataFrame) -> DataFrame:
    """Pseudo-sector where none is known: terciles over rows of the ticker's median cap and median return on equity."""
    def tercile(c: str, q: str, labels: Sequence[str]) -> Column:
        return F.when(F.col(c).isNull(), F.lit("nan")).when(F.col(c) <= F.col(f"{q}.low"), labels[0]).when(
            F.col(c) <= F.col(f"{q}.high"), labels[1]).otherwise(labels[2])

    values = [("MthCap", "__cap", ["Small", "Mid", "Large"])]
    if "roe" in panel.columns:
        values.append(("roe", "__roe", ["Low", "Med", "High"]))
    # One row per ticker: its group is as long as its calendar.
    mids = panel.groupBy("TICKER").agg(*[F.median(c).alias(out) for c, out, _ in values])
    rows = panel.join(mids, "TICKER")
    for _, out, _ in values:
        cuts = exact_quantiles(rows, [], out, [1 / 3, 2 / 3]).agg(
            F.struct(F.min("q").alias("low"), F.max("q").alias("high")).alias("c"))
        rows = rows.withColumn(f"{out}_cuts", cuts.scalar())
    label = F.concat_ws("-", *[tercile(out, f"{out}_cuts", labels) for _, out, labels in values])
    return rows.select(*panel.columns, label.alias("sector"))


def rebalance_dates(panel: DataFrame, start: str, end: str, freq: str = "Q", month: int = 3) -> DataFrame:
    """Panel dates in range: all (M), quarter ends (Q), June and December (S), or one month a year (A, Y)."""
    d = F.col("public_date")
    keep = d.between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    if freq in ("A", "Y"):
        keep &= F.month(d) == month
    elif freq == "Q":
        keep &= F.month(d).isin(3, 6, 9, 12)
    elif freq == "S":
        keep &= F.month(d).isin(6, 12)
    elif freq != "M":
        raise ValueError(f"unknown frequency {freq}")
    return panel.where(keep).select("public_date").distinct()


def split_counts(panel: DataFrame, dates: DataFrame, target: str, n: int = C.N_STOCKS) -> DataFrame:
    """Per date: training rows (outcome known before it), test rows, test rows with a target, and whether it is run.

    Training sizes come from one count per outcome date, summed up in date order.
    """
    known = panel.where(F.col(target).isNotNull()).groupBy("outcome_date").agg(F.count("*").alias("c"))
    run = Window.partitionBy("one").orderBy("outcome_date").rowsBetween(Window.unboundedPreceding, 0)
    totals = known.withColumn("one", F.lit(1)).select("one", "outcome_date", F.sum("c").over(run).alias("n_train"))
    tests = panel.groupBy("public_date").agg(F.count("*").alias("n_test"), F.count(target).alias("n_valid"))
    base = dates.join(tests, "public_date").withColumn("one", F.lit(1))
    out = asof_join(base, totals, ["one"], "public_date", "outcome_date", ["n_train"], strict=True)
    n_train = F.coalesce("n_train", F.lit(0))
    ok = (n_train >= C.MIN_TRAIN_ROWS) & (F.col("n_test") >= n) & (F.col("n_valid") >= F.col("n_test") * 0.5)
    return out.select("public_date", n_train.alias("n_train"), "n_test", "n_valid", ok.alias("is_run"))


def universe_returns(panel: DataFrame, target: str, weighting: str = "cap_weighted") -> DataFrame:
    """(public_date, universe_return): cap-weighted with weights clipped at their 99.5th percentile; equal weights
    where no weight is positive or on request; 0 for a date without data."""
    dates = panel.select("public_date").distinct()
    valid = panel.where(F.col(target).isNotNull()).select(
        "public_date", F.col(target).alias("r"), F.coalesce("MthCap", F.lit(0.0)).alias("w"))
    if weighting == "cap_weighted":
        cut = exact_quantiles(valid, ["public_date"], "w", [0.995]).select("public_date", F.col("q").alias("cut"))
        valid = valid.join(sized(cut), "public_date").withColumn(
            "w", F.when(F.col("cut") > 0, F.least("w", "cut")).otherwise(F.col("w")))
        a = valid.groupBy("public_date").agg(F.sum(F.col("r") * F.col("w")).alias("rw"), F.sum("w").alias("w"),
                                             F.avg("r").alias("mean"))
        value = F.when(F.col("w") > 0, F.col("rw") / F.col("w")).otherwise(F.col("mean"))
    else:
        a = valid.groupBy("public_date").agg(F.avg("r").alias("mean"))
        value = F.col("mean")
    return dates.join(a.select("public_date", value.alias("universe_return")), "public_date", "left").select(
        "public_date", F.coalesce("universe_return", F.lit(0.0)).alias("universe_return"))


def final_scores(df: DataFrame, score: str = "model_score", roe: str = "roe", weight: float = C.ROE_WEIGHT) -> DataFrame:
    """(1 - w) · min–max of the model score + w · percentile rank of return on equity, per date.

    Without ``roe`` in the table, or with no weight on it, the model score itself is the result.
    """
    if weight <= 0 or roe not in df.columns:
        return df.withColumn("predicted_rank", F.col(score))
    edges = df.groupBy("public_date").agg(F.min(score).alias("__lo"), F.max(score).alias("__hi"))
    ranked = pct_rank(df, ["public_date"], roe, "roe_rank").join(sized(edges), "public_date")
    spread = F.col("__hi") - F.col("__lo")
    model_rank = F.when(spread > 0, (F.col(score) - F.col("__lo")) / spread).otherwise(F.lit(0.5))
    out = ranked.withColumn("roe_rank", F.coalesce("roe_rank", F.lit(0.5))).withColumn("model_rank", model_rank)
    return out.drop("__lo", "__hi").withColumn(
        "predicted_rank", (1 - weight) * F.col("model_rank") + weight * F.col("roe_rank"))


def select_top(df: DataFrame, n: int = C.N_STOCKS, score: str = "predicted_rank") -> DataFrame:
    """First ``n`` per date by score; equal scores go by ticker."""
    return top_k(df, ["public_date"], [F.col(score).desc_nulls_last(), F.col("TICKER")], n, "position")


def realized(df: DataFrame, target: str) -> Column:
    """Realised return with the delisting assumption for missing ones."""
    return F.coalesce(F.col(target), F.lit(C.DELIST_RETURN))


def portfolio_returns(selected: DataFrame, target: str) -> DataFrame:
    return selected.groupBy("public_date").agg(F.avg(realized(selected, target)).alias("portfolio_return"),
                                               F.count("*").alias("n_stocks"))


def turnover(selected: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """1 - share of a date's holdings also held at the date before it; 1 at the first.

    The previous date is found on the date list; holdings meet by an equi-join on (date, ticker).
    """
    by = list(by)
    w = Window.partitionBy(*(by or [F.lit(1)])).orderBy("public_date")
    dates = selected.select(*by, "public_date").distinct().withColumn("prev_date", F.lag("public_date").over(w))
    now = selected.select(*by, "public_date", "TICKER").join(dates, [*by, "public_date"])
    before = selected.select(*by, F.col("public_date").alias("prev_date"), "TICKER", F.lit(1).alias("kept"))
    return now.join(before, [*by, "prev_date", "TICKER"], "left").groupBy(*by, "public_date").agg(
        (1 - F.count("kept") / F.count("*")).alias("turnover"))


def factor_run(panel: DataFrame, dates: DataFrame, target: str, factor: str = "roe", n: int = C.N_STOCKS) -> tuple[DataFrame, DataFrame]:
    """Selection by one factor's percentile rank over all dates: (periods, selections)."""
    counts = split_counts(panel, dates, target, n).where("is_run").select("public_date")
    test = panel.join(sized(counts), "public_date", "left_semi").select(
        "public_date", "TICKER", "sector", "MthCap", target, factor)
    ranked = pct_rank(test, ["public_date"], factor, "predicted_rank").withColumn(
        "predicted_rank", F.coalesce("predicted_rank", F.lit(0.5)))
    chosen = select_top(ranked, n)
    periods = (portfolio_returns(chosen, target)
               .join(universe_returns(test, target), "public_date")
               .join(turnover(chosen), "public_date"))
    return periods, chosen


def capital_path(periods: DataFrame, n: int = C.N_STOCKS, capital: float = C.INITIAL_CAPITAL,
                 pricing: str = "tiered", by: str = "strategy", price: float = 100.0, fees: bool = True) -> DataFrame:
    """Fee and capital after every period: capital · (1 + r) - fee, where the fee depends on the capital before.

    The recurrence is a fold over one strategy's periods (public_date, portfolio_return, turnover), which number as
    many as there are rebalance dates.
    """
    f = C.FEES[pricing]
    q = f"floor(s.capital / {n} / {price})"
    base = f"least(greatest({q} * {f['per_share']}D, {f['minimum']}D), {q} * {price}D * {f['max_share']}D)"
    one = f"greatest({base} + {q} * {f['remove']}D, 0D)"
    fee = f"if({q} > 0 and x.t > 0, floor({n} * x.t * 2) * ({one}), 0D)"
    step = f"x.r * s.capital + s.capital - {'' if fees else '0D * '}({fee})"
    run = (f"aggregate(xs, named_struct('capital', {float(capital)}D, 'o', cast(array() as array<struct<fee:double,capital:double>>)),"
           f" (s, x) -> named_struct('capital', {step}, 'o', array_append(s.o, named_struct('fee', {fee}, 'capital', {step})))).o")
    packed = periods.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(
        F.col("public_date").alias("d"), F.col("portfolio_return").cast("double").alias("r"),
        F.col("turnover").cast("double").alias("t")))).alias("xs"))
    return (packed.withColumn("o", F.expr(run)).select(by, F.explode(F.arrays_zip("xs", "o")).alias("z"))
            .select(by, F.col("z.xs.d").alias("public_date"), F.col("z.o.fee").alias("fees"), F.col("z.o.capital").alias("capital")))
