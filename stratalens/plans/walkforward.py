"""Walk-forward evaluation: a fit per rebalance date, several at a time, everything else over all dates in one plan."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import date

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..session import materialize
from . import benchmark as B
from . import features as T
from . import metrics as M
from . import report as R
from . import selection as L
from .model import SelectionModel
from .selection import final_scores, select_top


@dataclass
class RunResult:
    """Tables of one run; ``metrics`` has a row per metric set."""

    periods: DataFrame
    selections: DataFrame
    metrics: DataFrame
    target: str
    periods_per_year: int

    def growth(self) -> DataFrame:
        out = self.periods
        for c in ("portfolio", "universe", "index"):
            out = M.growth(out, ["strategy"], f"{c}_return", "public_date", f"{c}_growth")
        return out

    def yearly(self) -> DataFrame:
        return M.yearly_returns(self.periods, ["strategy"], ["portfolio_return", "universe_return", "index_return"], "public_date")

    def totals(self) -> DataFrame:
        return self.periods.groupBy("strategy").agg(F.sum("fees").alias("total_fees"), F.avg("turnover").alias("avg_turnover"), F.count("*").alias("n_periods"))

    def period_table(self) -> DataFrame:
        return R.period_table(self.periods, self.selections)

    def selection_table(self) -> DataFrame:
        return R.selection_table(self.selections, self.periods, "actual_return")

    def summary(self) -> DataFrame:
        return R.run_summary(self.periods, self.selections, "actual_return")


def run(panel: DataFrame, index: DataFrame, start: str, end: str, *, freq: str = "Q", month: int = 3, n: int = C.N_STOCKS,
        capital: float = C.INITIAL_CAPITAL, min_cap: str = C.MIN_CAP, target: str | None = None, weighting: str = "cap_weighted",
        make_model: Callable[[], SelectionModel] = SelectionModel, screen: bool = True, simulate_fees: bool = True, pricing: str = "tiered",
        snap_outcomes: bool = True, legacy_index_months: bool = False, strategy: str = "model", at_once: int = 4) -> RunResult:
    """Expanding-window run over the rebalance dates.

    The prepared panel is stored once with the columns in use. Each of the dates, at most some hundreds, needs its own
    fit; none depends on another, so ``at_once`` of them are submitted at a time and share the executors, in a pool of
    their own where the cluster schedules fairly. The stages of one fit that have few tasks thus overlap with those of others. A date's selection is
    stored as soon as it is made, so nothing carries lineage. With frozen medians the first date is fitted alone.
    Returns, benchmarks, turnover, fees, capital and metrics follow from the stored selections in single plans.
    """
    target = target or C.FREQ_TARGET.get(freq, "1yr_return")
    data = L.filter_universe(L.prepare(panel, target, snap_outcomes), min_cap)
    if "sector" not in data.columns:
        data = L.infer_sectors(materialize(data))
    keep = ["TICKER", "public_date", "outcome_date", "sector", target, *T.feature_list(data)]
    data = materialize(data.select(*dict.fromkeys([*keep, "MthCap"])))
    dates = L.rebalance_dates(data, start, end, freq, month)
    plan = L.split_counts(data, dates, target, n).where("is_run").select("public_date")
    run_dates = sorted(r["public_date"] for r in plan.collect())
    per_year = C.FREQ_PERIODS.get(freq, 12)
    chosen = _selected(data, run_dates, target, n, make_model, screen, at_once)
    if chosen is None:
        chosen = data.sparkSession.createDataFrame([], f"public_date date, TICKER string, sector string, `{target}` double, position int, model_score double, predicted_rank double")
    chosen = chosen.withColumn("strategy", F.lit(strategy)).withColumn("actual_return", L.realized(chosen, target))
    tests = data.where(F.col("public_date").isin(run_dates)) if run_dates else data.limit(0)
    days = chosen.select(F.col("public_date").alias("date")).distinct()
    months = L.target_months(target)
    if legacy_index_months:
        months = 12 if target == "1yr_return" else 3
    index_part = B.holding_returns(days, index, months).select(F.col("date").alias("public_date"), F.coalesce("index_return", F.lit(0.0)).alias("index_return"))
    periods = (L.portfolio_returns(chosen, target).join(L.universe_returns(tests, target, weighting), "public_date")
               .join(L.turnover(chosen), "public_date").join(index_part, "public_date", "left").withColumn("strategy", F.lit(strategy)))
    periods = materialize(periods.select("strategy", "public_date", "portfolio_return", "universe_return", F.coalesce("index_return", F.lit(0.0)).alias("index_return"),
                                         "n_stocks", "turnover"))
    money = L.capital_path(periods, n, capital, pricing, fees=simulate_fees)
    periods = materialize(periods.join(money, ["strategy", "public_date"]))
    return RunResult(periods, chosen, R.metric_sets(periods, per_year), target, per_year)


def _selected(data: DataFrame, days: Sequence[date], target: str, n: int, make_model: Callable[[], SelectionModel], screen: bool, at_once: int) -> DataFrame | None:
    """Stored selections of all ``days``; none without a day."""
    context = data.sparkSession.sparkContext

    def one(day: date, model: SelectionModel) -> DataFrame:
        known = data.where((F.col("outcome_date") < F.lit(day)) & F.col(target).isNotNull())
        model.fit(known, target)
        test = model.fill(data.where(F.col("public_date") == F.lit(day)))
        if screen:
            test = T.drop_outliers(materialize(T.outlier_shares(test, model.features)))
        # One date's cross-section is stored before it is ranked, which reads it several times.
        scored = materialize(model.predict(test))
        return materialize(select_top(final_scores(scored, weight=model.roe_weight), n).select(
            "public_date", "TICKER", "sector", target, "position", "model_score", "predicted_rank"))

    @inheritable_thread_target(data.sparkSession)
    def pooled(day: date, medians: dict[str, float] | None) -> DataFrame:
        context.setLocalProperty("spark.scheduler.pool", "walk-forward")
        model = make_model()
        if medians is not None:
            model.medians = medians
        return one(day, model)

    first, rest, medians = make_model(), list(days), None
    parts = []
    if first.freeze_medians and rest:
        parts.append(one(rest.pop(0), first))
        medians = first.medians
    with ThreadPoolExecutor(max(1, at_once)) as pool:
        parts += list(pool.map(lambda day: pooled(day, medians), rest))
    out: DataFrame | None = None
    for part in parts:
        out = part if out is None else out.unionByName(part)
    return out


def score_latest(panel: DataFrame, n: int = C.N_STOCKS, make_model: Callable[[], SelectionModel] = SelectionModel) -> DataFrame:
    """Selection for the latest date, trained on rows at least three months older, on the first return column present."""
    target = next((c for c in ("3mo_return", "1yr_return", "6mo_return", "1mo_return") if c in panel.columns), None)
    if target is None:
        raise ValueError("no return column in the panel")
    latest = panel.agg(F.max("public_date")).first()[0]
    day = F.lit(latest)
    model = make_model().fit(panel.where(F.col("public_date") <= F.add_months(day, -3)), target)
    return model.select(panel.where(F.col("public_date") == day), n)
