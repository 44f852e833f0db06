"""Options that keep an older behaviour, each against the default."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalens.operators.winsor import winsorize
from stratalens.plans import panel as P
from stratalens.plans import selection as L
from stratalens.plans import walkforward as K
from stratalens.plans.model import SelectionModel

D = dt.date


def month_end(i):
    return D(2018 + (i + 1) // 12, (i + 1) % 12 + 1, 1) - dt.timedelta(days=1)


def research_panel(spark, months=36, tickers=40):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(months):
        for t in range(tickers):
            f = rng.normal(size=2) + i / 10
            rows.append((f"TK{t:02d}", month_end(i), f"s{t % 4}", float(f[0]), float(f[1]), 100.0 + t, float(0.3 * f[0] + rng.normal() * 0.2)))
    return spark.createDataFrame(rows, "TICKER string, public_date date, sector string, bm double, roe double, MthCap double, `6mo_return` double")


def test_keywords_choose_the_clipped_columns(spark):
    rows = [(f"T{i}", 1.0 + i / 100, 2.0 + i / 100, 3.0 + i / 100 if i else 1e6, "x", 10.0) for i in range(50)]
    d = spark.createDataFrame(rows, "TICKER string, bm double, roe double, turnover_raw double, cash_text string, MthPrc double")
    usual, words = P.winsor_columns(d), P.winsor_columns(d, legacy_keywords=True)
    assert set(usual) == {"bm", "roe"} and set(words) == {"bm", "roe", "turnover_raw"}
    highest = lambda columns: winsorize(d, columns, 5.0).agg(F.max("turnover_raw")).first()[0]
    assert highest(usual) == 1e6 and highest(words) < 10


def test_outcome_dates_with_and_without_the_month_end(spark):
    d = spark.createDataFrame([("ABCD", D(2020, 2, 29))], "TICKER string, public_date date")
    assert [L.prepare(d, "3mo_return", snap).first().outcome_date for snap in (True, False)] == [D(2020, 5, 31), D(2020, 5, 29)]


@pytest.mark.parametrize("frozen", [False, True])
def test_medians_of_the_first_fit(spark, frozen):
    d = research_panel(spark, 20)
    model = SelectionModel("ridge", freeze_medians=frozen)
    model.fit(d.where(F.col("public_date") < "2019-01-01"), "6mo_return")
    first = dict(model.medians)
    model.fit(d, "6mo_return")
    assert (model.medians == first) == frozen


@pytest.mark.parametrize("legacy", [False, True])
def test_half_years_and_index_months(spark, legacy):
    """Frequency S rebalances in June and December on six-month returns; the index is held as long, or three months by the option."""
    days = [D(2018, 1, 1) + dt.timedelta(days=i) for i in range(1400)]
    level = {d: 100.0 * 1.0005**i for i, d in enumerate(days)}
    index = spark.createDataFrame(list(level.items()), "date date, level double")
    result = K.run(research_panel(spark), index, "2018-01-01", "2020-12-31", freq="S", n=5, make_model=lambda: SelectionModel("ridge"), legacy_index_months=legacy)
    got = {r.public_date: r.index_return for r in result.periods.collect()}
    ends = {D(2019, 12, 31): D(2020, 6, 30), D(2020, 6, 30): D(2020, 12, 30), D(2020, 12, 31): D(2021, 6, 30)}
    if legacy:
        ends = {D(2019, 12, 31): D(2020, 3, 31), D(2020, 6, 30): D(2020, 9, 30), D(2020, 12, 31): D(2021, 3, 31)}
    assert result.target == "6mo_return" and result.periods_per_year == 2
    assert got == pytest.approx({a: level[b] / level[a] - 1 for a, b in ends.items()})
