"""Operators on small hand-made tables, against plain Python or the numbers they must give."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalens.functions import columns as X
from stratalens.operators.asof import asof_join, asof_nearest
from stratalens.operators.quantile import exact_quantiles
from stratalens.operators.rank import pct_rank
from stratalens.operators.scan import PIECE, linear_scan, ranged, reflected_position, running_sums
from stratalens.operators.winsor import winsorize
from stratalens.plans import features as T
from stratalens.plans import panel as P

D = dt.date


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values))
    return row.select(column.alias("x")).first()["x"]


def test_asof_boundaries_and_ties(spark):
    left = spark.createDataFrame([("a", D(2020, 1, 31)), ("a", D(2020, 2, 29)), ("b", D(2020, 1, 31))], "k string, t date")
    right = spark.createDataFrame([("a", D(2020, 1, 31), 1, None), ("a", D(2020, 2, 10), 1, 5.0), ("a", D(2020, 2, 10), 2, None)], "k string, r date, n int, v double")
    for bucket in (None, lambda d: F.trunc(d, "month")):
        strict = {(r.k, r.t): (r.n, r.v) for r in asof_join(left, right, ["k"], "t", "r", ["n", "v"], strict=True, ties=["n"], bucket=bucket).collect()}
        assert strict == {("a", D(2020, 1, 31)): (None, None), ("a", D(2020, 2, 29)): (2, None), ("b", D(2020, 1, 31)): (None, None)}
        loose = {(r.k, r.t): r.n for r in asof_join(left, right, ["k"], "t", "r", ["n"], ties=["n"], bucket=bucket).collect()}
        assert loose[("a", D(2020, 1, 31))] == 1


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("strict", [False, True])
def test_asof_bucketed_equals_plain_and_brute_force(spark, direction, strict):
    rnd = random.Random(3)
    # One key holds most of the rows.
    key = lambda: "hot" if rnd.random() < 0.7 else rnd.choice("xyz")
    lrows = [(key(), rnd.randrange(400), i) for i in range(300)]
    rrows = list({(key(), rnd.randrange(400)): None for _ in range(120)})
    left = spark.createDataFrame(lrows, "k string, t long, i long")
    right = spark.createDataFrame(rrows, "k string, r long")
    got = asof_join(left, right, ["k"], "t", "r", ["r"], strict=strict, direction=direction, bucket=lambda c: F.floor(c / 25))

    def want(k, t):
        if direction == "backward":
            c = [r for q, r in rrows if q == k and (r < t if strict else r <= t)]
            return max(c, default=None)
        c = [r for q, r in rrows if q == k and (r > t if strict else r >= t)]
        return min(c, default=None)

    assert {r.i: r.r for r in got.collect()} == {i: want(k, t) for k, t, i in lrows}


def test_nearest_prefers_the_later_day(spark):
    left = spark.createDataFrame([("s", D(2020, 1, 5)), ("s", D(2020, 1, 1))], "k string, d date")
    right = spark.createDataFrame([("s", D(2020, 1, 3), 1.0), ("s", D(2020, 1, 7), 2.0)], "k string, e date, v double")
    assert {r.d.day: r.v for r in asof_nearest(left, right, ["k"], "d", "e", ["v"]).collect()} == {5: 2.0, 1: 1.0}


@pytest.mark.parametrize("values", [[1.0], [1.0, 2.0], [5.0] * 50 + [1.0, 9.0], [float(i * i % 97) for i in range(1000)]])
def test_exact_quantiles(spark, values):
    df = spark.createDataFrame([("g", v) for v in values] + [("n", None)], "g string, v double")
    probs = [0.0, 0.01, 1 / 3, 0.5, 0.995, 1.0]
    got = {r.prob: r.q for r in exact_quantiles(df, ["g"], "v", probs).collect() if r.g == "g"}
    for p in probs:
        assert got[p] == pytest.approx(np.quantile(values, p))
    whole = exact_quantiles(df, [], "v", [0.5]).first()
    assert whole.q == pytest.approx(np.median(values)) and whole.n == len(values)


def test_quantiles_of_a_large_skewed_group(spark):
    n = 200_000
    df = spark.range(n).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 30)).alias("g"),
                               F.when(F.col("id") % 2 == 0, F.lit(7.0)).otherwise(F.xxhash64("id") / 1e16).alias("v"))
    want = {r.g: r.m for r in df.groupBy("g").agg(F.median("v").alias("m")).collect()}
    got = {r.g: r.q for r in exact_quantiles(df, ["g"], "v", [0.5]).collect()}
    assert got == pytest.approx(want)


def test_pct_rank_averages_ties(spark):
    values = [3.0, 1.0, 3.0, None, 2.0, 3.0]
    df = spark.createDataFrame([("d", i, v) for i, v in enumerate(values)], "d string, i int, v double")
    got = {r.i: r.p for r in pct_rank(df, ["d"], "v", "p").collect()}
    assert got == {0: 0.8, 1: 0.2, 2: 0.8, 3: None, 4: 0.4, 5: 0.8}


def test_running_totals_and_recurrences(spark):
    rnd = random.Random(5)
    rows = [("hot" if rnd.random() < 0.8 else "cold", i, float(rnd.choice([-3, -1, 2, 4])), rnd.random(), rnd.random()) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, t long, x double, keep double, add double")
    bucket = F.floor(F.col("t") / 40)
    run = {r.t: r.s for r in running_sums(df, ["k"], bucket, ["t"], {"s": F.col("x")}).collect()}
    low = {r.t: r.h for r in reflected_position(df, ["k"], bucket, ["t"], F.col("x"), "h").collect()}
    lin = {r.t: r.y for r in linear_scan(df, ["k"], bucket, ["t"], "keep", "add", "y", block=7).collect()}
    s, h, y = {}, {}, {}
    for k, t, x, keep, add in rows:
        s[k], h[k], y[k] = s.get(k, 0.0) + x, max(h.get(k, 0.0) + x, 0.0), keep * y.get(k, 0.0) + add
        assert run[t] == s[k] and low[t] == h[k] and lin[t] == pytest.approx(y[k])


def test_a_hot_day_is_shared_out_evenly(spark):
    rnd = random.Random(6)
    day = dt.datetime(2020, 5, 4)
    rows = [("hot", day, i, float(rnd.choice([-3, -1, 2, 4]))) for i in range(4000)]
    rows += [(f"k{i % 50}", day + dt.timedelta(days=i % 300), i, float(rnd.choice([-3, 2]))) for i in range(4000, 8000)]
    laid = ranged(spark.createDataFrame(rows, "k string, ts timestamp, i long, x double").repartition(4), ["k"], ["ts", "i"])
    sizes = [r["count"] for r in laid.groupBy(PIECE).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1.5 * min(sizes)
    assert laid.where("k = 'hot'").select(PIECE).distinct().count() >= 4
    sums = {r.i: r.s for r in running_sums(laid, ["k"], F.col(PIECE), ["ts", "i"], {"s": F.col("x")}).collect()}
    low = {r.i: r.h for r in reflected_position(laid, ["k"], F.col(PIECE), ["ts", "i"], F.col("x"), "h").collect()}
    s, h = {}, {}
    for k, _, i, x in sorted(rows, key=lambda r: (r[1], r[2])):
        s[k], h[k] = s.get(k, 0.0) + x, max(h.get(k, 0.0) + x, 0.0)
        assert sums[i] == s[k] and low[i] == h[k]


@pytest.mark.parametrize(("strict", "direction"), [(False, "backward"), (True, "backward"), (False, "forward"), (True, "forward")])
def test_asof_over_ranges(spark, strict, direction):
    rnd = random.Random(7)
    key = lambda: "hot" if rnd.random() < 0.7 else f"k{rnd.randrange(5)}"
    left = [(key(), rnd.randrange(300), i) for i in range(600)] + [("hot", None, 900)]
    right = list({(k, t): (k, t, n) for n, (k, t) in enumerate((key(), rnd.randrange(300)) for _ in range(250))}.values())
    got = asof_join(spark.createDataFrame(left, "k string, t int, i int"), spark.createDataFrame(right, "k string, r int, n int"), ["k"], "t", "r", ["n"], strict=strict, direction=direction, spread=True)
    found = {r.i: r.n for r in got.collect()}
    assert len(found) == len(left)
    for k, t, i in left:
        sign = 1 if direction == "backward" else -1
        hits = [(sign * r, n) for q, r, n in right if q == k and t is not None and (sign * r < sign * t or r == t and not strict)]
        assert found[i] == (max(hits)[1] if hits else None)


def test_pct_rank_in_many_slices(spark):
    rnd = random.Random(8)
    rows = [(d, i, None if rnd.random() < 0.1 else float(rnd.randrange(90))) for d, n in (("big", 500), ("small", 3)) for i in range(n)] + [("none", 0, None)]
    got = {(r.d, r.i): r.p for r in pct_rank(spark.createDataFrame(rows, "d string, i int, v double"), ["d"], "v", "p", slice_rows=20).collect()}
    for d, i, v in rows:
        known = [x for e, _, x in rows if e == d and x is not None]
        assert got[d, i] == (None if v is None else pytest.approx((sum(x < v for x in known) + (sum(x == v for x in known) + 1) / 2) / len(known)))
    assert len(got) == len(rows)


def test_winsorize(spark):
    df = spark.createDataFrame([(float(v), 1.0, v) for v in (1, 2, 3, 4, 5, 100)] + [(None, 1.0, 7)], "ratio1 double, flat double, i int")
    out = {r.i: (r.ratio1, r.flat) for r in winsorize(df, ["ratio1", "flat"], 3.0).collect()}
    assert out[100][0] == 8.0 and out[1] == (1.0, 1.0) and out[7][0] is None


def test_trailing_sum(spark):
    df = spark.createDataFrame([("A", q, float(v), float(v) / 10) for q, v in enumerate((100, 110, 105, 115, 120, 130, 125, 135))], "ticker string, q int, revenue double, net_income double")
    out = [r.revenue_ttm for r in P.trailing_sums(df, ["revenue", "net_income"], order=["q"]).orderBy("q").collect()]
    assert out == [None, None, None, 430.0, 450.0, 470.0, 490.0, 510.0]


def test_forward_returns(spark):
    ends = [D(2020, 1, 31), D(2020, 2, 29), D(2020, 3, 31), D(2020, 4, 30), D(2020, 5, 31), D(2020, 6, 30)]
    rows = [("A", d, p) for d, p in zip(ends, (100.0, 110.0, 105.0, 120.0, 115.0, 130.0))]
    out = T.forward_returns(spark.createDataFrame(rows, "TICKER string, public_date date, MthPrc double"), 3).orderBy("public_date").collect()
    assert out[0]["3mo_return"] == pytest.approx(0.20) and out[-1]["3mo_return"] is None
    gap = spark.createDataFrame([rows[0], rows[1], rows[4], rows[5]], "TICKER string, public_date date, MthPrc double")
    assert T.forward_returns(gap, 2).orderBy("public_date").first()["2mo_return"] is None


def test_month_rows_agree_with_and_without_ties(spark):
    rows = [("T", "1" if d < 20 else "2", D(2020, 1, d), float(d), 1.0, None if d % 2 else float(d)) for d in (3, 17, 21, 30)] + [("T", "2", D(2020, 3, 2), 9.0, None, 4.0)]
    df = spark.createDataFrame(rows, "ticker string, id string, date date, adj_close double, dividend double, shares double")
    a = sorted(map(tuple, P.last_rows_of_month(df).collect()))
    assert a == sorted(map(tuple, P.last_rows_of_month(df, ["adj_close"]).collect()))
    assert a[0][2:6] == ("2", 30.0, 30.0, 4.0)
    bars = {r.public_date: r for r in P.month_bars(df).collect()}
    assert bars[D(2020, 1, 31)]["1mo_return"] is None and bars[D(2020, 3, 31)].Div_ttm == 4.0


def test_month_rows_are_moved_before_they_are_sorted(spark):
    """Ties need a sort; whole input splits are not sorted, only what one exchange has dealt out by ticker and month."""
    df = spark.range(4000).selectExpr("concat('T', id % 50) ticker", "'1' id", "date_add(date'2020-01-01', cast(id % 90 as int)) date",
                                      "cast(id as double) adj_close", "1D dividend", "2D shares", "id tie")
    got = P.last_rows_of_month(df, ["tie"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Sort" not in plan.split("Exchange")[-1]
    want = {}
    for r in df.collect():
        key = (r.ticker, r.date.year, r.date.month)
        want[key] = max(want.get(key, (r.date, -1)), (r.date, r.tie))
    assert {(r.TICKER, r.public_date.year, r.public_date.month): (r.last_date, int(r.MthPrc)) for r in got.collect()} == want


def test_expressions(spark):
    period = X.fiscal_period(F.col("p"))
    assert [one(spark, period, p=p) for p in ("1", "q2 ", "3Q", "fy")] == ["Q1", "Q2", "Q3", "FY"]
    assert [one(spark, X.is_domestic_ticker(F.col("t")), t=t) for t in ("A", "MSFY", "ABCDF", "ABCDEY", "ABCDO")] == [False, True, False, False, True]
    assert [one(spark, X.is_common_stock(F.col("t")), t=t) for t in ("Common Stock", "Preferred Stock", "Equity Fund", "bond")] == [True, False, False, False]
    assert [one(spark, X.is_financial(F.col("s"), F.col("i")), s=s, i=i) for s, i in (("Financials", "x"), ("Tech", "Regional Banks"), ("Tech", "x"))] == [True, True, False]
    assert one(spark, X.to_number(F.col("t")), t="NaN") is None and one(spark, X.to_number(F.col("t")), t="x1") is None
    caps = [one(spark, X.cap_bucket(F.col("c")), c=c) for c in (1e6, 50e6, 1e9, 5e9, 1e11, 1e12)]
    assert caps == ["Nano Cap", "Micro Cap", "Small Cap", "Mid Cap", "Large Cap", "Mega Cap"]
    due = [one(spark, X.cgt_payment_due(F.col("d")), d=d) for d in (D(2024, 9, 30), D(2024, 10, 1))]
    assert due == [D(2024, 12, 15), D(2025, 1, 31)]


def test_commissions(spark):
    q, p = F.col("q"), F.col("p")
    fee = lambda a, b, **k: one(spark, X.commission(q, p, **k), q=float(a), p=float(b))
    assert fee(1000, 50, exchange=False) == pytest.approx(3.50)
    assert fee(100, 50, pricing="fixed") == pytest.approx(1.00)
    assert fee(10, 50, exchange=False) == pytest.approx(0.35)
    assert fee(1, 5, exchange=False) == pytest.approx(0.05)
    assert fee(0, 50) == 0.0 and fee(10, 0) == 0.0


def test_neutralized_groups_have_mean_zero(spark):
    rows = [(f"s{i % 3}", D(2020, 1 + i % 2, 28), float(i * 7 % 13), float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "sector string, public_date date, bm double, MthCap double")
    out = T.neutralize(df, ["bm", "MthCap"])
    for r in out.groupBy("sector", "public_date").agg(F.avg("bm").alias("m"), F.stddev("bm").alias("s")).collect():
        assert abs(r.m) < 1e-12 and r.s == pytest.approx(1.0)
    assert out.agg(F.sum("MthCap")).first()[0] == sum(r[3] for r in rows)


def test_fifo_edges(spark):
    """A sale of nothing costs nothing; a trade without a time comes before all others, and is neither lost nor counted twice."""
    from stratalens.plans import ledger

    rows = [("a", "x", "2020-01-05 10:00:00", "1", "BUY", 10.0, 12.0, 0.0), ("a", "x", "2020-02-05 10:00:00", "2", "SELL", 0.0, 15.0, 0.0),
            ("a", "x", "2020-02-06 10:00:00", "3", "SELL", 10.0, 15.0, 0.0), ("a", "x", None, "0", "BUY", 5.0, 2.0, 0.0), ("a", "x", "2020-03-06 10:00:00", "4", "SELL", 5.0, 15.0, 0.0)]
    trades = spark.createDataFrame(rows, "account string, symbol string, ts string, trade_id string, side string, quantity double, price double, fee double")
    trades = trades.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("quantity", F.col("quantity").cast("decimal(18,6)"))
    got = {r.trade_id: (r.cost_basis, r.lots_used) for r in ledger.disposals(trades).collect()}
    assert got == {"2": (0.0, 0), "3": (70.0, 2), "4": (60.0, 1)}
    assert {r.trade_id: float(r.holding) for r in ledger.running_holding(trades).collect()} == {"0": 5, "1": 15, "2": 15, "3": 5, "4": 0}


def test_macro_over_missing_months(spark):
    """Readings of a file become month ends and changes over calendar months, whole missing months filled."""
    from stratalens.plans.panel import macro_features

    rows = [("2020-01-10", 100.0, 1.0), ("2020-01-20", 110.0, 1.0), ("2020-03-05", 121.0, 2.0), ("2021-01-31", 132.0, 4.0), (None, 5.0, 5.0)]
    series = spark.createDataFrame(rows, "public_date string, GDP double, FEDFUNDS double").withColumn("public_date", F.col("public_date").cast("date"))
    got = {str(r.public_date)[:7]: r for r in macro_features(series).collect()}
    assert len(got) == 13 and got["2020-02"].GDP == 110 and got["2020-02"]["1mo_GDP"] == 0
    assert abs(got["2020-03"]["1mo_GDP"] - 0.1) < 1e-12 and abs(got["2021-01"]["1yr_GDP"] - 0.2) < 1e-12 and got["2020-12"]["1yr_GDP"] is None


def test_late_prices_are_kept(spark, tmp_path):
    """A new ticker's old history that arrives after newer dates enters; a day already stored does not enter again."""
    from stratalens.streaming import ingest

    landing, table, checkpoint = (str(tmp_path / n) for n in ("landing", "table", "checkpoint"))
    deliveries = [[("A", "1", "2020-06-01", 1.0), ("A", "1", "2020-06-02", 2.0)], [("B", "2", "2010-01-04", 3.0), ("B", "2", "2020-06-03", 4.0), ("A", "1", "2020-06-02", 9.0)]]
    for rows in deliveries:
        df = spark.createDataFrame([(t, i, d, p, 0.0, 1.0) for t, i, d, p in rows], "ticker string, id string, date string, adj_close double, dividend double, shares double")
        df.withColumn("date", F.col("date").cast("date")).write.mode("append").parquet(landing)
        ingest.append_prices(ingest.price_stream(spark, landing), table, checkpoint).awaitTermination()
    got = sorted((r.ticker, str(r.date), r.adj_close) for r in spark.read.parquet(table).collect())
    assert got == [("A", "2020-06-01", 1.0), ("A", "2020-06-02", 2.0), ("B", "2010-01-04", 3.0), ("B", "2020-06-03", 4.0)]


def test_new_days_read_no_stored_month(spark, tmp_path):
    """Days that no earlier batch brought are known to be new without the stored prices; a day that one brought names its month."""
    from stratalens.streaming import ingest

    table = str(tmp_path / "table")

    def met(batch_id, *days):
        rows = spark.createDataFrame([("A", d) for d in days], "ticker string, date string").select("ticker", F.col("date").cast("date").alias("date"))
        return [str(m) for m in ingest._months_met(rows, batch_id, table)]

    assert met(0, "2020-06-01", "2020-06-02") == []
    assert met(1, "2020-06-03", "2020-07-01") == []  # new days in a stored month
    assert met(1, "2020-06-03", "2020-07-01") == []  # the same batch once more
    assert met(2, "2020-06-02", "2020-08-01") == ["2020-06-30"]


def test_a_late_statement_rewrites_its_own_months(spark, tmp_path):
    """A statement counts until the next one of its ticker; only these months are written, and the panel is that of a whole merge."""
    from stratalens.plans.panel import merge_point_in_time
    from stratalens.streaming import ingest

    months = [f"2020-{m:02d}-28" for m in range(1, 13)]
    bars = spark.createDataFrame([(t, m) for t in ("A", "B") for m in months], "TICKER string, public_date string").withColumn("public_date", F.col("public_date").cast("date"))
    deliveries = [[("A", "2020-01-10", 1.0), ("A", "2020-08-10", 3.0), ("B", "2020-01-10", 5.0)], [("A", "2020-04-10", 2.0)], [(None, "2020-05-10", 9.0), ("B", None, 9.0)], [("B", "2020-10-10", 6.0)]]
    landing, statements, panel, checkpoint = (str(tmp_path / n) for n in ("landing", "statements", "panel", "checkpoint"))
    fields = "ticker string, publish_date string, value double"
    seen, files = [], lambda: {p.parent.name: p.name for p in (tmp_path / "panel").glob("public_date=*/*.parquet")}
    touched = []
    for rows in deliveries:
        seen += rows
        df = spark.createDataFrame(rows, fields).withColumns({"publish_date": F.col("publish_date").cast("date"), "fiscal_year": F.lit(2020), "fiscal_period": F.lit("Q1")})
        df.write.mode("append").parquet(landing)
        before = files()
        ingest.maintain_point_in_time(spark.readStream.schema(df.schema).parquet(landing), statements, bars, panel, checkpoint).awaitTermination()
        touched.append(sorted(k[-10:] for k, v in files().items() if before.get(k) != v))
        known = spark.createDataFrame(seen, fields).withColumns({"publish_date": F.col("publish_date").cast("date"), "fiscal_year": F.lit(2020), "fiscal_period": F.lit("Q1")})
        want = {(r.TICKER, r.public_date, r.value) for r in merge_point_in_time(bars, known, 1).collect()}
        assert {(r.TICKER, r.public_date, r.value) for r in spark.read.parquet(panel).collect()} == want
    assert touched == [months, months[4:8], [], months[10:]]


def test_stream_positions_in_any_order_of_arrival(spark, tmp_path):
    """Shuffled deliveries within the delay give the positions of the whole table in time order."""
    import random

    from stratalens.plans import ledger
    from stratalens.streaming import ingest

    rng = random.Random(5)
    rows = [(rng.choice("ab"), rng.choice("xy"), f"2020-01-{i // 4 + 1:02d} {i % 4 + 10}:00:00", f"{i:03d}", rng.choice(["BUY", "BUY", "SELL"]), float(rng.randint(1, 9)), float(rng.randint(5, 20)), 0.0) for i in range(80)]
    schema = "account string, symbol string, ts string, trade_id string, side string, quantity double, price double, fee double"
    table = lambda part: spark.createDataFrame(part, schema).withColumn("ts", F.col("ts").cast("timestamp"))
    landing, out, checkpoint = (str(tmp_path / n) for n in ("landing", "out", "checkpoint"))
    parts = [rows[:40], rows[40:]]
    late = [r for r in parts[0] if r[2] >= "2020-01-08" and rng.random() < 0.5]  # these arrive with the next delivery
    parts = [[r for r in parts[0] if r not in late], parts[1] + late, [("end", "x", "2021-01-01 00:00:00", "999", "BUY", 1.0, 1.0, 0.0)]]
    assert late
    for part in parts:
        rng.shuffle(part)
        df = table(part)
        df.coalesce(1).write.mode("append").parquet(landing)
        stream = ingest.running_positions(spark.readStream.schema(df.schema).parquet(landing), "7 days")
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    got = {r.trade_id: (r.shares, round(r.total_cost, 6)) for r in spark.read.parquet(out).collect()}
    assert got == {r.trade_id: (r.shares, round(r.total_cost, 6)) for r in ledger.running_positions(table(rows)).collect()}


def test_keys_of_a_bucket_share_their_state_calls():
    """Hundreds of keys in one bucket, in two arrivals, cost as many calls into the state as one key, and lose no trade."""
    import random
    from collections import Counter
    from types import SimpleNamespace

    import pandas as pd

    from stratalens.streaming import ingest

    calls, timers = Counter(), []

    class State:
        def __init__(self):
            self.rows = []

        def __getattr__(self, name):
            def call(*given):
                calls[name] += 1
                if name == "appendList":
                    self.rows += given[0]
                elif name in ("put", "update"):
                    self.rows = given[0] if name == "put" else [given[0]]
                elif name == "clear":
                    self.rows = []
                return bool(self.rows) if name == "exists" else self.rows
            return call

    class Value(State):
        def get(self):
            calls["get"] += 1
            return self.rows[0]

    class Handle:
        def getValueState(self, *_):
            return Value()

        def getListState(self, *_):
            return State()

        def registerTimer(self, at):
            timers.append(at)

    rng = random.Random(7)
    trades = [(f"A{rng.randint(0, 4)}", f"S{rng.randint(0, 99)}", rng.randint(0, 10**6), f"{i:05d}", rng.choice(["BUY", "BUY", "SELL"]), float(rng.randint(1, 9)), float(rng.randint(5, 20))) for i in range(4000)]
    late = [t for t in trades if t[2] > 400_000 and rng.random() < 0.5]
    frame = lambda rows: pd.DataFrame(rows, columns=["account", "symbol", "at", "trade_id", "side", "quantity", "price"])
    replay, got = ingest._Replay(), {}
    replay.init(Handle())
    for part, passed in (([t for t in trades if t not in set(late)], 400), (late, 2000)):
        assert list(replay.handleInputRows((1,), iter([frame(part[:500]), frame(part[500:])]), None)) == []
        for out in replay.handleExpiredTimer((1,), SimpleNamespace(getCurrentWatermarkInMs=lambda at=passed: at), None):
            got |= {r.trade_id: (r.shares, r.total_cost) for r in out.itertuples()}
    held, want = {}, {}
    for account, symbol, _, trade, side, q, price in sorted(trades, key=lambda t: (t[2], t[3])):
        n, cost = held.get((account, symbol), (0.0, 0.0))
        n, cost = (n + q, cost + q * price) if side == "BUY" else (0.0, 0.0) if q >= n else (n - q, cost * (n - q) / n)
        held[account, symbol] = want[trade] = n, cost
    assert got == want
    assert sum(calls.values()) + len(timers) < 20
