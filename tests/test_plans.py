"""Plans against exact numbers, closed forms and invariants."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalens.plans import features, model
from stratalens.plans import ledger as L
from stratalens.plans import metrics as M
from stratalens.plans import orders as O
from stratalens.plans import tax as T
from stratalens.plans.model import SelectionModel

TS = dt.datetime
TRADES = "account string, symbol string, ts timestamp_ntz, trade_id string, side string, quantity double, price double, fee double"


def trades(spark, *rows):
    return spark.createDataFrame([("a", s, TS(2024, 1, d), f"{i:03d}", side, float(q), float(p), 0.0) for i, (s, d, side, q, p) in enumerate(rows)], TRADES)


def test_fifo(spark):
    t = trades(spark, ("X", 1, "BUY", 100, 100), ("X", 2, "BUY", 100, 150), ("X", 3, "SELL", 150, 175))
    r = L.disposals(t).first()
    assert (r.cost_basis, r.proceeds, r.gain, r.lots_used, r.holding_days, r.is_loss) == (17500.0, 26250.0, 8750.0, 2, 2, False)
    left = L.holdings_summary(t).first()
    assert (left.shares, left.avg_cost, left.n_lots) == (50.0, 150.0, 1)


def test_refused_sale_leaves_the_lots(spark):
    t = trades(spark, ("X", 1, "BUY", 100, 100), ("X", 2, "SELL", 150, 120), ("X", 3, "SELL", 60, 120), ("Y", 1, "SELL", 1, 5), ("Z", 1, "BUY", 1, 1))
    flags = {r.trade_id: r.rejected for r in L.mark_rejected(t).collect()}
    assert flags == {"000": False, "001": True, "002": False, "003": True, "004": False}
    assert {(r.symbol, r.shares) for r in L.holdings_summary(L.accepted(t)).collect()} == {("X", 40.0), ("Z", 1.0)}


def test_fractional_fifo_equals_a_sequential_one(spark):
    rnd = random.Random(11)
    rows, held, lots, want = [], 0.0, [], {}
    for i in range(300):
        if held < 5 or rnd.random() < 0.55:
            q = round(rnd.uniform(0.1, 20), 4)
            rows.append(("X", i // 12 + 1, "BUY", q, rnd.uniform(10, 20)))
            lots.append([q, rows[-1][4]])
            held += q
        else:
            q = round(rnd.uniform(0.01, held), 4)
            rows.append(("X", i // 12 + 1, "SELL", q, 30.0))
            held, need, cost = held - q, q, 0.0
            for lot in lots:
                take = min(lot[0], need)
                cost, need, lot[0] = cost + take * lot[1], need - take, lot[0] - take
            want[f"{i:03d}"] = cost
    t = trades(spark, *rows)
    got = {r.trade_id: r.cost_basis for r in L.disposals(t).collect()}
    assert got == pytest.approx(want, rel=1e-9, abs=1e-6)
    matched = {r.sale_id: r.s for r in L.lot_matches(t).groupBy("sale_id").agg(F.sum("shares").alias("s")).collect()}
    assert matched == pytest.approx({f"{i:03d}": r[3] for i, r in enumerate(rows) if r[2] == "SELL"})


def test_positions(spark):
    t = trades(spark, ("X", 1, "BUY", 100, 100), ("X", 2, "BUY", 100, 150), ("X", 3, "SELL", 50, 170), ("Y", 1, "BUY", 10, 5), ("Y", 2, "SELL", 10, 6), ("Y", 3, "BUY", 4, 7))
    assert {r.symbol: (r.shares, r.avg_cost) for r in L.positions(t).collect()} == {"X": (150.0, 125.0), "Y": (4.0, 7.0)}


def disposal_rows(spark, *gains):
    return spark.createDataFrame([("a", TS(2024, 5, 1), 0.0, 0.0, float(g), g < 0) for g in gains], "account string, ts timestamp_ntz, proceeds double, cost_basis double, gain double, is_loss boolean")


def test_tax_numbers(spark):
    r = T.cgt_summary(disposal_rows(spark, 5000, -2500)).first()
    assert (r.gross_gains, r.gross_losses, r.net_gain, r.taxable_gain) == (5000.0, 2500.0, 2500.0, 1230.0) and r.estimated_tax == pytest.approx(405.90)
    small = T.cgt_summary(disposal_rows(spark, 500)).first()
    assert small.estimated_tax == 0.0 and small.remaining_exemption == 770.0
    wanted = spark.createDataFrame([("a", "X", 50.0, 150.0)], "account string, symbol string, shares double, price double")
    w = L.what_if(trades(spark, ("X", 1, "BUY", 100, 100)), wanted, 0.33, 1270.0).first()
    assert (w.proceeds, w.cost_basis, w.gain) == (7500.0, 5000.0, 2500.0)


def test_dividends(spark):
    rows = [("a", "X", dt.date(2024, m, 1), 100.0, 0.25, None, None) for m in (1, 4, 7)] + [("b", "Y", dt.date(2024, 1, 1), None, None, 100.0, 85.0)]
    d = T.dividends(spark.createDataFrame(rows, "account string, symbol string, payment_date date, shares double, per_share double, gross double, net double"))
    s = {r.account: r for r in T.dividend_summary(d).collect()}
    assert (s["a"].total_gross, s["a"].total_withholding, s["a"].total_net) == (75.0, 11.25, 63.75)
    b = d.where("account = 'b'").first()
    assert (b.withholding_amount, b.withholding_rate) == (15.0, 0.15)


def test_rebalance(spark):
    held = spark.createDataFrame([(1, "AAPL", 100.0), (1, "MSFT", 50.0)], "account long, symbol string, shares double")
    goal = spark.createDataFrame([(1, "MSFT", 0.9, "Tech"), (1, "GOOGL", 0.8, "Tech")], "account long, symbol string, predicted_rank double, sector string")
    value = spark.createDataFrame([(1, 30000.0)], "account long, account_value double")
    price = spark.createDataFrame([("AAPL", 180.0), ("MSFT", 400.0), ("GOOGL", 140.0)], "symbol string, price double")
    o = {r.symbol: r for r in O.rebalance_orders(held, goal, value, price).collect()}
    assert o["AAPL"].action == "SELL" and o["AAPL"].quantity == 100.0 and o["GOOGL"].action == "BUY" and o["MSFT"].reason == "rebalance sell"
    first = O.initial_orders(goal, value, price).collect()
    assert {r.symbol for r in first} == {"MSFT", "GOOGL"} and all(r.value <= 14700.1 for r in first)
    cost = O.rebalance_cost(spark.createDataFrame([("a", 100.0, 50.0), ("a", 50.0, 100.0), ("a", -75.0, 80.0), ("a", 0.0, 1.0)], "account string, shares double, price double")).first()
    assert cost.trade_count == 3 and cost.total_traded_value == 16000.0


def test_metrics(spark):
    rng = np.random.default_rng(42)
    s, b = rng.normal(0.02, 0.05, 20), rng.normal(0.015, 0.04, 20)
    days = [dt.date(2020 + i // 4, 3 * (i % 4) + 3, 28) for i in range(20)]
    df = spark.createDataFrame([("m", d, float(x), float(y)) for d, x, y in zip(days, s, b)] + [("none", days[0], None, None)], "strategy string, date date, ret double, bench double")
    out = {r.strategy: r for r in M.performance(df, bench="bench", periods_per_year=4).collect()}
    m = out["m"]
    total = np.prod(1 + s) - 1
    assert m.total_return == pytest.approx(total) and m.volatility == pytest.approx(np.std(s, ddof=1) * 2)
    cum = np.cumprod(1 + s)
    assert m.max_drawdown == pytest.approx(abs(((cum - np.maximum.accumulate(cum)) / np.maximum.accumulate(cum)).min()))
    assert m.beta == pytest.approx(np.cov(s, b)[0, 1] / np.var(b, ddof=1)) and m.win_rate == pytest.approx(np.mean(s > b))
    assert m.sharpe_ratio == pytest.approx(((1 + total) ** (4 / 20) - 1 - 0.02) / m.volatility)
    empty = out["none"]
    assert empty.n_periods == 0 and empty.total_return == 0 and empty.win_rate == 0
    assert M.performance(df.where("strategy = 'none'"), by=[], periods_per_year=4).first().n_periods == 0


def model_panel(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(800):
        f = rng.normal(size=3)
        rows.append((f"T{i % 40:02d}", dt.date(2018 + i // 480, i // 40 % 12 + 1, 28), f"s{i % 4}", *map(float, f), float(0.3 * f[0] - 0.1 * f[1] + rng.normal() * 0.2)))
    return spark.createDataFrame(rows, "TICKER string, public_date date, sector string, bm double, roe double, MthCap double, `3mo_return` double")


def test_ridge_equals_the_closed_form(spark):
    d = model_panel(spark)
    m = SelectionModel("ridge").fit(d, "3mo_return")
    rows = SelectionModel("ridge").training_rows(d, "3mo_return").toPandas()
    x = rows[m.features].to_numpy()
    x = (x - x.mean(0)) / x.std(0)
    y = rows["target_rank"].to_numpy()
    w = np.linalg.solve(x.T @ x + np.eye(x.shape[1]), x.T @ (y - y.mean()))
    assert np.allclose(m.fitted.coefficients.toArray(), w, atol=1e-10) and m.fitted.intercept == pytest.approx(y.mean())
    top = m.select(d.where(F.col("public_date") == d.agg(F.max("public_date")).first()[0]), 5).collect()
    assert len(top) == 5 and [r.position for r in sorted(top, key=lambda r: -r.predicted_rank)] == [1, 2, 3, 4, 5]
    assert m.importances(spark).first().feature == "bm"


def test_forest_ranks_like_the_signal(spark, tmp_path):
    d = model_panel(spark)
    m = SelectionModel("forest", params={"trees": 10, "depth": 4, "min_leaf": 5}).fit(d, "3mo_return")
    assert m.predict(d).stat.corr("model_score", "3mo_return") > 0.5
    m.save(str(tmp_path / "m"))
    back = SelectionModel.load(spark, str(tmp_path / "m"))
    assert back.features == m.features and back.predict(d).count() == d.count()


@pytest.mark.parametrize("column", ["commonStockSharesOutstanding", "sharesOutstanding", "Shares Outstanding"])
def test_shares_from_balance_sheets(spark, tmp_path, column):
    """Each of the vendor's names for share counts; a missing publish date falls back to the report date."""
    from stratalens.sources.readers import VendorB

    df = spark.createDataFrame([("A", "2020-03-31", "100"), ("A", "2020-06-30", None), ("B", "2020-03-31", "7")], "ticker string, day string, n string")
    df.select(F.col("ticker").alias("code"), F.col("day").alias("date"), F.col("n").alias(column)).write.parquet(str(tmp_path / "balance.parquet"))
    got = sorted((r.ticker, str(r.date), r.shares) for r in VendorB(spark, str(tmp_path)).shares().collect())
    assert got == [("A", "2020-03-31", 100.0), ("B", "2020-03-31", 7.0)]


def test_forest_parts_hold_every_tree(spark, tmp_path):
    d = spark.range(600).select(F.concat(F.lit("T"), "id").alias("TICKER"), F.lit("2020-01-31").cast("date").alias("public_date"), F.lit("A").alias("sector"),
                                (F.col("id") / 600).alias("roe"), F.rand(1).alias("bm"), (F.col("id") / 600 - 0.5).alias("3mo_return"))
    m = SelectionModel("forest", params={"trees": 50, "depth": 4, "min_leaf": 5}).fit(d, "3mo_return")
    assert [part.getNumTrees for part in m.fitted] == [21, 21, 8] and len({part.toDebugString.split("\n", 1)[1] for part in m.fitted}) == 3
    found = {r.feature: r.importance for r in m.importances(spark).collect()}
    assert sum(found.values()) == pytest.approx(1.0) and found["roe"] > found["bm"]
    row = d.limit(1)
    scores = [part.transform(m._vectors(row)).first() for part in m.fitted]
    mean = sum(s[part.getPredictionCol()] * part.getNumTrees for s, part in zip(scores, m.fitted)) / 50
    assert m._scored(m._vectors(row)).first().model_score == pytest.approx(mean)
    m.save(str(tmp_path / "parts"))
    back = SelectionModel.load(spark, str(tmp_path / "parts"))
    both = [{r.TICKER: r.model_score for r in x.predict(d).collect()} for x in (m, back)]
    assert both[0] == both[1] and len(both[0]) == 600


@pytest.mark.parametrize("key_rows", [1_000_000, 40])
def test_ledgers_move_ordinary_keys_once(spark, monkeypatch, key_rows):
    """Ordinary keys and, with a low limit, shared-out ones give the rows of a sequential replay; ordinary ones in one exchange."""
    from stratalens import constants as C

    monkeypatch.setattr(C, "KEY_ROWS", key_rows)
    rnd = random.Random(3)
    rows, cost, held, lots, avg = [], {}, {}, {}, {}
    for i in range(400):
        s = "XXXYZ"[i % 5]
        mine, price = lots.setdefault(s, []), round(rnd.uniform(10, 20), 2)
        have = sum(x[1] for x in mine)
        if have < 4 or rnd.random() < 0.6:
            q = rnd.randint(1, 9)
            mine.append([f"{i:03d}", q, price])
            avg[s] = (avg.get(s, 0.0) * have + q * price) / (have + q)
            rows.append((s, i // 20 + 1, "BUY", q, price))
        else:
            q = need = rnd.randint(1, have)
            while need:
                take = min(need, mine[0][1])
                cost[(f"{i:03d}", mine[0][0])] = take * mine[0][2]
                need, mine[0][1] = need - take, mine[0][1] - take
                if not mine[0][1]:
                    mine.pop(0)
            avg[s] = avg[s] if q < have else 0.0
            rows.append((s, i // 20 + 1, "SELL", q, price))
        held[f"{i:03d}"] = (sum(x[1] for x in mine), avg[s] or None)
    t = trades(spark, *rows)
    assert {(r.sale_id, r.lot_id): r.cost for r in L.lot_matches(t).collect()} == pytest.approx(cost)
    got = {r.trade_id: (r.cost_basis, r.lots_used) for r in L.disposals(t).collect()}
    for sale, (basis, used) in got.items():
        mine = [c for (x, _), c in cost.items() if x == sale]
        assert basis == pytest.approx(sum(mine)) and used == len(mine)
    assert len(got) == len({x for x, _ in cost})
    run = {r.trade_id: (r.shares, r.avg_cost) for r in L.running_positions(t).collect()}
    assert {k: v[0] for k, v in run.items()} == {k: v[0] for k, v in held.items()}
    for k, (_, mean) in held.items():
        assert (run[k][1] is None) == (mean is None) and (mean is None or run[k][1] == pytest.approx(mean))
    if key_rows > 400:
        for d in (L.disposals(t), L.lot_matches(t), L.running_positions(t)):
            assert d._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1


def test_split_statements_are_worked_out_once(spark, tmp_path):
    from stratalens.sources.writers import write_statements

    seen = spark.sparkContext.accumulator(0)

    def counted(x):
        seen.add(1)
        return x

    wide = spark.range(5).select(F.col("id").cast("string").alias("code"), F.udf(counted, "long")("id").alias("netIncome"), F.lit(1.0).alias("totalAssets"))
    paths = write_statements(wide, str(tmp_path / "split"))
    assert sorted(r.netIncome for r in spark.read.parquet(paths["income"]).collect()) == [0, 1, 2, 3, 4] and seen.value == 5


def test_training_statistics_come_in_pieces(spark):
    """Aggregates of many columns are worked out some at a time; the training rows are stored wide once."""
    d = spark.range(50).select(*[F.when(F.col("id") % 7 < k % 7, F.col("id") * 1.0 + k).alias(f"c{k}") for k in range(40)])
    names = d.columns
    whole = d.agg(*[F.avg(f).alias(f) for f in names]).first().asDict()
    assert features.first_of_pieces(d, {f: F.avg(f) for f in names}) == whole
    shares = d.agg(*[F.avg(F.col(f).isNull().cast("double")).alias(f) for f in names]).first()
    assert features.complete_features(d, names, 0.4) == [f for f in names if shares[f] <= 0.4] and features.complete_features(d.limit(0), names) == []
    wide = []
    kept, model.materialize = model.materialize, lambda df: wide.append(len(df.columns)) or kept(df)
    try:
        rows = SelectionModel("ridge").training_rows(model_panel(spark), "3mo_return")
    finally:
        model.materialize = kept
    assert wide == [3, len(rows.columns)] and rows.count() == 800


def test_forest_jobs_do_not_grow_with_depth(spark):
    """Trees are grown inside tasks: more levels bring no further passes, jobs or exchanges."""
    d = model_panel(spark)
    jobs = []
    for depth in (2, 7):
        spark.sparkContext.setJobGroup(f"forest-{depth}", "")
        m = SelectionModel("forest", params={"trees": 10, "depth": depth, "min_leaf": 2})
        rows = m.training_rows(d, "3mo_return")
        before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"forest-{depth}"))
        m._fit_forest(rows)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"forest-{depth}")) - before)
        splits = [(feature >= 0).sum() for feature in m.fitted[0].feature]
        assert max(splits) <= 2**depth - 1 and max(splits) > 2 ** (depth - 1) - 1
    spark.sparkContext.setJobGroup("", "")
    assert jobs[0] == jobs[1]


def test_forest_tree_against_brute_force(spark, monkeypatch):
    from stratalens.operators import forest as O

    rng = np.random.default_rng(3)
    x = rng.integers(0, 50, (900, 5)).astype(float)
    y = np.round(x[:, 1] * 0.3 + (x[:, 3] > 20) * 7 + rng.normal(size=900), 3)
    rows = spark.createDataFrame([(float(b), *map(float, a)) for a, b in zip(x, y)], "y double, a double, b double, c double, d double, e double").repartition(3)
    at = O.cuts(rows, list("abcde"))
    assert all(20 < len(c) <= O.BINS - 1 and set(c) <= set(range(50)) for c in at)
    assert all(((x[:, j] <= v).mean() - (k + 1) / O.BINS) > -0.01 for j in range(5) for k, v in enumerate(at[j]) if len(at[j]) == O.BINS - 1)
    few = spark.range(300).select(F.when(F.col("id") < 298, 0.0).otherwise(F.col("id").cast("double")).alias("v"), F.lit(1.0).alias("one"))
    assert [list(c) for c in O.cuts(few, ["v", "one"])] == [[0.0, 298.0], []]
    data = O.coded(rows, list("abcde"), "y", at)
    grow = O.Growth(features=5, depth=3, tried=5, min_leaf=20, share=0.7, seed=7)
    trees = O.grown(data, grow, 4)
    # The same trees whatever the order of the rows, the size of chunks and the trees of a task.
    monkeypatch.setattr(O, "TASK_TREES", 1)
    monkeypatch.setattr(O, "CHUNK_ROWS", 128)
    again = O.grown(data.orderBy(F.col("first").desc()), grow, 4)
    for one, two in zip(trees, again):
        assert (one.feature == two.feature).all() and (one.code == two.code).all() and np.allclose(one.value, two.value) and np.allclose(one.gain, two.gain)
    blocks = data.collect()
    ids = np.concatenate([np.arange(b.first, b.first + len(b.labels) // 8) for b in blocks])
    labels = np.concatenate([np.frombuffer(bytes(b.labels)) for b in blocks])
    codes = np.concatenate([np.frombuffer(bytes(b.codes), np.uint8).reshape(-1, 5) for b in blocks])
    assert sorted(labels) == sorted(y) and len(set(ids)) == 900
    mixed = (ids ^ (ids >> 40) * 0x9E3779B1).astype(np.uint32)
    seen = set()
    for number, tree in enumerate(trees):
        hashed = O._hashed(mixed, 7, number).astype(int)
        times = sum((hashed >= int(limit)).astype(int) for limit in O._draws(0.7))
        assert 0.55 < times.mean() < 0.85 and times.max() >= 2
        seen.add(times.tobytes())
        todo = [(0, 0, np.ones(900, bool))]
        while todo:
            node, depth, here = todo.pop()
            w = times * here
            assert tree.value[node] == pytest.approx((w * labels).sum() / w.sum())
            if depth == 3:
                assert tree.feature[node] == -1
                continue
            def error(m):
                k = times * m
                return (k * labels**2).sum() - (k * labels).sum() ** 2 / k.sum()
            found = [(error(here) - error(here & (codes[:, f] <= c)) - error(here & (codes[:, f] > c)), f, c) for f in range(5) for c in range(O.BINS - 1)
                     if (w * (codes[:, f] <= c)).sum() >= 20 and (w * (codes[:, f] > c)).sum() >= 20]
            best = max(found, default=(0, -1, 0))
            if tree.feature[node] == -1:
                assert not found or best[0] < 1e-9
                continue
            f, c = tree.feature[node], tree.code[node]
            assert tree.gain[node] == pytest.approx(best[0]) and dict(((g, k), e) for e, g, k in found)[f, c] == pytest.approx(best[0])
            todo += [(tree.left[node], depth + 1, here & (codes[:, f] <= c)), (tree.left[node] + 1, depth + 1, here & (codes[:, f] > c))]
    assert len(seen) == 4
    fitted = O.Forest.of(trees, at, "s")
    from pyspark.ml.feature import VectorAssembler
    got = VectorAssembler(inputCols=list("abcde"), outputCol="vector").transform(rows)
    for r in fitted.transform(got).limit(50).collect():
        want = []
        for tree in trees:
            node = 0
            while tree.feature[node] >= 0:
                node = tree.left[node] + int(r.vector[int(tree.feature[node])] > at[tree.feature[node]][tree.code[node]])
            want.append(tree.value[node])
        assert r.s == pytest.approx(np.mean(want))
