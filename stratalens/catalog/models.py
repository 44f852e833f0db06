"""Fitted-model, walk-forward and streaming queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import constants as C
from .. import fixtures as X
from ..fixtures import with_sql
from ..functions.ratios import ratio_texts
from ..plans import features as T
from ..plans import panel as P
from ..plans import walkforward as K
from ..plans.model import SelectionModel
from ..session import materialize, shared_folder
from ..streaming import ingest as G
from .ledger import POSITION, REPLAY_BASE, money, money_sql, recursive
from .panel import CLEAN_NAMES, PIT_NAMES, all_ctes, bars, rounded, rounded_sql, stored_clean

BASE = ["TICKER", "public_date", "sector", "1mo_return", "3mo_return", "1yr_return"]


def data(spark, sf):
    """The panel with every feature it has."""
    d = stored_clean(spark, sf)
    return d.select(*BASE, *[f for f in C.ALL_FEATURES if f in d.columns and f not in BASE])


def ridge():
    return SelectionModel("ridge")


def forest():
    return SelectionModel("forest")


_RUNS: dict = {}


def run(spark, sf):
    key = (spark.sparkContext.applicationId, sf)
    if key not in _RUNS:
        _RUNS[key] = K.run(data(spark, sf), X.benchmark_daily(spark, sf), "1990-01-01", "2010-12-31", freq="A", month=6, make_model=ridge)
    return _RUNS[key]


def fresh(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def periods(spark, sf):
    return run(spark, sf).periods


def selections(spark, sf):
    return run(spark, sf).selections


def metrics(spark, sf):
    return run(spark, sf).metrics


def importances(spark, sf):
    return ridge().fit(data(spark, sf), "3mo_return").top_importances(spark)


def latest(spark, sf):
    return K.score_latest(data(spark, sf), 10, ridge)


def forest_latest(spark, sf):
    return K.score_latest(data(spark, sf), 10, forest)


def stored_model(spark, sf):
    d = data(spark, sf)
    model = ridge().fit(d, "3mo_return")
    path = fresh(spark, "model")
    model.save(path)
    back = SelectionModel.load(spark, path)
    a = model.predict(d).select("TICKER", "public_date", F.col("model_score").alias("a"))
    b = back.predict(d).select("TICKER", "public_date", F.col("model_score").alias("b"))
    return a.join(b, ["TICKER", "public_date"]).groupBy("public_date").agg(F.count("*").alias("n_rows"), F.count_if(F.abs(F.col("a") - F.col("b")) < 1e-12).alias("n_equal"))


def optimality(spark, sf):
    """Per kept feature whether the ridge's gradient over all training rows is zero."""
    d = data(spark, sf)
    model = ridge()
    rows = materialize(model.training_rows(d, "3mo_return"))
    model._fit_ridge(rows)
    weights = dict(zip(model.features, model.fitted.coefficients.toArray(), strict=True))
    z = {f: (F.col(f) - model.means[f]) / model.scales[f] for f in model.features}
    gap = F.col("target_rank") - model.fitted.intercept - sum((z[f] * float(w) for f, w in weights.items()), F.lit(0.0))
    # The gradient of squared errors and penalty, against the size of its terms.
    sums = rows.select(gap.alias("gap"), *[z[f].alias(f) for f in model.features]).agg(*[F.sum(F.col("gap") * F.col(f)).alias(f) for f in model.features]).first()
    found = [(f, bool(abs(sums[f] - C.RIDGE_ALPHA * weights[f]) < 1e-6 * model.n_rows)) for f in model.features]
    return spark.createDataFrame(found, "feature string, is_optimal boolean")


def linear_scores(spark, sf):
    """Rows whose score is the intercept plus the weighted, scaled features, computed apart."""
    d = data(spark, sf)
    model = ridge().fit(d, "3mo_return")
    weights = dict(zip(model.features, model.fitted.coefficients.toArray(), strict=True))
    scored = model.predict(d).select("TICKER", "public_date", "model_score")
    z = T.neutralize(model.fill(d), model.features)
    own = sum(((F.col(f) - model.means[f]) / model.scales[f] * float(w) for f, w in weights.items()), F.lit(float(model.fitted.intercept)))
    both = scored.join(z.select("TICKER", "public_date", own.alias("own")), ["TICKER", "public_date"])
    return both.groupBy("public_date").agg(F.count("*").alias("n_rows"), F.count_if(F.abs(F.col("own") - F.col("model_score")) < 1e-9).alias("n_equal"))


_PANEL_FEATURES = [f for f in C.ALL_FEATURES if f in {*ratio_texts(), "MthCap", "divyield"}]
# A feature is kept if at most half of the rows with a target lack it.
KEPT_SQL = " UNION ALL ".join(
    f"""SELECT '{f}' AS feature, true AS is_optimal FROM clean WHERE "3mo_return" IS NOT NULL HAVING 1 - count("{f}") / count(*) <= {C.MISSING_THRESHOLD}""" for f in _PANEL_FEATURES)


# --- streams --------------------------------------------------------------------------------------------------

def daily_unique(spark, sf):
    return X.prices(spark, sf).groupBy("ticker", "date").agg(F.max("id").alias("id"), F.avg("adj_close").alias("adj_close"), F.sum("dividend").alias("dividend"), F.max("shares").alias("shares")).select(
        *G.DAILY.fieldNames())


PARTS = [("1900-01-01", "1997-06-30"), ("1997-07-01", "1999-06-30"), ("1999-07-01", "2100-01-01")]


def deliver(df, folder, column, start, overlap_days=0, change=lambda part, d: d):
    """Three deliveries in time order; after each the stream is started again, takes what is new, and stops."""
    for i, (low, high) in enumerate(PARTS):
        since = F.date_sub(F.lit(low).cast("date"), overlap_days if i else 0)
        part = df.where(F.col(column).cast("date").between(since, F.lit(high).cast("date")))
        change(i, part).write.mode("append").parquet(folder)
        start().awaitTermination()


def stream_prices(spark, sf):
    """Deliveries overlap by 200 days, and the first rows come twice in a delivery too; every fifth ticker's whole history comes last."""
    landing, table, cp = (fresh(spark, n) for n in ("landing", "prices", "cp"))
    d = daily_unique(spark, sf)
    known = X.companies(spark, sf).where(F.col("sector") != "ASIA").select("ticker")
    d = d.unionByName(d.where(F.month("date") == 1)).withColumn("arrival", F.when(F.pmod(F.crc32("ticker"), F.lit(5)) == 0, F.lit("2099-01-01").cast("date")).otherwise(F.col("date")))
    deliver(d, landing, "arrival", lambda: G.append_prices(G.price_stream(spark, landing), table, cp, known), 200, lambda i, part: part.drop("arrival"))
    return rounded(spark.read.parquet(table), ["ticker", "date", "id"], ["adj_close", "dividend", "shares"])


def stream_bars(spark, sf):
    """The last 40 days of a delivery have prices that the next delivery, which has these days again, corrects."""
    landing, daily, table, cp = (fresh(spark, n) for n in ("landing", "daily", "bars", "cp"))

    def wrong(i, part):
        last = i == len(PARTS) - 1
        return part if last else part.withColumn("adj_close", F.when(F.col("date") > F.date_sub(F.lit(PARTS[i][1]).cast("date"), 38), F.col("adj_close") * 1.5).otherwise(F.col("adj_close")))

    deliver(daily_unique(spark, sf), landing, "date", lambda: G.maintain_month_bars(G.price_stream(spark, landing), daily, table, cp), 40, wrong)
    return rounded(spark.read.parquet(table), ["TICKER", "public_date", "gvkey", "last_date"], ["MthPrc", "shares", "Div_m"])


def stream_panel(spark, sf):
    landing, seen, table, cp = (fresh(spark, n) for n in ("landing", "statements", "panel", "cp"))
    fund = materialize(P.quarterly_fundamentals(X.fundamentals(spark, sf)).select(
        "ticker", "fiscal_year", "fiscal_period", "publish_date", "revenue", "total_equity", "net_income_ttm"))
    b = materialize(bars(spark, sf).select("TICKER", "public_date", "MthPrc"))
    deliver(fund, landing, "publish_date", lambda: G.maintain_point_in_time(spark.readStream.schema(fund.schema).parquet(landing), seen, b, table, cp))
    return rounded(spark.read.parquet(table), ["TICKER", "public_date", "fiscal_year", "fiscal_period"], ["MthPrc", "revenue", "total_equity", "net_income_ttm"])


def stream_positions(spark, sf):
    """Trades arrive up to 40 days late, so deliveries overlap in time; a row far ahead moves the watermark past the last trade."""
    landing, table, cp = (fresh(spark, n) for n in ("landing", "positions", "cp"))
    t = X.trades(spark, sf, False).withColumn("ts", F.col("ts").cast("timestamp"))
    ahead = t.limit(1).withColumns({"account": F.lit("clock"), "ts": F.lit("2099-12-31").cast("timestamp")})
    t = t.withColumn("arrival", F.date_add("ts", F.pmod(F.crc32("trade_id"), F.lit(41)).cast("int"))).unionByName(ahead.withColumn("arrival", F.lit("2099-12-31").cast("date")))
    plain = t.drop("arrival").schema
    deliver(t, landing, "arrival", lambda: G.running_positions(spark.readStream.schema(plain).parquet(landing), "60 days").writeStream.format("parquet").option("path", table).option(
        "checkpointLocation", cp).trigger(availableNow=True).start(), 0, lambda i, part: part.drop("arrival"))
    return money(spark.read.parquet(table), ["account", "symbol", "trade_id"], ["shares", "avg_cost", "total_cost"], 4)


DAILY_SQL = {"daily": "SELECT ticker, date, max(id) AS id, avg(adj_close) AS adj_close, sum(dividend) AS dividend, max(shares) AS shares FROM prices GROUP BY 1, 2"}
PIT_SELECT = "SELECT " + rounded_sql(["TICKER", "public_date", "fiscal_year", "fiscal_period"], ["MthPrc", "revenue", "total_equity", "net_income_ttm"]) + " FROM pit"


def positions_sql():
    return recursive(["trades_raw", "seq", "position"], "SELECT " + money_sql(["account", "symbol", "trade_id"], ["shares", "avg_cost", "total_cost"], 4)
                     + " FROM (SELECT *, CASE WHEN shares > 0 THEN total_cost / shares END AS avg_cost FROM position)", {**REPLAY_BASE, "position": POSITION})


QUERIES = {
    "b1_b2_walk_forward_periods": (periods, None),
    "b2_walk_forward_selections": (selections, None),
    "b3_walk_forward_metrics": (metrics, None),
    "m1_m2_m6_o4_ridge_importances": (importances, None),
    "m4_m5_p20_latest_selection": (latest, None),
    "m3_forest_selection": (forest_latest, None),
    "s19_stored_model": (stored_model, with_sql(CLEAN_NAMES, "SELECT public_date, count(*) AS n_rows, count(*) AS n_equal FROM clean GROUP BY 1", all_ctes())),
    "m2_ridge_optimality": (optimality, with_sql(CLEAN_NAMES, KEPT_SQL, all_ctes())),
    "m4_linear_scores": (linear_scores, with_sql(CLEAN_NAMES, "SELECT public_date, count(*) AS n_rows, count(*) AS n_equal FROM clean GROUP BY 1", all_ctes())),
    "t1_s18_u3_stream_prices": (stream_prices, with_sql(["prices", "companies", "daily"], f"""SELECT d.ticker, date, id, {rounded_sql([], ['adj_close', 'dividend', 'shares'])} FROM daily d
  JOIN companies c ON d.ticker = c.ticker WHERE c.sector <> 'ASIA'""", DAILY_SQL)),
    "t2_stream_month_bars": (stream_bars, with_sql(["prices", "daily"], f"""SELECT ticker AS TICKER, public_date, gvkey, last_date, {rounded_sql([], ['MthPrc', 'shares', 'Div_m'])} FROM (SELECT ticker,
  last_day(date) AS public_date, max(id) AS gvkey, max(date) AS last_date, arg_max(adj_close, date) AS "MthPrc", arg_max_null(shares, date) AS shares, sum(dividend) AS "Div_m" FROM daily GROUP BY 1, 2)""", DAILY_SQL)),
    "t3_stream_point_in_time": (stream_panel, with_sql(PIT_NAMES[:-1], PIT_SELECT, all_ctes())),
    "t4_stream_positions": (stream_positions, positions_sql()),
}
