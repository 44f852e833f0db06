"""Library-shaped views over the driver's order tables, as DataFrames and as SQL text for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans.panel import Tables, merge_statements

TIES = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity"]

# Each entry is one common table expression for DuckDB; ``with_sql`` puts the needed ones together.
SQL = {
    "prices": """SELECT 'S' || l_suppkey AS ticker, CAST(l_suppkey AS VARCHAR) AS id, CAST(l_shipdate AS DATE) AS date,
  l_extendedprice / l_quantity AS adj_close, l_discount * 10 AS dividend,
  CASE WHEN l_returnflag <> 'N' THEN l_quantity * 1e6 END AS shares,
  l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, l_linestatus, l_tax FROM lineitem""",
    "prices_sparse": """SELECT 'P' || l_partkey AS ticker, CAST(l_partkey AS VARCHAR) AS id,
  CAST(l_shipdate AS DATE) AS date, l_extendedprice / l_quantity AS adj_close, l_discount * 10 AS dividend,
  CASE WHEN l_returnflag <> 'N' THEN l_quantity * 1e6 END AS shares,
  l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity FROM lineitem""",
    "income": """SELECT 'S' || l_suppkey AS ticker, year(q_end)::INT AS fiscal_year, 'Q' || quarter(q_end) AS fiscal_period,
  q_end + CAST(l_suppkey % 60 AS INT) AS publish_date, revenue, 0.6 * revenue AS cost_of_revenue,
  0.4 * revenue AS gross_profit, 0.25 * revenue AS operating_income, -0.02 * revenue - 900 * tax AS interest_expense,
  0.22 * revenue AS pretax_income, -0.05 * revenue AS income_tax, 0.17 * revenue - 90000 * tax AS net_income,
  0.16 * revenue AS net_income_common, 0.05 * revenue AS depreciation, 0.03 * revenue AS research
  FROM (SELECT l_suppkey, last_day(date_trunc('quarter', CAST(l_shipdate AS DATE))::DATE + INTERVAL 2 MONTH) AS q_end,
  sum(l_extendedprice * (1 - l_discount)) AS revenue, sum(l_tax) AS tax
  FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2)""",
    "balance": """SELECT 'S' || l_suppkey AS ticker, year(q_end)::INT AS fiscal_year, 'Q' || quarter(q_end) AS fiscal_period,
  q_end + CAST(l_suppkey % 60 AS INT) AS publish_date, ep AS total_assets, 0.5 * ep - 500 * q AS total_equity,
  0.4 * ep AS current_assets, 300 * q AS current_liabilities, 0.1 * ep AS inventories, 100 * q AS cash_items,
  0.08 * ep AS receivables, 90 * q AS payables, 0.3 * ep AS ppe, CASE WHEN n % 2 = 0 THEN 50 * q END AS short_term_debt,
  0.2 * ep AS long_term_debt, 0.5 * ep + 500 * q AS total_liabilities
  FROM (SELECT l_suppkey, last_day(date_trunc('quarter', CAST(l_shipdate AS DATE))::DATE + INTERVAL 2 MONTH) AS q_end,
  sum(l_extendedprice) AS ep, sum(l_quantity) AS q, count(*) AS n
  FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1, 2)""",
    "cashflow": """SELECT 'S' || l_suppkey AS ticker, year(q_end)::INT AS fiscal_year, 'Q' || quarter(q_end) AS fiscal_period,
  q_end + CAST(l_suppkey % 60 AS INT) AS publish_date, 0.2 * rev AS operating_cash,
  40 * q - 0.05 * ep AS fixed_asset_change, -0.02 * ep AS dividends_paid, 0.01 * ep - 5 * q AS equity_cash
  FROM (SELECT l_suppkey, last_day(date_trunc('quarter', CAST(l_shipdate AS DATE))::DATE + INTERVAL 2 MONTH) AS q_end,
  sum(l_extendedprice) AS ep, sum(l_quantity) AS q, sum(l_extendedprice * (1 - l_discount)) AS rev
  FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2)""",
    "companies": """SELECT 'S' || s_suppkey AS ticker, r_name AS sector, n_name AS industry
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "macro_long": """SELECT last_day(CAST(o_orderdate AS DATE)) AS date, o_orderstatus AS indicator,
  avg(o_totalprice) AS value FROM orders GROUP BY 1, 2""",
    "benchmark_daily": """SELECT CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS level FROM orders GROUP BY 1""",
}


def with_sql(names: list[str], select: str, extra: dict[str, str] | None = None) -> str:
    """A SELECT behind the named common table expressions, in the given order; those that others read often are kept."""
    pool = {**SQL, **(extra or {})}
    kept = {"month_rows", "m0", "m1"}
    return "WITH " + ",\n".join(f"{n} AS {'MATERIALIZED ' if n in kept else ''}({pool[n]})" for n in names) + "\n" + select


_SCHEMAS: dict = {}


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """The driver's table; its schema is read from the file once."""
    path = f"{sf}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def prices(spark: SparkSession, sf: str, sparse: bool = False) -> DataFrame:
    key, mark = ("l_partkey", "P") if sparse else ("l_suppkey", "S")
    c = F.col
    return read(spark, sf, "lineitem").select(
        F.concat(F.lit(mark), c(key)).alias("ticker"), c(key).cast("string").alias("id"),
        c("l_shipdate").cast("date").alias("date"), (c("l_extendedprice") / c("l_quantity")).alias("adj_close"),
        (c("l_discount") * 10).alias("dividend"),
        F.when(c("l_returnflag") != "N", c("l_quantity") * 1e6).alias("shares"), *TIES)


def vendor_b_prices(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    return read(spark, sf, "lineitem").where(c("l_linestatus") == "F").select(
        F.concat(F.lit("S"), c("l_suppkey")).alias("ticker"), c("l_shipdate").cast("date").alias("date"),
        (c("l_extendedprice") / c("l_quantity") * (1 + c("l_tax"))).alias("adj_close"))


def _per_quarter(spark: SparkSession, sf: str, flag: str, **sums) -> DataFrame:
    day = F.col("l_shipdate").cast("date")
    q_end = F.last_day(F.add_months(F.trunc(day, "quarter"), 2))
    return (read(spark, sf, "lineitem").where(F.col("l_returnflag") == flag)
            .groupBy("l_suppkey", q_end.alias("q_end")).agg(*[v.alias(k) for k, v in sums.items()])
            .select("*", F.concat(F.lit("S"), "l_suppkey").alias("ticker"), F.year("q_end").alias("fiscal_year"),
                    F.concat(F.lit("Q"), F.quarter("q_end")).alias("fiscal_period"),
                    F.date_add("q_end", (F.col("l_suppkey") % 60).cast("int")).alias("publish_date")))


_KEYS = ["ticker", "fiscal_year", "fiscal_period", "publish_date"]


def _NET():
    return F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))


def income(spark: SparkSession, sf: str) -> DataFrame:
    q = _per_quarter(spark, sf, "A", rev=_NET(), tax=F.sum("l_tax"))
    r, t = F.col("rev"), F.col("tax")
    return q.select(*_KEYS, r.alias("revenue"), (0.6 * r).alias("cost_of_revenue"), (0.4 * r).alias("gross_profit"),
                    (0.25 * r).alias("operating_income"), (-0.02 * r - 900 * t).alias("interest_expense"),
                    (0.22 * r).alias("pretax_income"), (-0.05 * r).alias("income_tax"),
                    (0.17 * r - 90000 * t).alias("net_income"), (0.16 * r).alias("net_income_common"),
                    (0.05 * r).alias("depreciation"), (0.03 * r).alias("research"))


def balance(spark: SparkSession, sf: str) -> DataFrame:
    d = _per_quarter(spark, sf, "N", ep=F.sum("l_extendedprice"), q=F.sum("l_quantity"), n=F.count("*"))
    e, q = F.col("ep"), F.col("q")
    return d.select(*_KEYS, e.alias("total_assets"), (0.5 * e - 500 * q).alias("total_equity"),
                    (0.4 * e).alias("current_assets"), (300 * q).alias("current_liabilities"),
                    (0.1 * e).alias("inventories"), (100 * q).alias("cash_items"), (0.08 * e).alias("receivables"),
                    (90 * q).alias("payables"), (0.3 * e).alias("ppe"),
                    F.when(F.col("n") % 2 == 0, 50 * q).alias("short_term_debt"), (0.2 * e).alias("long_term_debt"),
                    (0.5 * e + 500 * q).alias("total_liabilities"))


def cashflow(spark: SparkSession, sf: str) -> DataFrame:
    d = _per_quarter(spark, sf, "R", ep=F.sum("l_extendedprice"), q=F.sum("l_quantity"), rev=_NET())
    e, q = F.col("ep"), F.col("q")
    return d.select(*_KEYS, (0.2 * F.col("rev")).alias("operating_cash"),
                    (40 * q - 0.05 * e).alias("fixed_asset_change"), (-0.02 * e).alias("dividends_paid"),
                    (0.01 * e - 5 * q).alias("equity_cash"))


def fundamentals(spark: SparkSession, sf: str) -> DataFrame:
    return merge_statements(income(spark, sf), balance(spark, sf), cashflow(spark, sf))


def companies(spark: SparkSession, sf: str) -> DataFrame:
    n = read(spark, sf, "nation").join(read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return read(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.concat(F.lit("S"), "s_suppkey").alias("ticker"), F.col("r_name").alias("sector"),
        F.col("n_name").alias("industry"))


def sectors(spark: SparkSession, sf: str) -> DataFrame:
    return companies(spark, sf).select(F.col("ticker").alias("TICKER"), "sector")


def financials(spark: SparkSession, sf: str) -> DataFrame:
    return companies(spark, sf).where(F.col("sector") == "MIDDLE EAST").select(F.col("ticker").alias("TICKER"))


def macro_long(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "orders").groupBy(
        F.last_day(F.col("o_orderdate").cast("date")).alias("date"), F.col("o_orderstatus").alias("indicator")).agg(
        F.avg("o_totalprice").alias("value"))


def benchmark_daily(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "orders").groupBy(F.col("o_orderdate").cast("date").alias("date")).agg(
        F.avg("o_totalprice").alias("level"))


def tables(spark: SparkSession, sf: str, macro: bool = True) -> Tables:
    from .plans.panel import pivot_macro
    return Tables(prices(spark, sf), fundamentals(spark, sf), sectors(spark, sf), financials(spark, sf),
                  pivot_macro(macro_long(spark, sf), ["F", "O", "P"]) if macro else None)


NUDGE = 1.000000000001


def sig(c):
    """To single precision, so that sums taken in another order compare equal. The nudge moves values that lie
    exactly between two single-precision numbers off the tie on both engines."""
    c = F.col(c) if isinstance(c, str) else c
    return ((c * F.lit(NUDGE)).cast("float").cast("double") + F.lit(0.0))


def sig_sql(expr: str) -> str:
    return f"(CAST(CAST(({expr}) * CAST({NUDGE} AS DOUBLE) AS FLOAT) AS DOUBLE) + CAST(0 AS DOUBLE))"


# --- ledgers --------------------------------------------------------------------------------------------------

def _fee_sql(qty: str, price: str) -> str:
    return (f"CASE WHEN {qty} > 0 AND {price} > 0 THEN greatest(least(greatest({qty} * 0.0035, 0.35), {qty} * {price} * 0.01)"
            f" + {qty} * 0.003, 0) ELSE 0 END")


SQL["trades_raw"] = f"""SELECT 'A' || (l_orderkey % 5) AS account, 'S' || l_suppkey AS symbol, CAST(l_shipdate AS TIMESTAMP) AS ts,
  printf('%010d-%02d-%010d-%012d-%03d', l_orderkey, l_linenumber, l_partkey, CAST(round(l_extendedprice * 100) AS BIGINT), CAST(l_quantity AS BIGINT)) AS trade_id,
  CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side, l_quantity AS quantity, l_extendedprice / l_quantity AS price,
  {_fee_sql('l_quantity', '(l_extendedprice / l_quantity)')} AS fee FROM lineitem"""
SQL["trades"] = f"""SELECT * FROM trades_raw UNION ALL SELECT DISTINCT account, symbol, TIMESTAMP '1994-12-31', '0', 'BUY', 1000.0::DOUBLE, 1000.0::DOUBLE,
  {_fee_sql('1000.0::DOUBLE', '1000.0::DOUBLE')} FROM trades_raw"""
SQL["payments"] = """SELECT 'A' || (o_orderkey % 7) AS account, 'C' || o_custkey AS symbol, CAST(o_orderdate AS DATE) AS payment_date,
  1 + o_orderkey % 100 AS shares, o_totalprice / 1e6 AS per_share, CASE WHEN o_orderstatus = 'P' THEN o_totalprice / 1000 END AS gross,
  CASE WHEN o_orderstatus = 'P' THEN o_totalprice / 1000 * (CASE WHEN o_orderkey % 2 = 0 THEN 0.7 ELSE 0.85 END) END AS net FROM orders"""
SQL["holdings"] = """SELECT o_custkey AS account, 'P' || l_partkey AS symbol, sum(l_quantity) AS shares FROM orders JOIN lineitem
  ON o_orderkey = l_orderkey WHERE o_orderdate < TIMESTAMP '1998-07-01' GROUP BY 1, 2"""
SQL["targets"] = """SELECT o_custkey AS account, 'P' || l_partkey AS symbol, max(l_discount) * 10 AS predicted_rank, p_type AS sector
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey
  WHERE o_orderdate >= TIMESTAMP '1997-07-01' GROUP BY 1, 2, 4"""
SQL["part_prices"] = "SELECT 'P' || p_partkey AS symbol, p_retailprice AS price, p_type AS sector FROM part WHERE p_partkey % 50 <> 7"
SQL["accounts"] = "SELECT c_custkey AS account, 30000.0::DOUBLE + c_custkey * 10 AS account_value FROM customer"
SQL["fills"] = """SELECT o_custkey AS account, CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'P' THEN 'rejected' ELSE 'submitted' END AS status,
  CASE WHEN o_orderkey % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS action, (1 + o_orderkey % 50)::DOUBLE AS quantity,
  o_totalprice / 1000 AS fill_price, 1.0::DOUBLE AS fee FROM orders"""


def trades(spark: SparkSession, sf: str, opening: bool = True) -> DataFrame:
    from .functions.columns import commission
    c = F.col
    raw = read(spark, sf, "lineitem").select(
        F.concat(F.lit("A"), c("l_orderkey") % 5).alias("account"), F.concat(F.lit("S"), "l_suppkey").alias("symbol"), c("l_shipdate").alias("ts"),
        F.format_string("%010d-%02d-%010d-%012d-%03d", "l_orderkey", "l_linenumber", "l_partkey",
                        F.round(c("l_extendedprice") * 100).cast("long"), c("l_quantity").cast("long")).alias("trade_id"),
        F.when(c("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"), c("l_quantity").alias("quantity"),
        (c("l_extendedprice") / c("l_quantity")).alias("price"))
    if opening:
        first = raw.select("account", "symbol").distinct().select(
            "account", "symbol", F.lit("1994-12-31").cast("timestamp_ntz").alias("ts"), F.lit("0").alias("trade_id"), F.lit("BUY").alias("side"),
            F.lit(1000.0).alias("quantity"), F.lit(1000.0).alias("price"))
        raw = raw.unionByName(first)
    return raw.withColumn("fee", commission(c("quantity"), c("price")))


def payments(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    broker = c("o_orderstatus") == "P"
    gross = F.when(broker, c("o_totalprice") / 1000)
    return read(spark, sf, "orders").select(
        F.concat(F.lit("A"), c("o_orderkey") % 7).alias("account"), F.concat(F.lit("C"), "o_custkey").alias("symbol"),
        c("o_orderdate").cast("date").alias("payment_date"), (1 + c("o_orderkey") % 100).alias("shares"), (c("o_totalprice") / 1e6).alias("per_share"),
        gross.alias("gross"), (gross * F.when(c("o_orderkey") % 2 == 0, 0.7).otherwise(0.85)).alias("net"))


def _order_lines(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "orders").join(read(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).withColumn(
        "symbol", F.concat(F.lit("P"), "l_partkey")).withColumnRenamed("o_custkey", "account")


def holdings(spark: SparkSession, sf: str) -> DataFrame:
    return _order_lines(spark, sf).where(F.col("o_orderdate") < F.lit("1998-07-01").cast("timestamp_ntz")).groupBy("account", "symbol").agg(
        F.sum("l_quantity").alias("shares"))


def targets(spark: SparkSession, sf: str) -> DataFrame:
    lines = _order_lines(spark, sf).where(F.col("o_orderdate") >= F.lit("1997-07-01").cast("timestamp_ntz"))
    parts = read(spark, sf, "part").select("p_partkey", F.col("p_type").alias("sector"))
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy("account", "symbol", "sector").agg(
        (F.max("l_discount") * 10).alias("predicted_rank"))


def part_prices(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "part").where(F.col("p_partkey") % 50 != 7).select(
        F.concat(F.lit("P"), "p_partkey").alias("symbol"), F.col("p_retailprice").alias("price"), F.col("p_type").alias("sector"))


def accounts(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "customer").select(F.col("c_custkey").alias("account"), (30000.0 + F.col("c_custkey") * 10).alias("account_value"))


def fills(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    return read(spark, sf, "orders").select(
        c("o_custkey").alias("account"),
        F.when(c("o_orderstatus") == "F", "filled").when(c("o_orderstatus") == "P", "rejected").otherwise("submitted").alias("status"),
        F.when(c("o_orderkey") % 2 == 0, "BUY").otherwise("SELL").alias("action"), (1 + c("o_orderkey") % 50).cast("double").alias("quantity"),
        (c("o_totalprice") / 1000).alias("fill_price"), F.lit(1.0).alias("fee"))
