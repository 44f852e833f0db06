"""Reader, writer and mapping queries. Files are written from the driver tables first, then read by the readers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import constants as C
from .. import fixtures as X
from .. import schemas as S
from ..fixtures import sig, sig_sql, with_sql
from ..functions import columns as K
from ..plans import panel as P
from ..session import shared_folder
from ..sources import mapping as M
from ..sources import readers as R
from ..sources import writers as W
from .ledger import DISPOSAL_NAMES, FIFO
from .panel import CLEAN_NAMES, FUND_NAMES, all_ctes, q, rounded, rounded_sql, stored_clean
from .selection import full_run, run_sql

A_HEADERS = {v: k for k, v in {**S.KEY_HEADERS, **S.INCOME_HEADERS, **S.BALANCE_HEADERS, **S.CASHFLOW_HEADERS}.items()}


def fresh(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def vendor_a_folder(spark, sf):
    """Vendor A's files from the fixture views: text, with some unreadable numbers and missing keys."""
    folder = fresh(spark, "vendor-a")
    p = X.prices(spark, sf)
    odd = F.col("l_linenumber")
    text = p.select(
        F.when(odd != 7, F.col("ticker")).alias("Ticker"), F.col("id").alias("CompanyId"), F.col("date").cast("string").alias("Date"),
        F.when(odd == 6, F.lit("n/a")).otherwise(F.col("adj_close").cast("string")).alias("Adj. Close"),
        F.when(odd == 5, F.lit(None)).otherwise(F.col("dividend").cast("string")).alias("Dividend"), F.col("shares").cast("string").alias("Shares Outstanding"),
        F.lit("x").alias("Volume"))
    text.write.csv(f"{folder}/us-shareprices-daily.csv", sep=";", header=True)
    for name, df in (("income", X.income(spark, sf)), ("balance", X.balance(spark, sf)), ("cashflow", X.cashflow(spark, sf))):
        df.select(*[F.col(c).cast("string").alias(A_HEADERS[c]) for c in df.columns]).write.csv(f"{folder}/us-{name}-quarterly.csv", sep=";", header=True)
    c = X.companies(spark, sf)
    code = F.when(F.col("sector") == "MIDDLE EAST", F.lit("103")).otherwise(F.lit("100"))
    c.select(F.col("ticker").alias("Ticker"), F.concat(code, F.substring("industry", 8, 9)).alias("IndustryId")).write.csv(f"{folder}/us-companies.csv", sep=";", header=True)
    c.select(F.concat(code, F.substring("industry", 8, 9)).alias("IndustryId"), F.col("sector").alias("Sector"), F.col("industry").alias("Industry")).distinct().write.csv(
        f"{folder}/industries.csv", sep=";", header=True)
    return folder


_FOLDERS: dict = {}


def vendor_a(spark, sf):
    key = (spark.sparkContext.applicationId, sf, "a")
    if key not in _FOLDERS:
        _FOLDERS[key] = vendor_a_folder(spark, sf)
    return R.VendorA(spark, _FOLDERS[key])


B_NAMES = {"revenue": "totalRevenue", "cost_of_revenue": "costOfRevenue", "gross_profit": "grossProfit", "operating_income": "operatingIncome", "interest_expense": "interestExpense",
           "pretax_income": "incomeBeforeTax", "income_tax": "incomeTaxExpense", "net_income": "netIncome", "net_income_common": "netIncomeApplicableToCommonShares",
           "depreciation": "depreciationAndAmortization", "research": "researchDevelopment", "total_assets": "totalAssets", "total_equity": "totalStockholderEquity",
           "current_assets": "totalCurrentAssets", "current_liabilities": "totalCurrentLiabilities", "inventories": "inventory", "receivables": "netReceivables",
           "payables": "accountsPayable", "ppe": "propertyPlantEquipment", "short_term_debt": "shortTermDebt", "long_term_debt": "longTermDebt",
           "total_liabilities": "totalLiabilities", "operating_cash": "totalCashFromOperatingActivities", "fixed_asset_change": "capitalExpenditures", "dividends_paid": "dividendsPaid"}


def wide_b(spark, sf):
    """Vendor B's wide statements: some dates keep cash under the first name, others under the second."""
    d = X.fundamentals(spark, sf)
    even = F.col("fiscal_year") % 2 == 0
    return d.select(F.col("ticker").alias("code"), F.col("publish_date").alias("filing_date"), F.col("fiscal_year").alias("fiscalYear"), F.col("fiscal_period").alias("fiscalQuarter"),
                    *[F.col(k).alias(v) for k, v in B_NAMES.items()], F.when(even, F.col("cash_items")).alias("cashAndShortTermInvestments"),
                    F.when(~even, F.col("cash_items")).alias("cash"), F.lit("USD").alias("currency"))


def vendor_b(spark, sf):
    key = (spark.sparkContext.applicationId, sf, "b")
    if key not in _FOLDERS:
        folder = _FOLDERS[key] = fresh(spark, "vendor-b")
        W.write_statements(wide_b(spark, sf), folder)
        X.prices(spark, sf).select(F.col("ticker").alias("code"), "date", F.col("adj_close").alias("adjusted_close"), F.lit(1.0).alias("close")).write.parquet(f"{folder}/prices.parquet")
        c = X.companies(spark, sf)
        c.select(F.col("ticker").alias("Code"), F.lit("Common Stock").alias("Type"), F.col("sector").alias("Sector"), F.col("industry").alias("Industry")).write.parquet(f"{folder}/companies.parquet")
        c.select(F.col("ticker").alias("code"), F.lit(None).cast("string").alias("gics_sector"), "sector",
                 F.when(F.col("industry") == "NATION_3", "Regional Bank").otherwise(F.col("industry")).alias("industry")).write.parquet(f"{folder}/companies_detail.parquet")
        X.macro_long(spark, sf).toDF("Date", "indicator", "Value").write.parquet(f"{folder}/macro.parquet")
    return R.VendorB(spark, _FOLDERS[key])


def a_prices(spark, sf):
    d = vendor_a(spark, sf).prices()
    return d.groupBy("ticker", "date").agg(*[F.sum(c).alias(c) for c in ("adj_close", "dividend", "shares")], F.count("*").alias("n"), F.max("id").alias("id")).select(
        "ticker", "date", "id", "n", *[sig(c).alias(c) for c in ("adj_close", "dividend", "shares")])


ITEMS = [*S.INCOME_ITEMS, *S.BALANCE_ITEMS, *S.CASHFLOW_ITEMS]
B_ITEMS = [*B_NAMES, "cash_items"]


def a_fundamentals(spark, sf):
    return rounded(vendor_a(spark, sf).fundamentals(), S.KEYS, ITEMS)


def a_sectors(spark, sf):
    v = vendor_a(spark, sf)
    return v.sectors().join(v.financials().withColumn("is_financial", F.lit(True)), "TICKER", "left").select(
        "TICKER", "sector", F.coalesce("is_financial", F.lit(False)).alias("is_financial"))


def missing_dimension(spark, sf):
    """A vendor folder without company files still joins: the panel's tickers get no sector."""
    v = R.VendorA(spark, fresh(spark, "absent"))
    tickers = X.prices(spark, sf).select(F.col("ticker").alias("TICKER")).distinct()
    return tickers.join(v.sectors(), "TICKER", "left")


def b_prices(spark, sf):
    d = vendor_b(spark, sf).prices()
    return d.groupBy("ticker", "id", "date").agg(F.sum("adj_close").alias("adj_close"), F.sum("dividend").alias("dividend"), F.count("shares").alias("n_shares")).select(
        "ticker", "id", "date", "n_shares", sig("adj_close").alias("adj_close"), sig("dividend").alias("dividend"))


def b_fundamentals(spark, sf):
    return rounded(vendor_b(spark, sf).fundamentals(), S.KEYS, B_ITEMS)


def b_dimensions(spark, sf):
    v = vendor_b(spark, sf)
    return v.sectors().join(v.financials().withColumn("is_financial", F.lit(True)), "TICKER", "left").select(
        "TICKER", "sector", F.coalesce("is_financial", F.lit(False)).alias("is_financial"))


def b_industries(spark, sf):
    return vendor_b(spark, sf).industries()


def b_macro(spark, sf):
    return rounded(vendor_b(spark, sf).macro(), ["public_date"], ["F", "O", "P"])


def macro_file(spark, sf):
    path = fresh(spark, "macro")
    X.benchmark_daily(spark, sf).select(F.col("date").alias("obs_date"), F.when(F.month("date") == 4, F.lit(".")).otherwise(F.col("level").cast("string")).alias("SERIES")).write.csv(path, header=True)
    return rounded(R.read_macro(spark, path), ["public_date"], ["SERIES"])


def macro_rates(spark, sf):
    """A file of daily prices and of one reading a quarter as month ends, with the changes over a month and a year."""
    path = fresh(spark, "macro-rates")
    text = lambda known, value: F.when(known, value.cast("string")).otherwise(F.lit("."))
    month, level = F.month("date"), F.col("level")
    X.benchmark_daily(spark, sf).select(F.col("date").alias("obs_date"), text(month != 4, level).alias("USACPIALLMINMEI"), text(month % 3 == 2, level * 2).alias("GDP")).write.csv(path, header=True)
    return rounded(P.macro_features(R.read_macro(spark, path)), ["public_date"], ["USACPIALLMINMEI", "GDP", *C.MACRO_CHANGES])


MACRO_RATES = {
    "readings": """SELECT last_day(date) AS public_date, arg_max(level, date) FILTER (month(date) <> 4) AS c, arg_max(level * 2, date) FILTER (month(date) % 3 = 2) AS g FROM benchmark_daily GROUP BY 1""",
    "calendar": """SELECT last_day(CAST(unnest(generate_series(low, high, INTERVAL 1 MONTH)) AS DATE)) AS public_date FROM
  (SELECT date_trunc('month', min(date)) AS low, date_trunc('month', max(date)) AS high FROM benchmark_daily)""",
    "filled": """SELECT k.public_date, year(k.public_date) * 12 + month(k.public_date) AS n, last_value(c IGNORE NULLS) OVER w AS c, last_value(g IGNORE NULLS) OVER w AS g
  FROM calendar k LEFT JOIN readings r ON k.public_date = r.public_date WINDOW w AS (ORDER BY k.public_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
}


def index_file(spark, sf):
    path = fresh(spark, "index")
    X.benchmark_daily(spark, sf).toDF("Date", "Adj Close").write.parquet(path)
    return rounded(R.read_index(spark, path).where(F.col("date").between("1996-01-01", "1999-12-31")), ["date"], ["level"])


PANEL = ["TICKER", "gvkey", "public_date", "sector", "fiscal_period"]
PANEL_X = ["MthPrc", "MthCap", "bm", "roe", "1yr_return"]


def panel_files(spark, sf):
    d = stored_clean(spark, sf).select(*PANEL, *PANEL_X)
    a, b = fresh(spark, "panel"), fresh(spark, "panel") + ".csv"
    W.write_panel(d, a)
    W.write_panel(d, b, "csv")
    both = R.read_panel(spark, a).withColumn("kind", F.lit("parquet")).unionByName(R.read_panel(spark, b).withColumn("kind", F.lit("csv")))
    return rounded(both, ["kind", *PANEL], PANEL_X)


def report_files(spark, sf):
    p, s = full_run(spark, sf)
    paths = W.write_tables({"periods": p, "selections": s.select("strategy", "public_date", "TICKER", "position")}, fresh(spark, "report"))
    d = spark.read.csv(paths["periods"], header=True)
    n = spark.read.csv(paths["selections"], header=True).groupBy("public_date").agg(F.count("*").alias("n_rows"))
    return d.join(n, "public_date").select(K.to_day(F.col("public_date")).alias("public_date"), "n_rows", sig(K.to_number(F.col("portfolio_return"))).alias("portfolio_return"))


def tax_files(spark, sf):
    from ..plans import ledger as L
    from ..plans import tax as T
    paths = W.write_tax_tables(L.disposals(X.trades(spark, sf)), T.dividends(X.payments(spark, sf)), fresh(spark, "tax"))
    out = None
    for name, path in paths.items():
        part = spark.read.parquet(path).groupBy(F.lit(name).alias("table"), "year").agg(F.count("*").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


NESTED_ITEMS = ["totalRevenue", "netIncome", "totalAssets", "inventory", "capitalExpenditures"]


def nested(spark, sf):
    """Statements folded into one JSON document per symbol, and unfolded again."""
    def quarters(df, fields, alias):
        items = F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v.cast("string"))])
        return df.groupBy("ticker").agg(F.map_from_entries(F.collect_list(F.struct(F.col("q").cast("string"), items))).alias(alias))

    def ends(df):
        return df.withColumn("q", F.last_day(F.make_date("fiscal_year", F.substring("fiscal_period", 2, 1).cast("int") * 3, F.lit(1))))

    c = F.col
    i = quarters(ends(X.income(spark, sf)), {"totalRevenue": c("revenue"), "netIncome": c("net_income"), "inventory": F.lit(-1), "filing_date": c("publish_date")}, "i")
    b = quarters(ends(X.balance(spark, sf)), {"totalAssets": c("total_assets"), "inventory": c("inventories"), "filing_date": c("publish_date")}, "b")
    f = quarters(ends(X.cashflow(spark, sf)), {"capitalExpenditures": c("fixed_asset_change"), "comment": F.lit("text")}, "c")
    d = i.join(b, "ticker", "full").join(f, "ticker", "full").join(X.companies(spark, sf).withColumnRenamed("sector", "s"), "ticker", "left")
    wrap = lambda x: F.struct(c(x).alias("quarterly"))
    doc = F.to_json(F.struct(F.create_map(F.lit("Sector"), c("s")).alias("General"),
                             F.struct(wrap("i").alias("Income_Statement"), wrap("b").alias("Balance_Sheet"), wrap("c").alias("Cash_Flow")).alias("Financials")))
    parsed = R.parse_nested(d.select(c("ticker").alias("code"), doc.alias("body")))
    return rounded(R.flatten_statements(parsed, NESTED_ITEMS), ["code", "date", "sector", "filing_date"], NESTED_ITEMS)


def nested_items(spark, sf):
    """Documents with typed items, a text among them and a dated text in each entry, read without a list of items."""
    def quarters(df, fields, alias):
        end = F.last_day(F.make_date("fiscal_year", F.substring("fiscal_period", 2, 1).cast("int") * 3, F.lit(1))).cast("string")
        entry = F.struct(*[v.alias(k) for k, v in fields.items()], F.col("publish_date").cast("string").alias("filing_date"))
        return df.groupBy("ticker").agg(F.map_from_entries(F.collect_list(F.struct(end, entry))).alias(alias))

    c = F.col
    i = quarters(X.income(spark, sf), {"totalRevenue": c("revenue"), "netIncome": c("net_income"), "audited": c("revenue") > c("net_income")}, "i")
    b = quarters(X.balance(spark, sf), {"totalAssets": c("total_assets"), "inventory": c("inventories").cast("string")}, "b")
    f = quarters(X.cashflow(spark, sf), {"capitalExpenditures": c("fixed_asset_change"), "currency": F.concat(F.lit("for "), c("ticker"))}, "c")
    wrap = lambda x: F.struct(c(x).alias("quarterly"))
    doc = F.to_json(F.struct(F.struct(wrap("i").alias("Income_Statement"), wrap("b").alias("Balance_Sheet"), wrap("c").alias("Cash_Flow")).alias("Financials")))
    d = i.join(b, "ticker", "full").join(f, "ticker", "full").select(c("ticker").alias("code"), doc.alias("body"))
    return R.statement_items(d).withColumn("number", sig("number"))


Q_END = "last_day(make_date(fiscal_year, CAST(fiscal_period[2:] AS INT) * 3, 1))"
ITEM_SQL = [("income", "totalRevenue", "number", "revenue"), ("income", "netIncome", "number", "net_income"), ("income", "audited", "boolean", "revenue > net_income"),
            ("balance", "totalAssets", "number", "total_assets"), ("balance", "inventory", "text number", "inventories"), ("cashflow", "capitalExpenditures", "number", "fixed_asset_change"),
            ("cashflow", "currency", "text", "'for ' || ticker"), *((s, "filing_date", "text", "CAST(publish_date AS VARCHAR)") for s in ("income", "balance", "cashflow"))]


def items_sql():
    """The items of ``nested_items``, one SELECT each; the text form of a number in text is left to the engines."""
    part = lambda s, item, kind, x: (f"SELECT ticker AS code, '{s}' AS statement, {Q_END} AS date, '{item}' AS item, '{kind.split()[0]}' AS kind, "  # noqa: E731
                                     f"{sig_sql(x) if 'number' in kind else 'NULL::DOUBLE'} AS number, {f'CAST({x} AS VARCHAR)' if kind in ('text', 'boolean') else 'NULL'} AS text FROM {s} WHERE ({x}) IS NOT NULL")
    return " UNION ALL ".join(part(*x) for x in ITEM_SQL)


def item_rows(spark, sf):
    return nested_items(spark, sf).withColumn("text", F.when(F.col("number").isNull(), F.col("text")))


def company_general(spark, sf):
    """The general section of the documents; a symbol without one has no row."""
    general = F.struct(F.concat(F.lit("Company "), "ticker").alias("Name"), F.col("sector").alias("Sector"), F.col("industry").alias("CountryName"), F.lit(False).alias("IsDelisted"))
    doc = F.to_json(F.struct(F.when(F.col("industry") != "CANADA", general).alias("General")))
    return R.company_info(R.parse_nested(X.companies(spark, sf).select(F.col("ticker").alias("code"), doc.alias("body"))))


GENERAL_SQL = {"name": "'Company S' || s_suppkey", "sector": "r_name", "country": "n_name", "is_delisted": "'false'"}


def general_sql():
    fields = ", ".join(f"{GENERAL_SQL.get(k, 'CAST(NULL AS VARCHAR)')} AS {k}" for k in R.COMPANY_FIELDS)
    return f"SELECT 'S' || s_suppkey AS code, {fields} FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE n_name <> 'CANADA'"


def statement_split(spark, sf):
    wide = wide_b(spark, sf)
    paths = W.write_statements(wide, fresh(spark, "split"))
    out = None
    for name in ("income", "balance", "cashflow"):
        d = spark.read.parquet(paths[name])
        numbers = [c for c in d.columns if c in {*B_NAMES.values(), "cash", "cashAndShortTermInvestments"}]
        from ..operators.winsor import long_form
        part = long_form(d, numbers).groupBy("feature").agg(F.count("value").alias("n")).select(F.lit(name).alias("statement"), F.col("feature").alias("column"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def mapped(spark, sf):
    d = X.read(spark, sf, "lineitem").select("l_orderkey", F.when(F.col("l_returnflag") == "A", F.col("l_tax")).alias("alpha"), F.col("l_discount").alias("beta"), F.col("l_quantity").alias("gamma"))
    m = M.map_columns(d, {"alpha": "rate", "beta": "rate", "gamma": "size"}, keep_unmapped=False)
    m = M.negate(m, ["size", "absent"])
    return m.groupBy(F.col("rate")).agg(F.sum("size").alias("size")).select(sig("rate").alias("rate"), sig("size").alias("size"))


def fiscal_periods(spark, sf):
    n = F.col("l_linenumber")
    text = F.when(n == 1, "1").when(n == 2, "q2 ").when(n == 3, "3Q").when(n == 4, " Q4").when(n == 5, "fy").when(n == 6, "5")
    return X.read(spark, sf, "lineitem").groupBy(K.fiscal_period(text).alias("period")).agg(F.count("*").alias("n"))


def stock_types(spark, sf):
    s = F.col("c_mktsegment")
    kind = F.when(s == "BUILDING", "COMMON STOCK").when(s == "FURNITURE", "Preferred Stock").when(s == "MACHINERY", "Equity").when(s == "HOUSEHOLD", "Equity Fund")
    return X.read(spark, sf, "customer").groupBy("c_mktsegment").agg(F.count_if(K.is_common_stock(kind)).alias("n_common"), F.count("*").alias("n"))


def domestic(spark, sf):
    sym = F.concat(F.lpad(F.col("c_custkey").cast("string"), 4, "0"), F.left("c_mktsegment", F.lit(1)))
    return X.read(spark, sf, "customer").select(sym.alias("symbol"), K.is_domestic_ticker(sym).alias("is_domestic"))


def financial_flags(spark, sf):
    d = X.read(spark, sf, "part")
    sector = F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("4"), F.col("p_size").cast("string")))
    industry = F.when(F.col("p_size") % 3 == 0, F.concat(F.col("p_type"), F.lit(" Banking"))).when(F.col("p_size") % 5 == 0, "Mining")
    return d.groupBy("p_size").agg(F.count_if(K.is_financial(sector, industry)).alias("n_financial"), F.count("*").alias("n"))


def fiscal_columns(spark, sf):
    d = X.read(spark, sf, "orders").select(F.col("o_orderdate").cast("date").cast("string").alias("report_date"))
    return M.add_fiscal_columns(d).groupBy("fiscal_year", "fiscal_period").agg(F.count("*").alias("n"))


def numbers(spark, sf):
    n = F.col("l_linenumber")
    text = F.when(n == 1, "NaN").when(n == 2, "n/a").when(n == 3, "").otherwise(F.col("l_quantity").cast("string"))
    d = X.read(spark, sf, "lineitem").select("l_linenumber", K.to_number(text).alias("x"))
    return d.groupBy("l_linenumber").agg(F.count("x").alias("n"), sig(F.sum("x")).alias("total"))


# --- oracle side ----------------------------------------------------------------------------------------------

def sql(names, select, extra=None):
    return with_sql(names, select, {**all_ctes(), **(extra or {})})


def b_item(c: str) -> str:
    return {"income_tax": "-income_tax", "fixed_asset_change": "-abs(fixed_asset_change)"}.get(c, c)


WORDS = {"income": ["totalRevenue", "costOfRevenue", "grossProfit", "operatingIncome", "interestExpense", "incomeBeforeTax", "incomeTaxExpense", "netIncome",
                    "netIncomeApplicableToCommonShares", "depreciationAndAmortization", "researchDevelopment", "dividendsPaid"],
         "balance": ["totalAssets", "totalStockholderEquity", "totalCurrentAssets", "totalCurrentLiabilities", "inventory", "netReceivables", "accountsPayable", "propertyPlantEquipment",
                     "shortTermDebt", "longTermDebt", "totalLiabilities", "cash", "cashAndShortTermInvestments", "totalCashFromOperatingActivities", "capitalExpenditures",
                     "netIncomeApplicableToCommonShares"],
         "cashflow": ["totalCashFromOperatingActivities", "operatingIncome", "dividendsPaid"]}
BACK = {**{v: k for k, v in B_NAMES.items()}, "cash": "CASE WHEN fiscal_year % 2 = 1 THEN cash_items END", "cashAndShortTermInvestments": "CASE WHEN fiscal_year % 2 = 0 THEN cash_items END"}

QUERIES = {
    "s1_s2_vendor_a_prices": (a_prices, with_sql(["prices"], f"""SELECT ticker, date, max(id) AS id, count(*) AS n, {sig_sql('sum(CASE WHEN l_linenumber <> 6 THEN adj_close END)')} AS adj_close,
  {sig_sql('sum(CASE WHEN l_linenumber = 5 THEN 0 ELSE dividend END)')} AS dividend, {sig_sql('sum(shares)')} AS shares FROM prices WHERE l_linenumber <> 7 GROUP BY 1, 2""")),
    "s3_j3_vendor_a_fundamentals": (a_fundamentals, sql(FUND_NAMES[:4], f"SELECT {rounded_sql(S.KEYS, ITEMS)} FROM merged")),
    "s4_j8_vendor_a_sectors": (a_sectors, with_sql(["companies"], "SELECT ticker AS TICKER, sector, sector = 'MIDDLE EAST' AS is_financial FROM companies")),
    "s4_missing_dimension": (missing_dimension, "SELECT DISTINCT 'S' || l_suppkey AS TICKER, CAST(NULL AS VARCHAR) AS sector FROM lineitem"),
    "s5_vendor_b_prices": (b_prices, with_sql(["prices"], f"""SELECT ticker, ticker AS id, date, CAST(0 AS BIGINT) AS n_shares, {sig_sql('sum(adj_close)')} AS adj_close,
  CAST(0 AS DOUBLE) AS dividend FROM prices GROUP BY 1, 2, 3""")),
    "s6_vendor_b_fundamentals": (b_fundamentals, sql(FUND_NAMES[:4], "SELECT " + ", ".join([*S.KEYS, *[f"{sig_sql(b_item(c))} AS {c}" for c in B_ITEMS]]) + " FROM merged")),
    "s7_vendor_b_sectors": (b_dimensions, with_sql(["companies"], "SELECT ticker AS TICKER, sector, industry = 'NATION_3' AS is_financial FROM companies")),
    "s7_u4_vendor_b_industries": (b_industries, with_sql(["companies"], "SELECT DISTINCT sector, industry, CAST(NULL AS VARCHAR) AS gics_sector FROM companies")),
    "s8_vendor_b_macro": (b_macro, with_sql(["macro_long"], f"""SELECT date AS public_date, {sig_sql("max(CASE WHEN indicator = 'F' THEN value END)")} AS F,
  {sig_sql("max(CASE WHEN indicator = 'O' THEN value END)")} AS O, {sig_sql("max(CASE WHEN indicator = 'P' THEN value END)")} AS P FROM macro_long GROUP BY 1""")),
    "s10_macro_file": (macro_file, with_sql(["benchmark_daily"], f"SELECT date AS public_date, {sig_sql('CASE WHEN month(date) <> 4 THEN level END')} AS SERIES FROM benchmark_daily")),
    "s10_w7_macro_rates": (macro_rates, with_sql(["benchmark_daily", "readings", "calendar", "filled"], f"""SELECT f.public_date, {sig_sql('f.c')} AS "USACPIALLMINMEI", {sig_sql('f.g')} AS "GDP",
  {sig_sql('f.c / m.c - 1')} AS "1mo_inf_rate", {sig_sql('f.c / y.c - 1')} AS "1yr_inf_rate", {sig_sql('f.g / m.g - 1')} AS "1mo_GDP", {sig_sql('f.g / y.g - 1')} AS "1yr_GDP"
  FROM filled f LEFT JOIN filled m ON m.n = f.n - 1 LEFT JOIN filled y ON y.n = f.n - 12""", MACRO_RATES)),
    "s11_index_file": (index_file, with_sql(["benchmark_daily"], f"SELECT date, {sig_sql('level')} AS level FROM benchmark_daily WHERE date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'")),
    "s12_s13_o5_panel_files": (panel_files, sql(CLEAN_NAMES, f"SELECT k AS kind, {rounded_sql(PANEL, PANEL_X)} FROM clean, (VALUES ('parquet'), ('csv')) v(k)")),
    "s14_report_files": (report_files, run_sql(f"SELECT d.public_date, n_stocks AS n_rows, {sig_sql('portfolio_return')} AS portfolio_return FROM done d")),
    "s15_tax_files": (tax_files, with_sql([*DISPOSAL_NAMES, "payments"], """SELECT CASE WHEN is_loss THEN 'cgt_losses' ELSE 'cgt_gains' END AS "table", year(ts)::INT AS year, count(*) AS n
  FROM disposal GROUP BY 1, 2 UNION ALL SELECT 'dividends', year(payment_date)::INT, count(*) FROM payments GROUP BY 1, 2""", FIFO)),
    "s16_f7_u5_nested_statements": (nested, sql(FUND_NAMES[:4], f"""SELECT m.ticker AS code, {Q_END} AS date, c.sector, CASE WHEN revenue IS NOT NULL THEN publish_date END AS filing_date,
  {sig_sql('revenue')} AS "totalRevenue", {sig_sql('net_income')} AS "netIncome", {sig_sql('total_assets')} AS "totalAssets",
  {sig_sql('CASE WHEN total_assets IS NOT NULL THEN inventories WHEN revenue IS NOT NULL THEN -1 END')} AS inventory, {sig_sql('fixed_asset_change')} AS "capitalExpenditures"
  FROM merged m JOIN co c ON m.ticker = c.ticker""".replace("FROM merged m JOIN co c", "FROM merged m JOIN (SELECT 'S' || s_suppkey AS ticker, r_name AS sector FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) c"))),
    "s16_f7_all_items": (item_rows, sql(FUND_NAMES[:3], items_sql())),
    "s16_company_info": (company_general, general_sql()),
    "s17_statement_split": (statement_split, sql(FUND_NAMES[:4], " UNION ALL ".join(
        f"SELECT '{s}' AS statement, '{c}' AS \"column\", count({BACK[c]}) AS n FROM merged" for s, cs in WORDS.items() for c in cs))),
    "p1_p2_mapped_columns": (mapped, f"""SELECT {sig_sql('rate')} AS rate, {sig_sql('sum(-l_quantity)')} AS size FROM (SELECT coalesce(CASE WHEN l_returnflag = 'A' THEN l_tax END, l_discount) AS rate,
  l_quantity FROM lineitem) GROUP BY rate"""),
    "p3_fiscal_periods": (fiscal_periods, """SELECT CASE l_linenumber WHEN 1 THEN 'Q1' WHEN 2 THEN 'Q2' WHEN 3 THEN 'Q3' WHEN 4 THEN 'Q4' WHEN 5 THEN 'FY' WHEN 6 THEN '5' END AS period, count(*) AS n
  FROM lineitem GROUP BY 1"""),
    "p4_common_stock": (stock_types, """SELECT c_mktsegment, count(*) FILTER (c_mktsegment IN ('BUILDING', 'MACHINERY')) AS n_common, count(*) AS n FROM customer GROUP BY 1"""),
    "p5_domestic_tickers": (domestic, """SELECT s AS symbol, length(s) >= 2 AND NOT (length(s) >= 5 AND right(s, 1) IN ('F', 'Y')) AS is_domestic
  FROM (SELECT lpad(CAST(c_custkey AS VARCHAR), 4, '0') || left(c_mktsegment, 1) AS s FROM customer)"""),
    "p6_financial_companies": (financial_flags, """SELECT p_size, count(*) FILTER ((p_size % 4 = 0 AND '4' || p_size LIKE '%40%') OR p_size % 3 = 0) AS n_financial, count(*) AS n FROM part GROUP BY 1"""),
    "p7_fiscal_columns": (fiscal_columns, "SELECT year(o_orderdate)::INT AS fiscal_year, 'Q' || quarter(o_orderdate) AS fiscal_period, count(*) AS n FROM orders GROUP BY 1, 2"),
    "p9_numbers": (numbers, f"""SELECT l_linenumber, count(*) FILTER (l_linenumber > 3) AS n, {sig_sql('sum(CASE WHEN l_linenumber > 3 THEN l_quantity END)')} AS total FROM lineitem GROUP BY 1"""),
}
