"""Readers: two vendors, macro and index series, panels, nested statements."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..functions import columns as X
from ..plans.panel import merge_statements, pivot_macro
from .mapping import add_fiscal_columns, fit_schema, map_columns, quoted


def read_delimited(spark: SparkSession, path: str, columns: Mapping[str, str] | None = None, sep: str = ";") -> DataFrame:
    """Text columns of a delimited file with a header; of ``columns`` those that exist, renamed."""
    raw = spark.read.csv(path, sep=sep, header=True, inferSchema=False)
    if columns is None:
        return raw
    return raw.select(*[quoted(c).alias(columns[c]) for c in raw.columns if c in columns])


def _optional(read, spark: SparkSession, schema: T.StructType) -> DataFrame:
    """The table, or an empty one with its schema where the file is missing."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


class VendorA:
    """Semicolon-delimited files: us-shareprices-daily, us-income/balance/cashflow-quarterly, us-companies, industries."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _file(self, name: str, columns: Mapping[str, str]) -> DataFrame:
        return read_delimited(self.spark, f"{self.folder}/{name}.csv", columns)

    def prices(self) -> DataFrame:
        raw = read_delimited(self.spark, f"{self.folder}/us-shareprices-daily.csv")
        ids = {c: "id" for c in raw.columns if c.endswith("Id")}
        names = {**S.PRICE_HEADERS, **ids}
        d = fit_schema(raw.select(*[quoted(c).alias(names[c]) for c in raw.columns if c in names]), S.PRICES)
        return d.dropna(subset=["ticker", "id", "date"]).withColumn("dividend", F.coalesce("dividend", F.lit(0.0)))

    def _statement(self, name: str, headers: Mapping[str, str], schema: T.StructType) -> DataFrame:
        return fit_schema(self._file(name, {**S.KEY_HEADERS, **headers}), schema).dropna(subset=["ticker", "publish_date"])

    def income(self) -> DataFrame:
        return self._statement("us-income-quarterly", S.INCOME_HEADERS, S.INCOME)

    def balance(self) -> DataFrame:
        return self._statement("us-balance-quarterly", S.BALANCE_HEADERS, S.BALANCE)

    def cashflow(self) -> DataFrame:
        return self._statement("us-cashflow-quarterly", S.CASHFLOW_HEADERS, S.CASHFLOW)

    def fundamentals(self) -> DataFrame:
        return merge_statements(self.income(), self.balance(), self.cashflow())

    def companies(self) -> DataFrame:
        names = {"Ticker": "ticker", "Company Name": "company_name", "IndustryId": "industry_id"}
        return _optional(lambda: fit_schema(self._file("us-companies", names), S.COMPANIES), self.spark, S.COMPANIES)

    def industries(self) -> DataFrame:
        names = {"IndustryId": "industry_id", "Sector": "sector", "Industry": "industry"}
        return _optional(lambda: fit_schema(self._file("industries", names), S.INDUSTRIES), self.spark, S.INDUSTRIES)

    def sectors(self) -> DataFrame:
        return self.companies().select("ticker", "industry_id").join(
            self.industries().select("industry_id", "sector"), "industry_id", "left").select(F.col("ticker").alias("TICKER"), "sector")

    def financials(self) -> DataFrame:
        from ..constants import FINANCIAL_INDUSTRY_PREFIX
        return self.companies().where(F.col("industry_id").startswith(FINANCIAL_INDUSTRY_PREFIX)).select(
            F.col("ticker").alias("TICKER")).distinct()


class VendorB:
    """Parquet files: prices, income, balance, cashflow, companies, companies_detail, macro."""

    def __init__(self, spark: SparkSession, folder: str, legacy_capex: bool = False):
        self.spark, self.folder, self.legacy_capex = spark, folder.rstrip("/"), legacy_capex

    def _file(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def prices(self) -> DataFrame:
        d = map_columns(self._file("prices"), {**S.B_PRICES, "Dividend": "dividend", "Shares Outstanding": "shares"})
        if "adj_close" not in d.columns and "close" in d.columns:
            d = d.withColumn("adj_close", F.col("close"))
        if "id" not in d.columns:
            d = d.withColumn("id", F.col("ticker"))
        return fit_schema(d, S.PRICES).dropna(subset=["ticker", "date"]).withColumn("dividend", F.coalesce("dividend", F.lit(0.0)))

    def _statement(self, name: str, mapping: Mapping[str, str], schema: T.StructType) -> DataFrame:
        d = map_columns(self._file(name), {**S.B_META, **mapping})
        if "publish_date" not in d.columns and "report_date" in d.columns:
            d = d.withColumn("publish_date", F.col("report_date"))
        d = add_fiscal_columns(d).withColumn("fiscal_period", X.fiscal_period(F.col("fiscal_period")))
        return fit_schema(d, schema).dropna(subset=["ticker", "publish_date"])

    def income(self) -> DataFrame:
        """Tax is an expense with a positive sign at the vendor."""
        return self._statement("income", S.B_INCOME, S.INCOME).withColumn("income_tax", -F.col("income_tax"))

    def _balance(self) -> DataFrame:
        extra = [T.StructField("shares", T.DoubleType()), T.StructField("fixed_asset_change", T.DoubleType())]
        d = self._statement("balance", S.B_BALANCE, T.StructType([*S.BALANCE.fields, *extra]))
        return d if self.legacy_capex else d.withColumn("fixed_asset_change", -F.abs("fixed_asset_change"))

    def balance(self) -> DataFrame:
        return self._balance().select(*S.BALANCE.fieldNames())

    def shares(self) -> DataFrame:
        return self._balance().select("ticker", F.col("publish_date").alias("date"), "shares").dropna()

    def cashflow(self) -> DataFrame:
        """Capital spending is an outflow."""
        return self._statement("cashflow", S.B_CASHFLOW, S.CASHFLOW).withColumn("fixed_asset_change", -F.abs("fixed_asset_change"))

    def fundamentals(self) -> DataFrame:
        """Capital spending may sit in either file; it is taken once, as an outflow."""
        balance = self._balance().select(*S.BALANCE.fieldNames(), "fixed_asset_change")
        d = merge_statements(self.income(), balance, self.cashflow())
        return d.withColumn("fixed_asset_change", F.coalesce("fixed_asset_change_cf", "fixed_asset_change")).drop("fixed_asset_change_cf")

    def companies(self) -> DataFrame:
        return _optional(lambda: fit_schema(map_columns(self._file("companies"), S.B_COMPANIES), S.COMPANIES), self.spark, S.COMPANIES)

    def industries(self) -> DataFrame:
        return self.companies().select("sector", "industry", "gics_sector").distinct()

    def _detail(self) -> DataFrame:
        schema = T.StructType([T.StructField(c, T.StringType()) for c in ("ticker", "sector", "industry", "gics_sector")])
        found = _optional(lambda: fit_schema(map_columns(self._file("companies_detail"), {"code": "ticker", "Code": "ticker"}), schema), self.spark, schema)
        return found if found.take(1) else self.companies().select(*schema.fieldNames())

    def sectors(self) -> DataFrame:
        """The first sector column that holds any value: the industry standard, else the vendor's own."""
        d = self._detail()
        filled = d.agg(F.count("gics_sector").alias("g"), F.count("sector").alias("s")).first()
        column = "gics_sector" if filled["g"] else "sector"
        return d.select(F.col("ticker").alias("TICKER"), F.col(column).alias("sector")).dropna()

    def financials(self) -> DataFrame:
        sector = F.coalesce(F.nullif("gics_sector", F.lit("")), F.col("sector"))
        return self._detail().where(X.is_financial(sector, F.col("industry"))).select(F.col("ticker").alias("TICKER")).distinct()

    def macro(self, indicators: Sequence[str] | None = None) -> DataFrame:
        """One column per indicator. Without a list the few names in the file are read first."""
        d = map_columns(self._file("macro"), {"Date": "date", "Value": "value"}).select(X.to_day(F.col("date")).alias("date"), "indicator", X.to_number(F.col("value")).alias("value"))
        names = indicators or sorted(r[0] for r in d.select("indicator").distinct().collect())
        return pivot_macro(d, names)


def read_macro(spark: SparkSession, path: str) -> DataFrame:
    """Macro file with a date column and one column per series; ``.`` is missing."""
    raw = spark.read.csv(path, header=True, inferSchema=False, nullValue=".")
    date = "public_date" if "public_date" in raw.columns else next(c for c in raw.columns if "date" in c.lower())
    return raw.select(X.to_day(quoted(date)).alias("public_date"), *[X.to_number(quoted(c)).alias(c) for c in raw.columns if c != date])


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(date, level) from a Parquet series with a date and an adjusted close."""
    d = map_columns(spark.read.parquet(path), {"Date": "date", "Adj Close": "level", "adj_close": "level"})
    return fit_schema(d, S.BENCHMARK)


def read_panel(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Panel from Parquet, or from CSV with types by ``schema`` or by name."""
    if not path.rstrip("/").endswith(".csv"):
        d = spark.read.parquet(path)
        return d.drop("year") if "year" in d.columns else d
    raw = spark.read.csv(path, header=True, inferSchema=False)
    if schema is not None:
        return fit_schema(raw, schema)
    text = {"TICKER", "gvkey", "sector", "cap", "fiscal_period"}
    days = {"public_date", "publish_date", "outcome_date"}
    return raw.select(*[quoted(c) if c in text else (X.to_day(quoted(c)) if c in days else X.to_number(quoted(c))).alias(c) for c in raw.columns])


# --- nested statements ----------------------------------------------------------------------------------------

_ITEMS = T.MapType(T.StringType(), T.StringType())
_QUARTERLY = T.StructType([T.StructField("quarterly", T.MapType(T.StringType(), _ITEMS))])
NESTED = T.StructType([
    T.StructField("General", _ITEMS),
    T.StructField("Financials", T.StructType([T.StructField("Income_Statement", _QUARTERLY), T.StructField("Balance_Sheet", _QUARTERLY),
                                              T.StructField("Cash_Flow", _QUARTERLY)]))])
COMPANY_FIELDS = {"name": "Name", "exchange": "Exchange", "currency": "CurrencyCode", "country": "CountryName", "sector": "Sector", "industry": "Industry",
                  "gics_sector": "GicSector", "gics_group": "GicGroup", "gics_industry": "GicIndustry", "gics_sub_industry": "GicSubIndustry",
                  "description": "Description", "full_time_employees": "FullTimeEmployees", "ipo_date": "IPODate", "is_delisted": "IsDelisted"}


def parse_nested(df: DataFrame, body: str = "body") -> DataFrame:
    return df.withColumn("__doc", F.from_json(body, NESTED)).drop(body)


def company_info(parsed: DataFrame) -> DataFrame:
    """One row per symbol from the general section."""
    general = F.col("__doc.General")
    return parsed.where(general.isNotNull()).select("code", *[F.try_element_at(general, F.lit(v)).alias(k) for k, v in COMPANY_FIELDS.items()])


STATEMENTS = {"income": "Income_Statement", "balance": "Balance_Sheet", "cashflow": "Cash_Flow"}


def statement_items(df: DataFrame, body: str = "body") -> DataFrame:
    """Every item of every statement of ``df`` (code, body): code, statement, date, item, kind, number, text.

    Documents are read as variants, so items need no list and keep their types: ``kind`` is number, text, boolean or null.
    ``number`` has numbers and texts that are numbers, ``text`` has texts and booleans as written. A body that is not JSON, or a
    statement that is not a mapping of dates to mappings, has no rows.
    """
    doc = F.try_parse_json(body)
    parts = [F.struct(F.lit(name).alias("statement"), F.try_variant_get(doc, f"$.Financials.{path}.quarterly", "map<string,variant>").alias("dates")) for name, path in STATEMENTS.items()]
    dated = df.select("code", F.explode(F.array(*parts)).alias("s")).select("code", "s.statement", F.explode("s.dates").alias("date", "entry"))
    items = dated.select("code", "statement", X.to_day(F.col("date")).alias("date"), F.explode(F.try_variant_get("entry", "$", "map<string,variant>")).alias("item", "value"))
    form, plain = F.schema_of_variant("value"), F.try_variant_get("value", "$", "string")
    kind = F.when(form.isNull() | (form == "VOID"), "null").when(form == "STRING", "text").when(form == "BOOLEAN", "boolean").when(form.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), "number").otherwise("nested")
    rows = items.select("code", "statement", "date", "item", kind.alias("kind"), plain.alias("plain"))
    return rows.select("code", "statement", "date", "item", "kind", F.when(F.col("kind").isin("number", "text"), X.to_number(F.col("plain"))).alias("number"),
                       F.when(F.col("kind").isin("text", "boolean"), F.col("plain")).alias("text"))


def flatten_statements(parsed: DataFrame, items: Sequence[str]) -> DataFrame:
    """One row per (symbol, quarter) over the dates of all three statements.

    Where an item occurs in several statements the cash flow wins over the balance and that over the income statement;
    only the income statement supplies the filing date.
    """
    empty = F.create_map().cast(T.MapType(T.StringType(), _ITEMS))

    def part(name: str) -> Column:
        return F.coalesce(F.col(f"__doc.Financials.{name}.quarterly"), empty)

    d = parsed.select("code", F.col("__doc.General").alias("general"), part("Income_Statement").alias("i"), part("Balance_Sheet").alias("b"), part("Cash_Flow").alias("c"))
    dates = F.array_distinct(F.concat(F.map_keys("i"), F.map_keys("b"), F.map_keys("c")))
    rows = d.withColumn("date", F.explode(dates))
    at = {k: F.try_element_at(F.col(k), F.col("date")) for k in "ibc"}
    rows = rows.select("code", "date", *[F.try_element_at(F.col("general"), F.lit(COMPANY_FIELDS[k])).alias(k) for k in ("sector", "industry", "gics_sector")],
                       *[v.alias(k) for k, v in at.items()])

    def item(name: str) -> Column:
        return F.coalesce(*[F.try_element_at(F.col(k), F.lit(name)) for k in "cbi"])

    return rows.select("code", X.to_day(F.col("date")).alias("date"), "sector", "industry", "gics_sector",
                       X.to_day(F.try_element_at(F.col("i"), F.lit("filing_date"))).alias("filing_date"), *[X.to_number(item(n)).alias(n) for n in items])
