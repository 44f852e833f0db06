"""Monthly point-in-time panel: month bars, trailing statements, as-of merge, ratios, filters, buckets, macro."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from .. import schemas as S
from ..functions import columns as X
from ..functions.ratios import ratio_names, total_debt, with_ratios
from ..operators.asof import asof_join
from ..operators.quantile import exact_quantiles
from ..operators.winsor import winsorize
from ..session import materialize, sized


@dataclass
class Tables:
    """Inputs of the panel; ``macro`` and ``financials`` may be missing."""

    prices: DataFrame
    fundamentals: DataFrame
    sectors: DataFrame | None = None
    financials: DataFrame | None = None
    macro: DataFrame | None = None


# --- month bars -----------------------------------------------------------------------------------------------

def last_rows_of_month(prices: DataFrame, ties: Sequence[str] = ()) -> DataFrame:
    """One row per (ticker, month): the last trading row, and the month's dividends.

    A ticker with very many daily rows reaches the later per-ticker windows as one row per month. With one row per
    (ticker, date), the contract of a price table, the daily rows go through a hash aggregate of fixed-width values
    before they are moved, and the few rows left (one per id a ticker had in a month) through a second one. ``ties``
    orders several rows of one day and needs a sort: the daily rows go to their (ticker, month) first, since a sort of
    whole input splits is larger than a task's memory.
    """
    rows = prices.dropna(subset=["ticker", "date"]).withColumn("public_date", F.last_day("date"))
    order = F.struct("date", *ties) if ties else F.col("date")
    if ties:
        rows = rows.repartition("ticker", "public_date")
    else:
        rows = rows.groupBy("ticker", "id", "public_date").agg(
            F.max_by("adj_close", "date").alias("adj_close"), F.max_by("shares", "date").alias("shares"),
            F.sum("dividend").alias("dividend"), F.max("date").alias("date"))
    last = F.max_by(F.struct("id", "adj_close", "shares"), order)
    return (
        rows.groupBy("ticker", "public_date")
        .agg(last.alias("last"), F.coalesce(F.sum("dividend"), F.lit(0.0)).alias("Div_m"), F.max("date").alias("last_date"))
        .select(F.col("ticker").alias("TICKER"), "public_date", F.col("last.id").alias("gvkey"),
                F.col("last.adj_close").alias("MthPrc"), F.col("last.shares").alias("shares"), "Div_m", "last_date")
    )


def month_number(d: Column) -> Column:
    return F.year(d) * 12 + F.month(d)


def month_bars(prices: DataFrame, ties: Sequence[str] = (), shares: DataFrame | None = None) -> DataFrame:
    """Month bars with trailing dividends, market cap, dividend yield and the four forward returns.

    ``shares`` (ticker, date, shares) supplies share counts where the price table has none: an as-of on the month's
    last trading day, which gives what an as-of on every day followed by the month's last row gives.
    """
    m = last_rows_of_month(prices, ties)
    if shares is not None:
        counts = shares.dropna(subset=["ticker", "date", "shares"]).select(
            F.col("ticker").alias("TICKER"), "date", "shares")
        m = asof_join(m.drop("shares"), counts, ["TICKER"], "last_date", "date", ["shares"], ties=["shares"])
    by_month = Window.partitionBy("TICKER").orderBy("month_no")
    year = by_month.rowsBetween(-11, 0)
    so_far = by_month.rowsBetween(Window.unboundedPreceding, 0)
    price = F.col("MthPrc")
    m = m.withColumn("month_no", month_number(F.col("public_date"))).select(
        "TICKER", "gvkey", "public_date", "MthPrc",
        F.last("shares", ignorenulls=True).over(so_far).alias("shares"),
        F.sum("Div_m").over(year).alias("Div_ttm"),
        *[F.first("MthPrc").over(by_month.rangeBetween(n, n)).alias(f"ahead_{n}") for n in C.HORIZONS.values()])
    return m.select(
        "TICKER", "gvkey", "public_date", "MthPrc", "shares", "Div_ttm",
        (price * F.col("shares")).alias("MthCap"),
        F.when(price > 0, F.coalesce("Div_ttm", F.lit(0.0)) / price).alias("divyield"),
        *[F.when(price > 0, X.ratio(F.col(f"ahead_{n}") - price, price)).alias(c) for c, n in C.HORIZONS.items()])


# --- statements -----------------------------------------------------------------------------------------------

def merge_statements(income: DataFrame, balance: DataFrame, cashflow: DataFrame) -> DataFrame:
    """Full outer join of the three statements on their four keys; clashing names get ``_bal`` and ``_cf``."""
    def renamed(df: DataFrame, suffix: str, taken: set[str]) -> DataFrame:
        return df.select(*[F.col(c).alias(f"{c}{suffix}") if c in taken and c not in S.KEYS else F.col(c)
                           for c in df.columns])

    both = income.join(renamed(balance, "_bal", set(income.columns)), S.KEYS, "full")
    return both.join(renamed(cashflow, "_cf", set(both.columns)), S.KEYS, "full")


def trailing_sums(df: DataFrame, items: Sequence[str], by: str = "ticker",
                  order: Sequence[str] = ("fiscal_year", "fiscal_period", "publish_date"),
                  periods: int = 4) -> DataFrame:
    """Sum over the last ``periods`` rows as ``_ttm``; NULL unless all of them are present."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(1 - periods, 0)
    return df.select("*", *[F.when(F.count(i).over(w) == periods, F.sum(i).over(w)).alias(f"{i}_ttm") for i in items])


def quarterly_fundamentals(merged: DataFrame) -> DataFrame:
    """Merged statements with trailing sums of the flows and total debt."""
    return trailing_sums(merged, S.FLOW_ITEMS).withColumn("total_debt", total_debt())


def merge_point_in_time(bars: DataFrame, fundamentals: DataFrame, lag_months: int = C.FUNDAMENTAL_LAG_MONTHS) -> DataFrame:
    """Each month bar with the latest statement already public: publish date plus lag strictly before the month end."""
    right = fundamentals.dropna(subset=["publish_date", "ticker"]).select(
        F.col("ticker").alias("TICKER"), F.add_months("publish_date", lag_months).alias("known_from"),
        *[c for c in fundamentals.columns if c != "ticker"])
    cols = [c for c in fundamentals.columns if c != "ticker" and c not in bars.columns]
    return asof_join(bars.dropna(subset=["public_date", "TICKER"]), right, ["TICKER"], "public_date", "known_from", cols,
                     strict=lag_months > 0, ties=["fiscal_year", "fiscal_period"])


def keep_domestic(df: DataFrame) -> DataFrame:
    return df.where(X.is_domestic_ticker(F.col("TICKER")))


# --- dimensions and filters -----------------------------------------------------------------------------------

def add_sectors(panel: DataFrame, sectors: DataFrame | None, financials: DataFrame | None = None,
                exclude_financials: bool = True) -> DataFrame:
    """Sector per ticker, ``Unknown`` where none; financial tickers and the financial sector leave.

    No broadcast hint: the panel is already partitioned by ticker, and Spark broadcasts the dimension by its size.
    """
    if sectors is None:
        return panel.withColumn("sector", F.lit("Unknown"))
    out = panel.join(sectors.select("TICKER", "sector"), "TICKER", "left").withColumn(
        "sector", F.coalesce("sector", F.lit("Unknown")))
    if exclude_financials:
        if financials is not None:
            out = out.join(financials.select("TICKER"), "TICKER", "left_anti")
        out = out.where(F.col("sector") != C.FINANCIAL_SECTOR)
    return out


def clean_returns(panel: DataFrame) -> DataFrame:
    return panel.select(*[X.finite(F.col(c)).alias(c) if c in C.HORIZONS else F.col(c) for c in panel.columns])


def quality_condition(columns: Sequence[str]) -> Column:
    low, high = C.RETURN_BOUNDS
    keep = ((F.col("MthPrc") >= C.MIN_PRICE) & (F.col("MthCap") >= C.MIN_MARKET_CAP)
            & (F.col("total_equity") > C.MIN_EQUITY))
    for c in C.HORIZONS:
        if c in columns:
            keep &= F.col(c).isNull() | F.col(c).between(low, high)
    if "revenue_ttm" in columns:
        keep &= F.col("revenue_ttm").isNull() | (F.col("revenue_ttm") > 0)
    return keep


def quality_filter(panel: DataFrame) -> DataFrame:
    return panel.where(quality_condition(panel.columns))


def quality_report(panel: DataFrame) -> DataFrame:
    """Rows before and after the quality filter and how many fail each rule."""
    low, high = C.RETURN_BOUNDS

    def fails(c: Column) -> Column:
        return F.count_if(~F.coalesce(c, F.lit(False)))

    returns_ok = F.lit(True)
    for c in C.HORIZONS:
        returns_ok &= F.col(c).isNull() | F.col(c).between(low, high)
    return panel.agg(
        F.count("*").alias("rows_before"),
        F.count_if(quality_condition(panel.columns)).alias("rows_after"),
        fails(F.col("MthPrc") >= C.MIN_PRICE).alias("fail_price"),
        fails(F.col("MthCap") >= C.MIN_MARKET_CAP).alias("fail_cap"),
        fails(F.col("total_equity") > C.MIN_EQUITY).alias("fail_equity"),
        fails(returns_ok).alias("fail_returns"),
        fails(F.col("revenue_ttm").isNull() | (F.col("revenue_ttm") > 0)).alias("fail_revenue"))


def cap_medians(panel: DataFrame) -> DataFrame:
    """Exact median market cap per year."""
    return exact_quantiles(panel.select(F.year("public_date").alias("year"), "MthCap"), ["year"], "MthCap", [0.5]).select(
        "year", F.col("q").alias("median_cap"))


def add_cap_buckets(panel: DataFrame, year_adjusted: bool = True, base_year: int = C.CAP_BASE_YEAR) -> DataFrame:
    """Size bucket; bounds move with the year's median cap relative to the base year, if that year has data.

    The medians are one value per calendar year and enter as a map from a scalar subquery, so the panel is not moved.
    """
    if not year_adjusted:
        return panel.withColumn("cap", X.cap_bucket(F.col("MthCap")))
    medians = cap_medians(panel).agg(F.map_from_entries(F.collect_list(F.struct("year", "median_cap"))).alias("m"))
    work = panel.withColumn("__m", medians.scalar())
    base = F.try_element_at(F.col("__m"), F.lit(base_year))
    own = F.try_element_at(F.col("__m"), F.year("public_date"))
    scale = F.when(base.isNull(), F.lit(1.0)).otherwise(F.try_divide(own, base))
    return work.withColumn("cap", X.cap_bucket(F.col("MthCap"), scale)).drop("__m")


# --- macro ----------------------------------------------------------------------------------------------------

def pivot_macro(long: DataFrame, indicators: Sequence[str]) -> DataFrame:
    """(date, indicator, value) rows to one row per date; the indicator list keeps the schema fixed. Of repeated
    readings the largest counts, whatever their order."""
    return long.groupBy(F.col("date").alias("public_date")).pivot("indicator", list(indicators)).agg(F.max("value"))


def _calendar(macro: DataFrame) -> DataFrame:
    """One row for every calendar month between the first and the last of ``macro``."""
    ends = macro.agg(F.trunc(F.min("public_date"), "month").alias("low"), F.trunc(F.max("public_date"), "month").alias("high")).where("low IS NOT NULL")
    months = F.sequence("low", "high", F.expr("interval 1 month"))
    return ends.select(F.explode(months).alias("m")).select(F.last_day("m").alias("public_date"))


def month_end_macro(series: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per calendar month, the last reading of the month; gaps, whole months too, are filled from the month before.

    ``series`` has a ``date``, or a ``public_date`` as the macro reader names it.
    """
    date = "date" if "date" in series.columns else "public_date"
    order = Window.orderBy("public_date").rowsBetween(Window.unboundedPreceding, 0)
    m = series.where(F.col(date).isNotNull()).groupBy(F.last_day(date).alias("__month")).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(date))).alias(c) for c in columns]).withColumnRenamed("__month", "public_date")
    every = _calendar(m).join(m, "public_date", "left")
    return every.select("public_date", *[F.last(c, ignorenulls=True).over(order).alias(c) for c in columns])


def add_changes(macro: DataFrame, changes: dict[str, tuple[str, int]]) -> DataFrame:
    """Percent changes over calendar months: name -> (column, months). ``macro`` has one row for each month it has."""
    number = F.year("public_date") * 12 + F.month("public_date")
    out = macro.withColumn("__n", number)
    for months in sorted({n for _, n in changes.values()}):
        wanted = sorted({c for c, n in changes.values() if n == months})
        before = macro.select((number + months).alias("__n"), *[F.col(c).alias(f"__{months}_{c}") for c in wanted])
        out = out.join(before, "__n", "left")
    return out.select(*macro.columns, *[(F.try_divide(F.col(c), F.col(f"__{n}_{c}")) - 1).alias(name) for name, (c, n) in changes.items()])


def macro_features(series: DataFrame) -> DataFrame:
    """Month-end macro table of a series file, with the inflation and output changes that its columns allow."""
    columns = [c for c in series.columns if c not in ("date", "public_date")]
    changes = {name: pair for name, pair in C.MACRO_CHANGES.items() if pair[0] in columns}
    return add_changes(month_end_macro(series, columns), changes)


def lag_macro(macro: DataFrame, rows: int = C.MACRO_LAG_ROWS) -> DataFrame:
    """All macro columns moved down by ``rows``. The table has one row per month; it is the only unpartitioned order."""
    if rows <= 0:
        return macro
    w = Window.orderBy("public_date")
    return macro.select("public_date", *[F.lag(c, rows).over(w).alias(c) for c in macro.columns if c != "public_date"])


def add_macro(panel: DataFrame, macro: DataFrame, lag_rows: int = C.MACRO_LAG_ROWS, as_of: bool = False) -> DataFrame:
    """Macro columns of the same date, or with ``as_of`` of the latest date not after it."""
    lagged = lag_macro(macro, lag_rows)
    if not as_of:
        return panel.join(sized(lagged), "public_date", "left")
    cols = [c for c in lagged.columns if c != "public_date"]
    months = asof_join(panel.select("public_date").distinct().withColumn("__one", F.lit(1)),
                       lagged.withColumn("__one", F.lit(1)).withColumnRenamed("public_date", "__from"),
                       ["__one"], "public_date", "__from", cols)
    return panel.join(sized(months.drop("__one")), "public_date", "left")


# --- whole panel ----------------------------------------------------------------------------------------------

def merge_and_rate(tables: Tables, ties: Sequence[str] = (), lag_months: int = C.FUNDAMENTAL_LAG_MONTHS,
                   shares: DataFrame | None = None) -> DataFrame:
    """Month bars with the statements known at the time and all ratios."""
    bars = keep_domestic(month_bars(tables.prices, ties, shares))
    return with_ratios(merge_point_in_time(bars, quarterly_fundamentals(tables.fundamentals), lag_months))


def winsor_columns(panel: DataFrame, legacy_keywords: bool = False) -> list[str]:
    """Columns to clip: the ratios by name, or every column whose name contains a ratio word."""
    if legacy_keywords:
        return [c for c in panel.columns if any(w in c.lower() for w in C.RATIO_WORDS)
                and dict(panel.dtypes)[c] in ("double", "float", "int", "bigint")]
    return [c for c in ratio_names() if c in panel.columns]


def build_panel(tables: Tables, *, ties: Sequence[str] = (), lag_months: int = C.FUNDAMENTAL_LAG_MONTHS,
                shares: DataFrame | None = None, apply_filters: bool = True, year_adjusted: bool = True,
                base_year: int = C.CAP_BASE_YEAR, clip_ratios: bool = True, n_mad: float = C.WINSOR_MAD,
                legacy_keywords: bool = False, macro_lag: int = C.MACRO_LAG_ROWS, exclude_financials: bool = True,
                macro_as_of: bool = False, derive_macro: bool = False) -> DataFrame:
    """The panel. With ``derive_macro`` the macro table holds readings of any frequency, which become month ends with
    derived changes. Medians for buckets and clipping are taken after the filters; the filtered panel is stored once
    because they read it several times."""
    panel = add_sectors(merge_and_rate(tables, ties, lag_months, shares), tables.sectors, tables.financials,
                        exclude_financials)
    panel = clean_returns(panel)
    if apply_filters:
        panel = quality_filter(panel)
    if year_adjusted or clip_ratios:
        panel = materialize(panel)
    panel = add_cap_buckets(panel, year_adjusted, base_year)
    if clip_ratios:
        panel = winsorize(panel, winsor_columns(panel, legacy_keywords), n_mad)
    if tables.macro is not None:
        macro = macro_features(tables.macro) if derive_macro else tables.macro
        panel = add_macro(panel, macro, macro_lag, macro_as_of)
    return panel.dropna(subset=["gvkey", "public_date", "MthPrc", "MthCap"])
