"""Panel validation: every check is a row (check, severity, n, rate, raised)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..operators.winsor import long_form

REQUIRED = ["TICKER", "public_date", "MthPrc", "MthCap"]
CRITICAL = ["roe", "roa", "ptb", "de_ratio"]
_NUMERIC = {"double", "float", "int", "bigint", "smallint", "tinyint"}
_CHECK = "check string, severity string, n bigint, rate double, raised boolean"


def schema_checks(df: DataFrame) -> DataFrame:
    """Required columns that are missing, columns of the wrong type, and thin feature categories; reads no rows."""
    kinds = dict(df.dtypes)
    rows = []
    for c in REQUIRED:
        rows.append((f"missing column {c}", "issue", int(c not in kinds), None, c not in kinds))
    if "public_date" in kinds:
        wrong = kinds["public_date"] not in ("date", "timestamp", "timestamp_ntz")
        rows.append(("type public_date", "issue", int(wrong), None, wrong))
    for c in ["MthPrc", "MthCap", "1yr_return"]:
        if c in kinds:
            wrong = kinds[c] not in _NUMERIC and not kinds[c].startswith("decimal")
            rows.append((f"type {c}", "issue", int(wrong), None, wrong))
    for category, names in C.FEATURE_CATEGORIES.items():
        have = sum(n in kinds for n in names)
        rows.append((f"features {category}", "warning", have, have / len(names), have < len(names) / 2))
    return df.sparkSession.createDataFrame(rows, _CHECK)


def value_checks(df: DataFrame) -> DataFrame:
    """Value ranges and missing data in one aggregate."""
    have = set(df.columns)
    low, high = C.RETURN_BOUNDS
    n = F.count("*")
    rules: list[tuple[str, str, Column, Column, Column]] = []

    def counted(name: str, severity: str, condition: Column) -> None:
        hits = F.count_if(condition)
        rules.append((name, severity, hits, hits / n, hits > 0))

    def missing(name: str, c: Column, limit: float) -> None:
        share = F.avg(c.isNull().cast("double"))
        rules.append((name, "warning", F.count_if(c.isNull()), share, share > limit))

    if "MthPrc" in have:
        counted("negative price", "issue", F.col("MthPrc") < 0)
        counted("penny price", "warning", F.col("MthPrc") < C.MIN_PRICE)
    if "MthCap" in have:
        counted("cap not positive", "issue", F.col("MthCap") <= 0)
    if "1yr_return" in have:
        counted("extreme return", "warning", (F.col("1yr_return") < low) | (F.col("1yr_return") > high))
        missing("missing target", F.col("1yr_return"), 0.5)
    for c in CRITICAL:
        if c in have:
            missing(f"missing {c}", F.col(c), 0.7)
    cells = F.lit(0)
    for c in df.columns:
        cells = cells + F.col(c).isNull().cast("long")
    share = F.sum(cells) / (n * len(df.columns))
    rules.append(("missing cells", "warning", F.sum(cells), share, share > 0.3))
    packed = df.agg(F.array(*[
        F.struct(F.lit(name).alias("check"), F.lit(sev).alias("severity"), F.coalesce(hits.cast("long"), F.lit(0)).alias("n"),
                 rate.cast("double").alias("rate"), F.coalesce(up, F.lit(False)).alias("raised"))
        for name, sev, hits, rate, up in rules]).alias("rows"))
    return packed.select(F.inline("rows"))


def duplicate_check(df: DataFrame, keys: Sequence[str] = ("TICKER", "public_date")) -> DataFrame:
    extra = F.coalesce(F.sum(F.col("c") - 1), F.lit(0))
    return df.groupBy(*keys).agg(F.count("*").alias("c")).agg(extra.alias("n"), F.sum("c").alias("all")).select(
        F.lit("duplicate keys").alias("check"), F.lit("warning").alias("severity"), "n",
        F.try_divide(F.col("n").cast("double"), F.col("all")).alias("rate"), (F.col("n") > 0).alias("raised"))


def order_breaks(df: DataFrame, sequence: str, by: str = "TICKER", date: str = "public_date", width: int = 100_000) -> DataFrame:
    """Per ticker, how often the date falls back against the row before it in ``sequence`` order.

    Rows are compared inside slices of the sequence; slices are compared by their edge rows, one per slice.
    """
    part = df.select(by, date, sequence).withColumn("__slice", F.floor(F.col(sequence) / width))
    w = Window.partitionBy(by, "__slice").orderBy(sequence)
    inner = part.withColumn("__b", (F.lag(date).over(w) > F.col(date)).cast("long"))
    slices = inner.groupBy(by, "__slice").agg(F.sum("__b").alias("b"), F.min_by(date, sequence).alias("first"),
                                              F.max_by(date, sequence).alias("last"))
    edge = F.lag("last").over(Window.partitionBy(by).orderBy("__slice")) > F.col("first")
    return slices.select(by, F.coalesce("b", F.lit(0)).alias("b"), F.coalesce(edge.cast("long"), F.lit(0)).alias("e")).groupBy(by).agg(
        (F.sum("b") + F.sum("e")).alias("breaks"))


def order_check(df: DataFrame, sequence: str, by: str = "TICKER", date: str = "public_date") -> DataFrame:
    t = order_breaks(df, sequence, by, date)
    bad = F.count_if(F.col("breaks") > 0)
    return t.agg(bad.alias("n"), (bad / F.count("*")).alias("rate")).select(
        F.lit("dates out of order").alias("check"), F.lit("warning").alias("severity"), "n", "rate", (F.col("n") > 0).alias("raised"))


def validate_panel(df: DataFrame, sequence: str | None = None) -> DataFrame:
    """All checks. The date order is checked where the table carries its arrival order in a column."""
    checks = schema_checks(df)
    body = df.drop(sequence) if sequence else df
    checks = checks.unionByName(value_checks(body))
    if {"TICKER", "public_date"} <= set(df.columns):
        checks = checks.unionByName(duplicate_check(df))
        if sequence:
            checks = checks.unionByName(order_check(df, sequence))
    return checks


def verdict(checks: DataFrame, strict: bool = False) -> DataFrame:
    """One row: issues, warnings and whether the panel is valid; ``strict`` counts warnings too."""
    up = F.col("raised")
    issues, warnings = F.count_if(up & (F.col("severity") == "issue")), F.count_if(up & (F.col("severity") == "warning"))
    valid = (issues == 0) & (warnings == 0) if strict else issues == 0
    return checks.agg(issues.alias("n_issues"), warnings.alias("n_warnings"), valid.alias("is_valid"))


def pit_compliance(df: DataFrame, target: str = "1yr_return") -> DataFrame:
    """Outcome dates not after the observation, and holding periods far from the target's in more than a tenth of rows."""
    want = C.HOLDING_DAYS.get(target, 365)
    slack = 15 if want <= 91 else 30
    days = F.datediff("outcome_date", "public_date")
    early = F.count_if(F.col("outcome_date") <= F.col("public_date"))
    odd = F.count_if((days < want - slack) | (days > want + slack))
    return df.agg(F.count("*").alias("n_rows"), early.alias("violations"), odd.alias("odd_periods"),
                  ((early == 0) & (odd <= F.count("*") * 0.1)).alias("is_compliant"))


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), F.count_distinct("TICKER").alias("n_tickers"), F.count_distinct("public_date").alias("n_months"),
                  F.min("public_date").alias("first_date"), F.max("public_date").alias("last_date"))


def null_shares(df: DataFrame) -> DataFrame:
    """(column, missing_share) of every column."""
    wide = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in df.columns])
    return long_form(wide, df.columns).select(F.col("feature").alias("column"), F.col("value").alias("missing_share"))


def null_summary(shares: DataFrame) -> DataFrame:
    return shares.agg(F.avg("missing_share").alias("mean_missing_rate"), F.count_if(F.col("missing_share") > 0.5).alias("cols_over_half"),
                      F.count_if(F.col("missing_share") == 0).alias("cols_complete"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))


def return_stats(df: DataFrame, column: str = "1yr_return") -> DataFrame:
    return df.agg(F.avg(column).alias("mean"), F.stddev(column).alias("std"), F.min(column).alias("min"), F.max(column).alias("max"),
                  (F.count(column) / F.count("*")).alias("valid_share"))
