"""Vendor columns to library columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C
from ..functions import columns as X


def quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def map_columns(df: DataFrame, mapping: Mapping[str, str], keep_unmapped: bool = True) -> DataFrame:
    """Rename by ``mapping``; sources that share a target give their first non-null value in column order."""
    groups: dict[str, list[str]] = {}
    for c in df.columns:
        if c in mapping or keep_unmapped:
            groups.setdefault(mapping.get(c, c), []).append(c)
    kinds = dict(df.dtypes)

    def one(sources: Sequence[str]) -> Column:
        cols = [quoted(s) for s in sources]
        if len({kinds[s] for s in sources}) > 1:
            cols = [c.cast("string") for c in cols]
        return F.coalesce(*cols) if len(cols) > 1 else cols[0]

    return df.select(*[one(sources).alias(target) for target, sources in groups.items()])


def negate(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sign turned for the columns that exist."""
    return df.select(*[(-F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def fit_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the columns of ``schema``: text and numbers to its types (bad values NULL), absent columns typed NULL."""
    have = set(df.columns)

    def one(f: T.StructField) -> Column:
        if f.name not in have:
            return F.lit(None).cast(f.dataType).alias(f.name)
        c = F.col(f.name)
        if isinstance(f.dataType, T.DoubleType):
            c = X.to_number(c)
        elif isinstance(f.dataType, T.DateType):
            c = X.to_day(c)
        elif isinstance(f.dataType, T.IntegerType):
            c = X.to_number(c).cast("int")
        else:
            c = c.cast(f.dataType)
        return c.alias(f.name)

    return df.select(*[one(f) for f in schema.fields])


def add_fiscal_columns(df: DataFrame, date: str = "report_date") -> DataFrame:
    """Fiscal year and quarter from the period end, where the vendor gives none."""
    if date not in df.columns:
        return df
    day = X.to_day(F.col(date))
    if "fiscal_year" not in df.columns:
        df = df.withColumn("fiscal_year", X.fiscal_year_of(day))
    if "fiscal_period" not in df.columns:
        df = df.withColumn("fiscal_period", F.when(day.isNotNull(), X.fiscal_quarter_of(day)))
    return df


def statement_columns(columns: Sequence[str]) -> dict[str, list[str]]:
    """Columns of a wide statements table by statement, from words in their names; one may belong to several."""
    meta = [c for c in C.STATEMENT_META if c in columns]

    def pick(words: Sequence[str]) -> list[str]:
        return meta + sorted(c for c in columns if c not in meta and any(w in c.lower() for w in words))

    return {"income": pick(C.INCOME_WORDS), "balance": pick(C.BALANCE_WORDS), "cashflow": pick(C.CASHFLOW_WORDS)}
