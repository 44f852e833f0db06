"""Writers: panels, run reports, tax tables, split statements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .mapping import statement_columns


def write_panel(panel: DataFrame, path: str, format: str = "parquet", mode: str = "overwrite") -> None:
    """Parquet by year of the month end, sorted by ticker inside the files, or CSV with a header.

    Rows are first laid out in ranges of (year, ticker): a large year is shared by several tasks, and the number of
    files is about the number of tasks plus the number of years.
    """
    if format == "csv":
        panel.write.mode(mode).csv(path, header=True)
        return
    (panel.withColumn("year", F.year("public_date")).repartitionByRange("year", "TICKER").sortWithinPartitions("year", "TICKER", "public_date")
     .write.mode(mode).partitionBy("year").parquet(path))


def write_tables(tables: dict[str, DataFrame], folder: str, format: str = "csv", mode: str = "overwrite") -> dict[str, str]:
    """Report tables (periods, selections, summary) under one folder."""
    paths = {}
    for name, df in tables.items():
        paths[name] = f"{folder.rstrip('/')}/{name}"
        writer = df.write.mode(mode)
        writer.csv(paths[name], header=True) if format == "csv" else writer.format(format).save(paths[name])
    return paths


def write_tax_tables(disposals: DataFrame, dividends: DataFrame, folder: str, format: str = "parquet", mode: str = "overwrite") -> dict[str, str]:
    """Gains, losses and dividends, each partitioned by year."""
    d = disposals.withColumn("year", F.year("ts"))
    sets = {"cgt_gains": d.where(~F.col("is_loss")), "cgt_losses": d.where("is_loss"), "dividends": dividends.withColumn("year", F.year("payment_date"))}
    root = folder.rstrip("/")
    for name, df in sets.items():
        df.write.mode(mode).partitionBy("year").format(format).save(f"{root}/{name}")
    return {name: f"{root}/{name}" for name in sets}


def write_statements(wide: DataFrame, folder: str, mode: str = "overwrite") -> dict[str, str]:
    """A wide statements table as itself and as three tables by column name; it is worked out once and stored first."""
    wide = materialize(wide)
    root = folder.rstrip("/")
    wide.write.mode(mode).parquet(f"{root}/fundamentals_all.parquet")
    paths = {"fundamentals_all": f"{root}/fundamentals_all.parquet"}
    for name, columns in statement_columns(wide.columns).items():
        paths[name] = f"{root}/{name}.parquet"
        wide.select(*columns).write.mode(mode).parquet(paths[name])
    return paths
