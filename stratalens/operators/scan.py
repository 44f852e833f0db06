"""Running totals over groups of any size: per piece of a group first, then over one row per piece."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


PIECE = "__piece"


def ranged(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = PIECE) -> DataFrame:
    """``df`` laid out by (``by``, ``order``) in ranges of about equal row counts, stored, with the number of its range.

    Ranges ascend within a group, so their number is an order-preserving function of the position. A group with half
    of all rows, even on one day, is half of the ranges; small groups share one. Only rows equal in all these columns must meet.
    The number of ranges is the session's number of shuffle partitions.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = df.repartitionByRange(n, *[F.col(c).asc_nulls_first() for c in [*by, *order]])
    return materialize(laid.withColumn(name, F.spark_partition_id()))


def _joined(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on ``keys`` that also matches null with null; a null time is a bucket of its own, before all others."""
    right = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    return left.join(right, same).drop(*[f"__r_{k}" for k in keys])


def running_sums(df: DataFrame, by: Sequence[str], bucket: Column, order: Sequence[str],
                 sums: dict[str, Column]) -> DataFrame:
    """``df`` plus, for every entry of ``sums``, the running total up to and including the row.

    ``bucket`` is a coarse, order-preserving function of the position: the range of ``ranged``, or a month. Rows are
    summed inside (key, bucket); what the earlier buckets add comes from one row per (key, bucket). Totals of decimal
    columns are exact, whatever the split.
    """
    zero = F.lit(0)
    by = list(by)
    work = df.withColumn("__bucket", bucket)
    for name, value in sums.items():
        work = work.withColumn(f"__x_{name}", value)
    part = [*by, "__bucket"]
    totals = work.groupBy(*part).agg(*[F.sum(f"__x_{n}").alias(f"__t_{n}") for n in sums])
    before = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(*part, *[F.coalesce(F.sum(f"__t_{n}").over(before), zero).alias(f"__b_{n}")
                                   for n in sums])
    inside = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        work.select("*", *[F.sum(f"__x_{n}").over(inside).alias(f"__i_{n}") for n in sums])
        .transform(_joined, bases, part)
        .select(*df.columns, *[(F.col(f"__b_{n}") + F.coalesce(F.col(f"__i_{n}"), zero)).alias(n) for n in sums])
    )


def reflected_position(df: DataFrame, by: Sequence[str], bucket: Column, order: Sequence[str], change: Column,
                       out: str, kind: str = "double") -> DataFrame:
    """Running holding that never falls below zero: h = max(h_before + change, 0).

    With X the plain running sum this is X minus the lowest value X has reached so far (or zero), so the recurrence
    becomes a running sum and a running minimum, both split into buckets.
    """
    by = list(by)
    part = [*by, "__bucket"]
    zero = F.lit(0).cast(kind)
    work = df.withColumn("__bucket", bucket).withColumn("__x", change.cast(kind))
    inside = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    work = work.withColumn("__i", F.sum("__x").over(inside)).withColumn("__low", F.min("__i").over(inside))
    buckets = work.groupBy(*part).agg(F.sum("__x").alias("__t"), F.min("__i").alias("__bmin"))
    before = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        buckets.withColumn("__base", F.coalesce(F.sum("__t").over(before), zero))
        .withColumn("__reached", F.coalesce(F.min(F.col("__base") + F.col("__bmin")).over(before), zero))
        .select(*part, "__base", "__reached")
    )
    x = F.col("__base") + F.col("__i")
    lowest = F.least(zero, F.col("__reached"), F.col("__base") + F.col("__low"))
    return _joined(work, bases, part).select(*df.columns, (x - lowest).alias(out))


def linear_scan(df: DataFrame, by: Sequence[str], bucket: Column, order: Sequence[str], keep: str, add: str,
                out: str, block: int = 256) -> DataFrame:
    """Running value of y = keep * y_before + add, starting at zero, over groups of any size.

    Steps compose: two of them are again one (keep, add) pair. Rows are folded inside blocks of at most ``block``
    rows, blocks inside their bucket, buckets inside their key, so every fold works on a short array.
    """
    by = list(by)
    part = [*by, "__bucket"]
    numbered = df.withColumn("__bucket", bucket).withColumn(
        "__pos", F.row_number().over(Window.partitionBy(*part).orderBy(*order)))
    blocks = numbered.withColumn("__block", F.floor((F.col("__pos") - 1) / block)).groupBy(*part, "__block").agg(
        F.array_sort(F.collect_list(F.struct("__pos", F.col(keep).alias("k"), F.col(add).alias("a"),
                                             F.struct(*df.columns).alias("row")))).alias("__rows"))
    step = "named_struct('k', x.k * s.k, 'a', x.k * s.a + x.a)"
    unit = "named_struct('k', 1.0D, 'a', 0.0D)"
    fold = f"aggregate({{}}, {unit}, (s, x) -> {step})"
    blocks = materialize(blocks.withColumn("__f", F.expr(fold.format("__rows"))))  # three plans read it

    def carry_in(items: DataFrame, over_cols: list[str], index: str, value: str) -> DataFrame:
        packed = items.groupBy(*over_cols).agg(
            F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), F.col(f"{value}.k").alias("k"),
                                                 F.col(f"{value}.a").alias("a")))).alias("xs"))
        run = (f"aggregate(xs, named_struct('k', 1.0D, 'a', 0.0D, 'o', cast(array() as array<struct<k:double,a:double>>)),"
               f" (s, x) -> named_struct('k', x.k * s.k, 'a', x.k * s.a + x.a,"
               f" 'o', array_append(s.o, named_struct('k', s.k, 'a', s.a)))).o")
        return (packed.withColumn("o", F.expr(run))
                .select(*over_cols, F.explode(F.arrays_zip("xs", "o")).alias("z"))
                .select(*over_cols, F.col("z.xs.i").alias(index), F.col("z.o").alias("__in")))

    block_in = carry_in(blocks.select(*part, "__block", "__f"), part, "__block", "__f")
    per_bucket = (blocks.groupBy(*part)
                  .agg(F.array_sort(F.collect_list(F.struct("__block", F.col("__f.k").alias("k"),
                                                            F.col("__f.a").alias("a")))).alias("__fs"))
                  .withColumn("__g", F.expr(fold.format("__fs"))))
    bucket_in = carry_in(per_bucket.select(*part, "__g"), by, "__bucket", "__g")
    start = (
        _joined(block_in.withColumnRenamed("__in", "__bin"), bucket_in.withColumnRenamed("__in", "__kin"), part)
        .select(*part, "__block", (F.col("__bin.k") * F.col("__kin.a") + F.col("__bin.a")).alias("__y0"))
    )
    run = ("aggregate(__rows, named_struct('y', __y0, 'o', cast(array() as array<double>)),"
           " (s, x) -> named_struct('y', x.k * s.y + x.a, 'o', array_append(s.o, x.k * s.y + x.a))).o")
    return (
        _joined(blocks, start, [*part, "__block"])
        .withColumn("__o", F.expr(run))
        .select(F.explode(F.arrays_zip("__rows", "__o")).alias("z"))
        .select("z.__rows.row.*", F.col("z.__o").alias(out))
    )
