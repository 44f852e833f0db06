"""As-of joins as one union and one window: no range join, no pairs, one exchange on the key."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import ranged

_AT, _SIDE, _TIE, _BUCKET, _RIGHT, _LEFT = "__at", "__side", "__tie", "__bucket", "__right", "__is_left"


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_on: str,
    right_on: str,
    cols: Sequence[str],
    *,
    strict: bool = False,
    direction: str = "backward",
    ties: Sequence[str] = (),
    bucket: Callable[[Column], Column] | None = None,
    spread: bool = False,
) -> DataFrame:
    """All rows of ``left`` with ``cols`` of the closest ``right`` row of the same key.

    backward takes the last right row at or before the left one, forward the first at or after it; ``strict`` leaves
    equal positions out. Whole right rows are taken, so a NULL field of the matched row stays NULL. Among right rows
    at one position the last by ``ties`` wins.

    Without ``bucket`` a key is sorted by one task, which suits tables with at most a row per key and calendar period.
    With ``bucket``, a coarse function of the position such as its month, a key is spread over its buckets: the last
    right row before each bucket is found on one row per (key, bucket), enters the bucket as its first row, and the
    window then runs per (key, bucket). A key that holds a large share of all rows is thus never one task.

    With ``spread`` the buckets are ranges of (key, position) with about equal row counts over both tables, whatever
    the positions mean; the rows are stored in that layout once. Only rows at one position must meet.
    """
    forward = direction == "forward"
    ordered = (lambda c: F.col(c).desc_nulls_first()) if forward else (lambda c: F.col(c).asc_nulls_first())
    payload = F.struct(*cols)
    tie = F.struct(*ties) if ties else F.lit(0)
    keys = [F.col(k) for k in by]
    r = right.where(F.col(right_on).isNotNull()).select(
        *keys, F.col(right_on).alias(_AT), F.lit(1 if strict else 0).alias(_SIDE), tie.alias(_TIE),
        payload.alias(_RIGHT))
    rest = [c for c in left.columns if c not in by]
    lf = left.select(*keys, *rest, F.col(left_on).alias(_AT), F.lit(0 if strict else 1).alias(_SIDE),
                     F.lit(True).alias(_LEFT))
    part = list(by)
    rows = [lf, r]
    if bucket is not None or spread:
        part = [*by, _BUCKET]
        if spread:
            laid = ranged(lf.unionByName(r, allowMissingColumns=True), by, [_AT], _BUCKET)
            lf, r = laid.where(F.col(_LEFT)).drop(_TIE, _RIGHT), laid.where(F.col(_LEFT).isNull()).select(*r.columns, _BUCKET)
        else:
            lf = lf.withColumn(_BUCKET, bucket(F.col(_AT)))
            r = r.withColumn(_BUCKET, bucket(F.col(_AT)))
        pick = F.min_by if forward else F.max_by
        order = F.struct(_AT, F.col(_TIE)) if not (forward and ties) else F.struct(_AT)
        heads = r.groupBy(*part).agg(pick(_RIGHT, order).alias(_RIGHT))
        wanted = lf.select(*part).distinct()
        over = Window.partitionBy(*by).orderBy(ordered(_BUCKET)).rowsBetween(Window.unboundedPreceding, -1)
        carried = (
            wanted.unionByName(heads, allowMissingColumns=True)
            .groupBy(*part).agg(F.first(_RIGHT, ignorenulls=True).alias(_RIGHT))
            .withColumn(_RIGHT, F.last(_RIGHT, ignorenulls=True).over(over))
            .where(F.col(_RIGHT).isNotNull())
            .withColumn(_SIDE, F.lit(-1))
        )
        rows = [lf, r, carried]
    u = rows[0]
    for other in rows[1:]:
        u = u.unionByName(other, allowMissingColumns=True)
    over = (Window.partitionBy(*part).orderBy(ordered(_AT), F.col(_SIDE), F.col(_TIE))
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = F.when(F.col(_AT).isNotNull(), F.last(_RIGHT, ignorenulls=True).over(over))
    return (
        u.withColumn(_RIGHT, found)
        .where(F.col(_LEFT))
        .select(*left.columns, *[F.col(f"{_RIGHT}.{c}").alias(c) for c in cols])
    )


def asof_nearest(left: DataFrame, right: DataFrame, by: Sequence[str], left_on: str, right_on: str,
                 cols: Sequence[str], bucket: Callable[[Column], Column] | None = None) -> DataFrame:
    """Closest right row by day distance on either side; at equal distance the later one."""
    at = "__right_at"
    source = right.withColumn(at, F.col(right_on))
    names = [at, *cols]
    back = {c: f"__b_{c}" for c in names}
    ahead = {c: f"__f_{c}" for c in names}
    kept = [*by, right_on]
    b = asof_join(left, source.select(*kept, *[F.col(c).alias(n) for c, n in back.items()]), by, left_on, right_on,
                  list(back.values()), bucket=bucket)
    f = asof_join(b, source.select(*kept, *[F.col(c).alias(n) for c, n in ahead.items()]), by, left_on, right_on,
                  list(ahead.values()), bucket=bucket, direction="forward")
    gap_back = F.datediff(F.col(left_on), F.col(back[at]))
    gap_ahead = F.datediff(F.col(ahead[at]), F.col(left_on))
    earlier = F.col(ahead[at]).isNull() | (gap_back < gap_ahead)
    return f.select(*left.columns,
                    *[F.when(earlier, F.col(back[c])).otherwise(F.col(ahead[c])).alias(c) for c in cols])
