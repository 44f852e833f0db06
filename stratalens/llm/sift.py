"""A filter of fixed size that keeps most rows out of a join."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PART = 1 << 15  # bits in one of Spark's bitmaps


def bitmap(keys: DataFrame, column: str, bits: int) -> bytes:
    """The lowest ``bits`` bits of a long column as a bitmap of ``2 ** bits`` bits, put together by Spark in parts of 4 KB."""
    low = F.col(column).bitwiseAND((1 << bits) - 1)
    rows = keys.select(F.floor(low / _PART).alias("part"), (low % _PART).cast("long").alias("bit")).distinct().groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    out = bytearray((1 << bits) // 8)
    for row in rows:
        out[row.part * _PART // 8 : (row.part + 1) * _PART // 8] = row.bits
    return bytes(out)


def held(table: bytes, keys: np.ndarray) -> np.ndarray:
    """Which of the 64-bit ``keys`` a bitmap has; it also says so of some others."""
    bit = keys.view(np.uint64) & np.uint64(8 * len(table) - 1)
    return (np.frombuffer(table, np.uint8)[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1


def probably_in(keys: DataFrame, column: str, bits: int = 23) -> Callable[[Column], Column]:
    """A test of long columns that holds for every key in ``keys``, and for few others while those are few.

    The bitmap has 1 MB whatever the number of keys; with very many keys it lets more rows through, never fewer.
    """
    table = bitmap(keys, column, bits)

    @F.pandas_udf("boolean")
    def test(values: pd.Series) -> pd.Series:
        return pd.Series(held(table, values.to_numpy(np.int64)))

    return test
