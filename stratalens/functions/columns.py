"""Column expressions shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C


def to_number(c: Column) -> Column:
    """Text or number to double; anything that is not a number becomes NULL."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x), x)


def to_day(c: Column) -> Column:
    """Text or timestamp to date; failures become NULL."""
    return c.try_cast("date")


def ratio(a: Column, b: Column) -> Column:
    """a / (b + eps)."""
    return F.try_divide(a, b + F.lit(C.EPS))


def clip(c: Column, low: Column, high: Column) -> Column:
    """Clip to [low, high]; NULL stays NULL, a NULL bound does not clip."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, low), high))


def finite(c: Column) -> Column:
    """NULL instead of NaN and of either infinity."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def any_word(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.lower(c).contains(w) for w in words])


def fiscal_period(c: Column) -> Column:
    """Q1 to Q4 from ``1``, ``Q1`` or ``1Q`` in any case; everything else upper-cased and trimmed."""
    text = F.trim(F.upper(c.cast("string")))
    return F.when(text.rlike("^[1-4]Q?$"), F.concat(F.lit("Q"), F.left(text, F.lit(1)))).otherwise(text)


def is_common_stock(c: Column) -> Column:
    """Security type names a common stock and none of the excluded kinds; NULL is not a stock."""
    return F.coalesce(~any_word(c, C.EXCLUDED_TYPE_WORDS) & any_word(c, C.COMMON_STOCK_WORDS), F.lit(False))


def is_domestic_ticker(c: Column) -> Column:
    """At least two characters, and not five or more ending in F or Y."""
    return F.coalesce((F.length(c) >= 2) & ~c.rlike("^.{4,}[FY]$"), F.lit(False))


def is_financial(sector: Column, industry: Column) -> Column:
    """Sector code or name, or a word of the industry, says financial."""
    return (F.coalesce(any_word(sector, C.FINANCIAL_SECTOR_WORDS), F.lit(False))
            | F.coalesce(any_word(industry, C.FINANCIAL_INDUSTRY_WORDS), F.lit(False)))


def fiscal_year_of(d: Column) -> Column:
    return F.year(d)


def fiscal_quarter_of(d: Column) -> Column:
    return F.concat(F.lit("Q"), F.quarter(d).cast("string"))


def cap_bucket(cap: Column, scale: Column | None = None) -> Column:
    """Size bucket of a market cap against the bounds, scaled if given; NULL stays NULL."""
    factor = F.lit(1.0) if scale is None else scale
    out = F.when(cap.isNull() | factor.isNull(), F.lit(None).cast("string"))
    for name, bound in C.CAP_BOUNDS.items():
        out = out.when(cap < F.lit(bound) * factor, F.lit(name))
    return out.otherwise(F.lit(C.CAP_TOP))


def caps_from(minimum: str) -> list[str]:
    """Buckets at or above ``minimum``; an unknown name keeps all."""
    return C.CAP_ORDER[C.CAP_ORDER.index(minimum):] if minimum in C.CAP_ORDER else list(C.CAP_ORDER)


def outcome_date(d: Column, months: int, lag_days: int = 0, snap: bool = True) -> Column:
    """Date at which a forward return is known; snapped to the month end unless told otherwise."""
    moved = F.add_months(d, months)
    if snap:
        moved = F.last_day(moved)
    return F.date_add(moved, lag_days) if lag_days else moved


def commission(quantity: Column, price: Column, pricing: str = "tiered", exchange: bool = True,
               removing: bool = True) -> Column:
    """Per-share commission within its floor and cap plus the exchange part, never negative."""
    f = C.FEES[pricing]
    base = F.least(F.greatest(quantity * F.lit(f["per_share"]), F.lit(f["minimum"])),
                   quantity * price * F.lit(f["max_share"]))
    venue = quantity * F.lit(f["remove"] if removing else f["add"]) if exchange else F.lit(0.0)
    return F.when((quantity > 0) & (price > 0), F.greatest(base + venue, F.lit(0.0))).otherwise(F.lit(0.0))


def commission_parts(quantity: Column, price: Column, pricing: str = "tiered", removing: bool = True) -> Column:
    """Struct of base, exchange and regulatory parts, their total and its share of the trade value in percent."""
    f = C.FEES[pricing]
    valid = (quantity > 0) & (price > 0)
    value = quantity * price
    base = F.least(F.greatest(quantity * F.lit(f["per_share"]), F.lit(f["minimum"])), value * F.lit(f["max_share"]))
    venue = quantity * F.lit(f["remove"] if removing else f["add"])
    levy = value * F.lit(C.SEC_RATE) + F.least(quantity * F.lit(C.TAF_PER_SHARE), F.lit(C.TAF_MAX))
    total = F.greatest(base + venue + levy, F.lit(0.0))

    def part(c: Column, name: str) -> Column:
        return F.when(valid, c).otherwise(F.lit(0.0)).alias(name)

    return F.struct(part(base, "base_fee"), part(venue, "exchange_fee"), part(levy, "regulatory_fee"),
                    part(total, "total_fee"), part(F.try_divide(total * 100, value), "fee_pct"))


def cgt_payment_due(sale_day: Column) -> Column:
    """Instalment date: 15 December for January to September, 31 January of the next year afterwards."""
    y = F.year(sale_day)
    return F.when(F.month(sale_day) <= 9, F.make_date(y, F.lit(12), F.lit(15))).otherwise(
        F.make_date(y + 1, F.lit(1), F.lit(31)))
