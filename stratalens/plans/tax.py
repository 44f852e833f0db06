"""Capital-gains and dividend summaries per account and year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.columns import cgt_payment_due


def cgt_summary(disposals: DataFrame, rate: float = C.CGT_RATE, exemption: float = C.CGT_EXEMPTION) -> DataFrame:
    """Per (account, year): proceeds, cost, gains, losses, net, taxable after the exemption, tax, exemption left."""
    gain = F.col("gain")
    a = disposals.groupBy("account", F.year("ts").alias("year")).agg(
        F.count("*").alias("n_disposals"), F.sum("proceeds").alias("total_proceeds"), F.sum("cost_basis").alias("total_cost_basis"),
        F.coalesce(F.sum(F.when(~F.col("is_loss"), gain)), F.lit(0.0)).alias("gross_gains"),
        F.coalesce(F.sum(F.when(F.col("is_loss"), -gain)), F.lit(0.0)).alias("gross_losses"))
    net = F.col("gross_gains") - F.col("gross_losses")
    taxable = F.greatest(net - exemption, F.lit(0.0))
    return a.select("*", net.alias("net_gain"), taxable.alias("taxable_gain"), (taxable * rate).alias("estimated_tax"),
                    (F.lit(float(exemption)) - F.least(F.lit(float(exemption)), F.greatest(net, F.lit(0.0)))).alias("remaining_exemption"))


def instalments(disposals: DataFrame) -> DataFrame:
    """Net gain per (account, payment date)."""
    return disposals.groupBy("account", cgt_payment_due(F.col("ts").cast("date")).alias("payment_due")).agg(
        F.count("*").alias("n_disposals"), F.sum("gain").alias("net_gain"))


def dividends(payments: DataFrame, rate: float = C.WITHHOLDING) -> DataFrame:
    """Gross, withheld and net per payment.

    Payments with ``gross`` and ``net`` come from a broker statement and give the rate; the others are shares times
    ``per_share`` at the payment's own ``rate`` if it has one, else at ``rate``.
    """
    c = F.col
    broker = c("gross").isNotNull() & c("net").isNotNull()
    own = F.coalesce(c("rate"), F.lit(rate)) if "rate" in payments.columns else F.lit(float(rate))
    gross = F.when(broker, c("gross")).otherwise(c("shares") * c("per_share"))
    withheld = F.when(broker, c("gross") - c("net")).otherwise(gross * own)
    kept = [x for x in payments.columns if x not in ("gross", "net", "rate", "shares", "per_share")]
    return payments.select(
        *kept, F.when(broker, F.lit(0.0)).otherwise(c("shares").cast("double")).alias("shares"), gross.alias("gross_amount"),
        F.when(broker, F.when(c("gross") > 0, withheld / c("gross")).otherwise(F.lit(0.0))).otherwise(own).alias("withholding_rate"),
        withheld.alias("withholding_amount"), (gross - withheld).alias("net_amount"))


def dividend_summary(records: DataFrame, by_symbol: bool = False) -> DataFrame:
    """Per (account, year) or also per symbol: payments, gross, withheld, net."""
    keys = ["account", F.year("payment_date").alias("year"), *(["symbol"] if by_symbol else [])]
    return records.groupBy(*keys).agg(F.count("*").alias("n_payments"), F.sum("gross_amount").alias("total_gross"),
                                      F.sum("withholding_amount").alias("total_withholding"), F.sum("net_amount").alias("total_net"))


def dividend_history(records: DataFrame, symbol: str) -> DataFrame:
    return records.where(F.col("symbol") == symbol)


def expected_dividends(holdings: DataFrame, yields: DataFrame, prices: DataFrame, rate: float = C.WITHHOLDING) -> DataFrame:
    """Annual dividends per holding that has both a yield and a price."""
    gross = F.col("shares") * F.col("price") * F.col("dividend_yield")
    return holdings.join(yields, "symbol").join(prices, "symbol").select(
        "account", "symbol", "shares", "price", (F.col("dividend_yield") * 100).alias("yield_pct"), gross.alias("annual_gross"),
        (gross * rate).alias("annual_withholding"), (gross * (1 - rate)).alias("annual_net"))


def expected_totals(expected: DataFrame) -> DataFrame:
    return expected.groupBy("account").agg(F.sum("annual_gross").alias("total_gross"), F.sum("annual_withholding").alias("total_withholding"),
                                           F.sum("annual_net").alias("total_net"))


def annual_report(cgt: DataFrame, div: DataFrame) -> DataFrame:
    """Capital gains and dividends of a year side by side, with filing dates; either may be missing."""
    next_year = F.col("year") + 1

    def day(m: int, d: int, y: Column) -> Column:
        return F.make_date(y, F.lit(m), F.lit(d))

    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    return cgt.join(div, ["account", "year"], "full").select(
        "account", "year", F.coalesce("n_disposals", F.lit(0)).alias("n_disposals"), zero("net_gain"), zero("taxable_gain"), zero("estimated_tax"),
        F.coalesce("n_payments", F.lit(0)).alias("n_payments"), zero("total_gross"), zero("total_withholding"), zero("total_net"),
        day(12, 15, F.col("year")).alias("first_instalment"), day(1, 31, next_year).alias("second_instalment"),
        day(10, 31, next_year).alias("preliminary_return"), day(11, 15, next_year).alias("final_return"))
