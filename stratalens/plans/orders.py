"""Positions marked to market, rebalance orders, and cost totals, for all accounts in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import commission


def mark_to_market(positions: DataFrame, prices: DataFrame) -> DataFrame:
    """Market value and unrealised profit per position; a position without a price keeps its last one, if any."""
    known = F.coalesce("__p", F.col("current_price")) if "current_price" in positions.columns else F.col("__p")
    value = F.col("shares") * F.col("current_price")
    pnl = value - F.col("total_cost")
    joined = positions.join(prices.select("symbol", F.col("price").alias("__p")), "symbol", "left").withColumn("current_price", known).drop("__p")
    return joined.withColumn("market_value", value).withColumn("unrealized_pnl", pnl).withColumn(
        "unrealized_pnl_pct", F.when(F.col("total_cost") > 0, pnl / F.col("total_cost") * 100).otherwise(F.lit(0.0)))


def portfolio_summary(marked: DataFrame, cash: DataFrame | None = None) -> DataFrame:
    """Per account: invested, cash, total, cost, profit, number of positions, largest and smallest."""
    a = marked.groupBy("account").agg(
        F.sum("market_value").alias("invested"), F.sum("total_cost").alias("total_cost"), F.count("*").alias("n_positions"),
        F.sum("unrealized_pnl").alias("unrealized_pnl"), F.max("market_value").alias("largest_position"), F.min("market_value").alias("smallest_position"))
    if cash is not None:
        a = a.join(cash, "account", "full")
    else:
        a = a.withColumn("cash", F.lit(0.0))
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return a.select("account", (z("invested") + z("cash")).alias("total_value"), z("cash").alias("cash"), z("invested").alias("invested"),
                    z("total_cost").alias("total_cost"), F.coalesce("n_positions", F.lit(0)).alias("n_positions"), z("unrealized_pnl").alias("unrealized_pnl"),
                    F.when(z("total_cost") > 0, F.col("unrealized_pnl") / F.col("total_cost") * 100).otherwise(F.lit(0.0)).alias("unrealized_pnl_pct"),
                    z("largest_position").alias("largest_position"), z("smallest_position").alias("smallest_position"))


def sector_allocation(marked: DataFrame) -> DataFrame:
    """Percent of an account's market value per sector; accounts worth nothing have no rows."""
    sector = F.coalesce(F.when(F.col("sector") != "", F.col("sector")), F.lit("Unknown"))
    s = marked.groupBy("account", sector.alias("sector")).agg(F.sum("market_value").alias("value"))
    total = F.sum("value").over(Window.partitionBy("account"))
    return s.select("account", "sector", F.try_divide(F.col("value") * 100, total).alias("allocation_pct")).where(F.col("allocation_pct").isNotNull())


def resolve_prices(symbols: DataFrame, feed: DataFrame, panel: DataFrame, default: float = 100.0) -> DataFrame:
    """Price per symbol from the feed, else from the panel, else a default."""
    return (symbols.join(feed.select("symbol", F.col("price").alias("__feed")), "symbol", "left")
            .join(panel.select("symbol", F.col("price").alias("__panel")), "symbol", "left")
            .select("symbol", F.coalesce("__feed", "__panel", F.lit(default)).alias("price"),
                    F.when(F.col("__feed").isNotNull(), "feed").when(F.col("__panel").isNotNull(), "panel").otherwise("default").alias("price_source")))


def _priced(df: DataFrame, prices: DataFrame) -> DataFrame:
    return df.join(prices.select("symbol", F.col("price").alias("__price")), "symbol", "left").withColumn(
        "price", F.coalesce("__price", F.lit(0.0))).drop("__price")


def _order_columns(action: Column, quantity: Column, reason: Column, pricing: str) -> list[Column]:
    price = F.col("price")
    fee = commission(quantity, price, pricing)
    value = quantity * price
    return [action.alias("action"), quantity.alias("quantity"), price, value.alias("value"), fee.alias("fee"), reason.alias("reason"),
            F.when(action == "SELL", value - fee).otherwise(-(value + fee)).alias("net_value")]


def rebalance_orders(current: DataFrame, targets: DataFrame, accounts: DataFrame, prices: DataFrame, min_value: float = 100.0,
                     pricing: str = "tiered") -> DataFrame:
    """Orders from holdings (account, symbol, shares) to equal-weight targets (account, symbol, predicted_rank, sector).

    Holdings outside the targets are sold in full; targets move to value / number of targets, in shares of four
    decimals; targets without a price and trades below ``min_value`` are left out.
    """
    size = targets.groupBy("account").agg(F.count("*").alias("__n"))
    weights = accounts.join(size, "account").select("account", (F.col("account_value") / F.col("__n")).alias("__each"))
    wanted = targets.join(weights, "account", "left").withColumn("__target", F.lit(True))
    both = _priced(current.join(wanted, ["account", "symbol"], "full"), prices)
    held = F.coalesce("shares", F.lit(0.0))
    is_target = F.coalesce("__target", F.lit(False))
    goal = F.when(is_target & (F.col("price") > 0), F.bround(F.coalesce("__each", F.lit(0.0)) / F.col("price"), 4)).otherwise(F.lit(0.0))
    rows = both.select("account", "symbol", "price", held.alias("current_shares"), goal.alias("target_shares"), is_target.alias("is_target"),
                       F.coalesce("predicted_rank", F.lit(0.0)).alias("predicted_rank"), F.coalesce("sector", F.lit("")).alias("sector"))
    diff = F.col("target_shares") - F.col("current_shares")
    exits = ~F.col("is_target") & (F.col("current_shares") > 0)
    moves = F.col("is_target") & (F.col("price") > 0) & (diff != 0) & (F.abs(diff) * F.col("price") >= min_value)
    action = F.when(exits | (diff < 0), "SELL").otherwise("BUY")
    quantity = F.when(exits, F.col("current_shares")).otherwise(F.abs(diff))
    reason = F.when(exits, "exit").when(F.col("current_shares") == 0, "new").when(diff > 0, "rebalance buy").otherwise("rebalance sell")
    return rows.where(exits | moves).select(
        "account", "symbol", *_order_columns(action, quantity, reason, pricing), "current_shares", "target_shares", "sector", "predicted_rank")


def exits(current: DataFrame, targets: DataFrame) -> DataFrame:
    """Held symbols outside the targets."""
    return current.where(F.col("shares") > 0).join(targets.select("account", "symbol"), ["account", "symbol"], "left_anti")


def initial_orders(targets: DataFrame, accounts: DataFrame, prices: DataFrame, reserve: float = 0.02, pricing: str = "tiered") -> DataFrame:
    """First purchases: equal parts of the value less a reserve; targets without a price or worth under 1 are left out."""
    size = targets.groupBy("account").agg(F.count("*").alias("__n"))
    each = accounts.join(size, "account").select("account", (F.col("account_value") * (1 - reserve) / F.col("__n")).alias("__each"))
    rows = _priced(targets.join(each, "account"), prices).where(F.col("price") > 0)
    quantity = F.bround(F.col("__each") / F.col("price"), 4)
    return rows.where(quantity * F.col("price") >= 1.0).select(
        "account", "symbol", *_order_columns(F.lit("BUY"), quantity, F.lit("initial"), pricing), F.lit(0.0).alias("current_shares"),
        quantity.alias("target_shares"), "sector", "predicted_rank")


def sorted_orders(orders: DataFrame) -> DataFrame:
    """Sells first, then by rank; a range sort over all accounts."""
    return orders.orderBy("account", F.col("action").desc(), F.col("predicted_rank").desc(), "symbol")


def order_costs(orders: DataFrame) -> DataFrame:
    buy, sell = F.col("action") == "BUY", F.col("action") == "SELL"
    z = lambda c: F.coalesce(c, F.lit(0.0))
    a = orders.groupBy("account").agg(
        F.sum("fee").alias("total_fees"), z(F.sum(F.when(buy, F.col("value")))).alias("total_buys"),
        z(F.sum(F.when(sell, F.col("value")))).alias("total_sells"), F.count_if(buy).alias("n_buys"), F.count_if(sell).alias("n_sells"))
    return a.withColumn("net_cash_flow", F.col("total_sells") - F.col("total_buys") - F.col("total_fees"))


def rebalance_cost(trades: DataFrame, pricing: str = "tiered", removing: bool = True) -> DataFrame:
    """Per account over (shares, price) trades of either sign: fees, traded value, count, mean fee, fee share."""
    q = F.abs("shares")
    rows = trades.where(F.col("shares") != 0).select("account", commission(q, F.col("price"), pricing, removing=removing).alias("f"),
                                                     (q * F.col("price")).alias("v"))
    a = rows.groupBy("account").agg(F.sum("f").alias("total_fees"), F.sum("v").alias("total_traded_value"), F.count("*").alias("trade_count"))
    return a.select("*", (F.col("total_fees") / F.col("trade_count")).alias("avg_fee_per_trade"),
                    F.when(F.col("total_traded_value") > 0, F.col("total_fees") / F.col("total_traded_value") * 100).otherwise(F.lit(0.0)).alias("fee_as_pct"))


def execution_summary(fills: DataFrame) -> DataFrame:
    """Per account: orders, filled, rejected, value, fees, buy and sell value of the fills."""
    filled = F.col("status") == "filled"
    value = F.col("quantity") * F.col("fill_price")
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return fills.groupBy("account").agg(
        F.count("*").alias("total_orders"), F.count_if(filled).alias("filled"), F.count_if(F.col("status") == "rejected").alias("rejected"),
        z(F.sum(F.when(filled, value))).alias("total_value"), z(F.sum(F.when(filled, F.col("fee")))).alias("total_fees"),
        z(F.sum(F.when(filled & (F.col("action") == "BUY"), value))).alias("buy_value"),
        z(F.sum(F.when(filled & (F.col("action") == "SELL"), value))).alias("sell_value"))
