"""Ledger, tax and order queries and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as C
from .. import fixtures as X
from ..fixtures import NUDGE, sig, sig_sql, with_sql
from ..functions.columns import commission, commission_parts
from ..plans import ledger as L
from ..plans import orders as O
from ..plans import tax as T
from .panel import rounded, rounded_sql

SALE = ["account", "symbol", "ts", "trade_id"]


def money(df, keys, doubles, digits=4):
    """Differences of near-equal sums are compared after rounding to cents' hundredths."""
    return df.select(*keys, *[sig(F.round(F.col(c) * NUDGE, digits)).alias(c) for c in doubles])


def money_sql(keys, doubles, digits=4):
    return ", ".join([*keys, *[f"{sig_sql(f'round({c} * CAST({NUDGE} AS DOUBLE), {digits})')} AS {c}" for c in doubles]])


# --- Spark sides ----------------------------------------------------------------------------------------------

def clean(spark, sf):
    return X.trades(spark, sf)


def lots(spark, sf):
    d = L.lots(clean(spark, sf))
    return d.select(*SALE, sig("unit_cost").alias("unit_cost"), F.col("lo").cast("double").alias("lo"), F.col("hi").cast("double").alias("hi"),
                    "lot_no", sig(F.round(F.col("cost_hi") * NUDGE, 2)).alias("cost_hi"))


DISPOSAL = ["proceeds", "cost_basis", "gain"]


def disposals(spark, sf):
    return money(L.disposals(clean(spark, sf)), [*SALE, "is_loss", "lots_used", "holding_days"], DISPOSAL, 2)


def matches(spark, sf):
    return money(L.lot_matches(clean(spark, sf)), ["account", "symbol", "sale_id", "lot_id", "sale_ts", "lot_ts"], ["shares", "cost"], 2)


def oversold(spark, sf):
    return L.oversold_keys(X.trades(spark, sf, False))


def rejected(spark, sf):
    return L.mark_rejected(X.trades(spark, sf, False)).select(*SALE, "rejected")


def open_lots(spark, sf):
    return money(L.open_lots(clean(spark, sf)), SALE, ["remaining", "remaining_cost"], 2)


def marks(spark, sf):
    """One price per symbol: the mean trade price."""
    return clean(spark, sf).groupBy("symbol").agg(F.round(F.avg("price"), 6).alias("price"))


def summary(spark, sf):
    return money(L.holdings_summary(clean(spark, sf), marks(spark, sf)), ["account", "symbol", "n_lots"],
                 ["shares", "cost_basis", "avg_cost", "unrealized_gain"], 2)


WHAT_IF = ["shares", "price", "proceeds", "cost_basis", "gain", "exemption_used", "taxable_gain", "estimated_tax", "effective_rate"]


def what_if(spark, sf):
    t = clean(spark, sf)
    wanted = t.groupBy("account", "symbol").agg(F.round(F.avg("price") * 1.1, 6).alias("price"),
                                                (F.count("*") * 2.0).alias("shares"))
    return money(L.what_if(t, wanted, C.CGT_RATE, C.CGT_EXEMPTION), ["account", "symbol"], WHAT_IF, 2)


def running(spark, sf):
    return money(L.running_positions(X.trades(spark, sf, False)), SALE, ["shares", "avg_cost", "total_cost"], 4)


def final_positions(spark, sf):
    return money(L.positions(X.trades(spark, sf, False)), ["account", "symbol"], ["shares", "avg_cost", "total_cost"], 4)


CGT = ["total_proceeds", "total_cost_basis", "gross_gains", "gross_losses", "net_gain", "taxable_gain", "estimated_tax", "remaining_exemption"]


def by_symbol_account(d):
    """Small ledgers: every symbol of an account is its own account, so that the exemption matters."""
    return d.withColumn("account", F.concat_ws("/", "account", "symbol"))


def cgt(spark, sf):
    return money(T.cgt_summary(by_symbol_account(L.disposals(clean(spark, sf)))), ["account", "year", "n_disposals"], CGT, 2)


def instalments(spark, sf):
    return money(T.instalments(L.disposals(clean(spark, sf))), ["account", "payment_due", "n_disposals"], ["net_gain"], 2)


def dividends(spark, sf):
    d = T.dividends(X.payments(spark, sf)).groupBy("account", "symbol", "payment_date").agg(
        *[F.sum(c).alias(c) for c in ("shares", "gross_amount", "withholding_rate", "withholding_amount", "net_amount")])
    return rounded(d, ["account", "symbol", "payment_date"], ["shares", "gross_amount", "withholding_rate", "withholding_amount", "net_amount"])


DIV = ["total_gross", "total_withholding", "total_net"]


def dividend_totals(spark, sf, by_symbol=False):
    d = T.dividend_summary(T.dividends(X.payments(spark, sf)), by_symbol)
    return rounded(d, ["account", "year", *(["symbol"] if by_symbol else []), "n_payments"], DIV)


def history(spark, sf):
    d = T.dividend_history(T.dividends(X.payments(spark, sf)), "C42")
    return rounded(d, ["account", "symbol", "payment_date"], ["gross_amount", "net_amount"])


def yields(spark, sf):
    return X.read(spark, sf, "part").where(F.col("p_partkey") % 3 == 0).select(
        F.concat(F.lit("P"), "p_partkey").alias("symbol"), (F.col("p_size") / 1000.0).alias("dividend_yield"))


def expected(spark, sf):
    d = T.expected_dividends(X.holdings(spark, sf), yields(spark, sf), X.part_prices(spark, sf).select("symbol", "price"))
    return rounded(d, ["account", "symbol"], ["shares", "price", "yield_pct", "annual_gross", "annual_withholding", "annual_net"])


def expected_totals(spark, sf):
    d = T.expected_dividends(X.holdings(spark, sf), yields(spark, sf), X.part_prices(spark, sf).select("symbol", "price"))
    return rounded(T.expected_totals(d), ["account"], DIV)


def annual(spark, sf):
    c = T.cgt_summary(L.disposals(clean(spark, sf)))
    d = T.dividend_summary(T.dividends(X.payments(spark, sf)))
    return money(T.annual_report(c, d), ["account", "year", "n_disposals", "n_payments", "first_instalment", "second_instalment",
                                         "preliminary_return", "final_return"], ["net_gain", "taxable_gain", "estimated_tax", *DIV], 2)


def fees(spark, sf):
    q, p = F.col("quantity"), F.col("price")
    return clean(spark, sf).select(*SALE, sig(commission(q, p)).alias("tiered"), sig(commission(q, p, "fixed")).alias("fixed"),
                                   sig(commission(q, p, exchange=False)).alias("no_exchange"), sig(commission(q, p, removing=False)).alias("adding"))


def fee_parts(spark, sf):
    d = clean(spark, sf).select(*SALE, commission_parts(F.col("quantity"), F.col("price")).alias("p")).select(*SALE, "p.*")
    return rounded(d, SALE, ["base_fee", "exchange_fee", "regulatory_fee", "total_fee", "fee_pct"])


def costs_of_trades(spark, sf):
    signed = F.when(F.col("side") == "BUY", F.col("quantity")).otherwise(-F.col("quantity"))
    d = O.rebalance_cost(clean(spark, sf).select("account", signed.alias("shares"), "price"))
    return rounded(d, ["account", "trade_count"], ["total_fees", "total_traded_value", "avg_fee_per_trade", "fee_as_pct"])


def marked(spark, sf):
    """Holdings bought at nine tenths of the price, marked at the price."""
    p = X.part_prices(spark, sf)
    h = X.holdings(spark, sf).join(p, "symbol").select("account", "symbol", "shares", "sector", (F.col("shares") * F.col("price") * 0.9 + 10).alias("total_cost"))
    return O.mark_to_market(h, p)


def positions_marked(spark, sf):
    return rounded(marked(spark, sf), ["account", "symbol"], ["shares", "total_cost", "current_price", "market_value", "unrealized_pnl", "unrealized_pnl_pct"])


PORTFOLIO = ["total_value", "cash", "invested", "total_cost", "unrealized_pnl", "unrealized_pnl_pct", "largest_position", "smallest_position"]


def portfolio(spark, sf):
    cash = X.accounts(spark, sf).select("account", (F.col("account_value") / 10).alias("cash"))
    return rounded(O.portfolio_summary(marked(spark, sf), cash), ["account", "n_positions"], PORTFOLIO)


def allocation(spark, sf):
    return rounded(O.sector_allocation(marked(spark, sf)), ["account", "sector"], ["allocation_pct"])


def resolved(spark, sf):
    p = X.part_prices(spark, sf)
    symbols = X.read(spark, sf, "part").select(F.concat(F.lit("P"), "p_partkey").alias("symbol"))
    feed = p.where(F.substring("symbol", -1, 1) != "3").select("symbol", F.col("price") + 1)
    return rounded(O.resolve_prices(symbols, feed.toDF("symbol", "price"), p), ["symbol", "price_source"], ["price"])


def rebalance(spark, sf):
    return O.rebalance_orders(X.holdings(spark, sf), X.targets(spark, sf), X.accounts(spark, sf), X.part_prices(spark, sf))


ORDER_NUMBERS = ["quantity", "price", "value", "fee", "net_value", "current_shares", "target_shares", "predicted_rank"]


def orders(spark, sf):
    return rounded(O.sorted_orders(rebalance(spark, sf)), ["account", "symbol", "action", "reason", "sector"], ORDER_NUMBERS)


def first_orders(spark, sf):
    d = O.initial_orders(X.targets(spark, sf), X.accounts(spark, sf), X.part_prices(spark, sf))
    return rounded(d, ["account", "symbol", "action"], ["quantity", "price", "value", "fee", "net_value"])


def order_costs(spark, sf):
    return rounded(O.order_costs(rebalance(spark, sf)), ["account", "n_buys", "n_sells"], ["total_fees", "total_buys", "total_sells", "net_cash_flow"])


def exits(spark, sf):
    return O.exits(X.holdings(spark, sf), X.targets(spark, sf)).select("account", "symbol", sig("shares").alias("shares"))


def executions(spark, sf):
    return rounded(O.execution_summary(X.fills(spark, sf)), ["account", "total_orders", "filled", "rejected"],
                   ["total_value", "total_fees", "buy_value", "sell_value"])


# --- oracle side ----------------------------------------------------------------------------------------------

W = "(PARTITION BY account, symbol ORDER BY ts, trade_id)"
FIFO = {
    "lot": f"""SELECT *, quantity * price + fee AS cost, (quantity * price + fee) / quantity AS unit_cost, sum(quantity) OVER w AS hi,
  sum(quantity) OVER w - quantity AS lo, sum(quantity * price + fee) OVER w AS cost_hi, row_number() OVER w AS lot_no
  FROM trades WHERE side = 'BUY' WINDOW w AS {W}""",
    "sale": f"SELECT *, sum(quantity) OVER w AS hi, sum(quantity) OVER w - quantity AS lo FROM trades WHERE side = 'SELL' WINDOW w AS {W}",
    "piece": """SELECT s.account, s.symbol, s.trade_id AS sale_id, s.ts AS sale_ts, l.trade_id AS lot_id, l.ts AS lot_ts,
  least(s.hi, l.hi) - greatest(s.lo, l.lo) AS shares, (least(s.hi, l.hi) - greatest(s.lo, l.lo)) * l.unit_cost AS cost
  FROM sale s JOIN lot l ON s.account = l.account AND s.symbol = l.symbol AND l.lo < s.hi AND s.lo < l.hi""",
    "disposal": """SELECT s.account, s.symbol, s.ts, s.trade_id, s.quantity * s.price - s.fee AS proceeds, c.cost_basis,
  s.quantity * s.price - s.fee - c.cost_basis AS gain, s.quantity * s.price - s.fee - c.cost_basis < 0 AS is_loss, c.lots_used,
  date_diff('day', c.oldest, s.ts)::INT AS holding_days FROM sale s JOIN (SELECT account, symbol, sale_id, sum(cost) AS cost_basis, count(*) AS lots_used,
  min(lot_ts) AS oldest FROM piece GROUP BY 1, 2, 3) c ON s.account = c.account AND s.symbol = c.symbol AND s.trade_id = c.sale_id""",
    "sold": "SELECT account, symbol, sum(CASE WHEN side = 'SELL' THEN quantity ELSE 0 END) AS sold, sum(CASE WHEN side = 'BUY' THEN quantity ELSE 0 END) AS bought FROM trades GROUP BY 1, 2",
    "open_lot": """SELECT l.account, l.symbol, l.ts, l.trade_id, least(hi - sold, quantity) AS remaining, least(hi - sold, quantity) * unit_cost AS remaining_cost
  FROM lot l JOIN sold s ON l.account = s.account AND l.symbol = s.symbol WHERE hi > sold""",
    "marks": "SELECT symbol, round(avg(price), 6) AS price FROM trades GROUP BY 1",
    "wanted": "SELECT account, symbol, round(avg(price) * 1.1, 6) AS price, count(*) * 2.0 AS shares FROM trades GROUP BY 1, 2",
    "guess": """SELECT w.account, w.symbol, w.shares, w.price, w.shares * w.price AS proceeds, sum(greatest(least(l.hi, s.sold + w.shares) - greatest(l.lo, s.sold), 0) * unit_cost) AS cost_basis
  FROM wanted w JOIN sold s ON w.account = s.account AND w.symbol = s.symbol JOIN lot l ON w.account = l.account AND w.symbol = l.symbol
  WHERE s.bought > s.sold GROUP BY 1, 2, 3, 4""",
}
LOT_NAMES = ["trades_raw", "trades", "lot"]
FIFO_NAMES = [*LOT_NAMES, "sale", "piece"]
DISPOSAL_NAMES = [*FIFO_NAMES, "disposal"]
OPEN_NAMES = [*LOT_NAMES, "sold", "open_lot"]
CGT_SQL = {
    "yearly_cgt": """SELECT *, greatest(net_gain - 1270, 0) AS taxable_gain, greatest(net_gain - 1270, 0) * 0.33 AS estimated_tax,
  1270 - least(1270, greatest(net_gain, 0)) AS remaining_exemption FROM (SELECT account, year(ts)::INT AS year, count(*) AS n_disposals, sum(proceeds) AS total_proceeds,
  sum(cost_basis) AS total_cost_basis, sum(CASE WHEN is_loss THEN 0 ELSE gain END) AS gross_gains, sum(CASE WHEN is_loss THEN -gain ELSE 0 END) AS gross_losses,
  sum(gain) AS net_gain FROM {0} GROUP BY 1, 2)""",
    "div": """SELECT account, symbol, payment_date, CASE WHEN gross IS NULL THEN shares ELSE 0 END::DOUBLE AS shares, coalesce(gross, shares * per_share) AS gross_amount,
  CASE WHEN gross IS NULL THEN 0.15 ELSE (gross - net) / gross END AS withholding_rate, CASE WHEN gross IS NULL THEN shares * per_share * 0.15 ELSE gross - net END AS withholding_amount,
  CASE WHEN gross IS NULL THEN shares * per_share * 0.85 ELSE net END AS net_amount FROM payments""",
    "div_year": """SELECT account, year(payment_date)::INT AS year, count(*) AS n_payments, sum(gross_amount) AS total_gross, sum(withholding_amount) AS total_withholding,
  sum(net_amount) AS total_net FROM div GROUP BY 1, 2""",
}


def cgt_ctes(source):
    return {**FIFO, **CGT_SQL, "yearly_cgt": CGT_SQL["yearly_cgt"].format(source)}


REPLAY_BASE = {"seq": f"SELECT *, row_number() OVER {W} AS i FROM trades_raw"}
HELD = """SELECT account, symbol, ts, trade_id, i, CASE WHEN side = 'BUY' THEN quantity ELSE 0 END AS held, side = 'SELL' AS rejected FROM seq WHERE i = 1
  UNION ALL SELECT s.account, s.symbol, s.ts, s.trade_id, s.i, CASE WHEN side = 'BUY' THEN r.held + quantity WHEN quantity > r.held THEN r.held ELSE r.held - quantity END,
  side = 'SELL' AND quantity > r.held FROM held r JOIN seq s ON s.account = r.account AND s.symbol = r.symbol AND s.i = r.i + 1"""
POSITION = """SELECT account, symbol, ts, trade_id, i, CASE WHEN side = 'BUY' THEN quantity ELSE 0 END AS shares, CASE WHEN side = 'BUY' THEN quantity * price ELSE 0 END AS total_cost
  FROM seq WHERE i = 1 UNION ALL SELECT s.account, s.symbol, s.ts, s.trade_id, s.i, CASE WHEN side = 'BUY' THEN r.shares + quantity WHEN quantity >= r.shares THEN 0 ELSE r.shares - quantity END,
  CASE WHEN side = 'BUY' THEN r.total_cost + quantity * price WHEN quantity >= r.shares THEN 0 ELSE (r.shares - quantity) * (r.total_cost / r.shares) END
  FROM position r JOIN seq s ON s.account = r.account AND s.symbol = r.symbol AND s.i = r.i + 1"""


def recursive(names, select, extra):
    return "WITH RECURSIVE " + with_sql(names, select, extra)[len("WITH "):]


def fee_sql(q, p, rate=0.0035, least=0.35, venue=0.003):
    return f"CASE WHEN {q} > 0 AND {p} > 0 THEN greatest(least(greatest({q} * {rate}, {least}), {q} * {p} * 0.01) + {q} * {venue}, 0) ELSE 0 END"


BASE_FEE = "least(greatest(quantity * 0.0035, 0.35), quantity * price * 0.01)"
LEVY = "(quantity * price * 0.0000278 + least(quantity * 0.000145, 7.27))"
ORDER_SQL = {
    "marked": """SELECT account, h.symbol, shares, sector, shares * price * 0.9 + 10 AS total_cost, price AS current_price, shares * price AS market_value,
  shares * price - (shares * price * 0.9 + 10) AS unrealized_pnl FROM holdings h JOIN part_prices p ON h.symbol = p.symbol""",
    "each": "SELECT t.account, a.account_value / count(*) AS each_value, a.account_value * (1 - 0.02::DOUBLE) / count(*) AS part_value FROM targets t JOIN accounts a ON t.account = a.account GROUP BY t.account, a.account_value",
    "paired": """SELECT coalesce(h.account, t.account) AS account, coalesce(h.symbol, t.symbol) AS symbol, coalesce(h.shares, 0) AS current_shares, t.symbol IS NOT NULL AS is_target,
  coalesce(t.predicted_rank, 0) AS predicted_rank, coalesce(t.sector, '') AS sector FROM holdings h FULL JOIN targets t ON h.account = t.account AND h.symbol = t.symbol""",
    "sized": """SELECT b.*, coalesce(p.price, 0) AS price, CASE WHEN is_target AND p.price > 0 THEN round_even(each_value / p.price, 4) ELSE 0 END AS target_shares
  FROM paired b LEFT JOIN part_prices p ON b.symbol = p.symbol LEFT JOIN each e ON b.account = e.account""",
    "chosen_orders": """SELECT *, NOT is_target AS leaves, CASE WHEN NOT is_target OR target_shares < current_shares THEN 'SELL' ELSE 'BUY' END AS action,
  CASE WHEN NOT is_target THEN current_shares ELSE abs(target_shares - current_shares) END AS quantity FROM sized
  WHERE (NOT is_target AND current_shares > 0) OR (is_target AND price > 0 AND target_shares <> current_shares AND abs(target_shares - current_shares) * price >= 100)""",
    "qty": """SELECT t.account, t.symbol, p.price, round_even(part_value / p.price, 4) AS quantity FROM targets t JOIN each e ON t.account = e.account
  JOIN part_prices p ON t.symbol = p.symbol WHERE p.price > 0""",
    "done_orders": f"""SELECT *, quantity * price AS value, {fee_sql('quantity', 'price')} AS fee, CASE WHEN action = 'SELL' THEN quantity * price - ({fee_sql('quantity', 'price')})
  ELSE -(quantity * price + ({fee_sql('quantity', 'price')})) END AS net_value, CASE WHEN leaves THEN 'exit' WHEN current_shares = 0 THEN 'new' WHEN action = 'BUY' THEN 'rebalance buy'
  ELSE 'rebalance sell' END AS reason FROM chosen_orders""",
}
ORDER_NAMES = ["holdings", "targets", "accounts", "part_prices", "each", "paired", "sized", "chosen_orders", "done_orders"]


def fsql(names, select):
    return with_sql(names, select, FIFO)


def osql(names, select):
    return with_sql(names, select, ORDER_SQL)


QUERIES = {
    "l1_lots": (lots, fsql(LOT_NAMES, f"""SELECT account, symbol, ts, trade_id, {sig_sql('unit_cost')} AS unit_cost, lo, hi, lot_no,
  {sig_sql(f'round(cost_hi * CAST({NUDGE} AS DOUBLE), 2)')} AS cost_hi FROM lot""")),
    "l2_l4_fifo_disposals": (disposals, fsql(DISPOSAL_NAMES, f"SELECT {money_sql([*SALE, 'is_loss', 'lots_used', 'holding_days'], DISPOSAL, 2)} FROM disposal")),
    "j16_lot_matches": (matches, fsql(FIFO_NAMES, f"SELECT {money_sql(['account', 'symbol', 'sale_id', 'lot_id', 'sale_ts', 'lot_ts'], ['shares', 'cost'], 2)} FROM piece")),
    "l3_oversold_keys": (oversold, with_sql(["trades_raw"], f"""SELECT account, symbol, min(h) AS lowest FROM (SELECT account, symbol,
  sum(CASE WHEN side = 'BUY' THEN quantity ELSE -quantity END) OVER {W} AS h FROM trades_raw) GROUP BY 1, 2 HAVING min(h) < 0""")),
    "l3_rejected_sales": (rejected, recursive(["trades_raw", "seq", "held"], "SELECT account, symbol, ts, trade_id, rejected FROM held", {**REPLAY_BASE, "held": HELD})),
    "l6_open_lots": (open_lots, fsql(OPEN_NAMES, f"SELECT {money_sql(SALE, ['remaining', 'remaining_cost'], 2)} FROM open_lot")),
    "l6_holdings_summary": (summary, fsql([*OPEN_NAMES, "marks"], "SELECT " + money_sql(["account", "symbol", "n_lots"], ["shares", "cost_basis", "avg_cost", "unrealized_gain"], 2)
        + """ FROM (SELECT account, o.symbol, count(*) AS n_lots, sum(remaining) AS shares, sum(remaining_cost) AS cost_basis, sum(remaining_cost) / sum(remaining) AS avg_cost,
  sum(remaining) * any_value(price) - sum(remaining_cost) AS unrealized_gain FROM open_lot o JOIN marks m ON o.symbol = m.symbol GROUP BY 1, 2)""")),
    "l5_what_if": (what_if, fsql([*LOT_NAMES, "sold", "wanted", "guess"], f"SELECT {money_sql(['account', 'symbol'], WHAT_IF, 2)} FROM (SELECT *, proceeds - cost_basis AS gain, " +
        "least(1270, greatest(proceeds - cost_basis, 0)) AS exemption_used, greatest(proceeds - cost_basis - 1270, 0) AS taxable_gain, greatest(proceeds - cost_basis - 1270, 0) * 0.33 AS estimated_tax, "
        "CASE WHEN proceeds > cost_basis THEN greatest(proceeds - cost_basis - 1270, 0) * 0.33 / (proceeds - cost_basis) * 100 ELSE 0 END AS effective_rate FROM guess)")),
    "w21_l11_running_positions": (running, recursive(["trades_raw", "seq", "position"], "SELECT " + money_sql(SALE, ["shares", "avg_cost", "total_cost"], 4)
        + " FROM (SELECT *, CASE WHEN shares > 0 THEN total_cost / shares END AS avg_cost FROM position)", {**REPLAY_BASE, "position": POSITION})),
    "l11_final_positions": (final_positions, recursive(["trades_raw", "seq", "position"], "SELECT " + money_sql(["account", "symbol"], ["shares", "avg_cost", "total_cost"], 4)
        + " FROM (SELECT *, CASE WHEN shares > 0 THEN total_cost / shares END AS avg_cost, max(i) OVER (PARTITION BY account, symbol) AS last_i FROM position) WHERE i = last_i AND shares > 0",
        {**REPLAY_BASE, "position": POSITION})),
    "a24_a25_cgt_summary": (cgt, with_sql([*DISPOSAL_NAMES, "split_accounts", "yearly_cgt"], f"SELECT {money_sql(['account', 'year', 'n_disposals'], CGT, 2)} FROM yearly_cgt",
        {**cgt_ctes("split_accounts"), "split_accounts": "SELECT * REPLACE (account || '/' || symbol AS account) FROM disposal"})),
    "f12_cgt_instalments": (instalments, fsql(DISPOSAL_NAMES, f"""SELECT {money_sql(['account', 'payment_due', 'n_disposals'], ['net_gain'], 2)} FROM (SELECT account,
  CASE WHEN month(ts) <= 9 THEN make_date(year(ts), 12, 15) ELSE make_date(year(ts) + 1, 1, 31) END AS payment_due, count(*) AS n_disposals, sum(gain) AS net_gain FROM disposal GROUP BY 1, 2)""")),
    "f11_dividends": (dividends, with_sql(["payments", "div"], "SELECT " + rounded_sql(["account", "symbol", "payment_date"],
        ["shares", "gross_amount", "withholding_rate", "withholding_amount", "net_amount"]) + """ FROM (SELECT account, symbol, payment_date, sum(shares) AS shares, sum(gross_amount) AS gross_amount,
  sum(withholding_rate) AS withholding_rate, sum(withholding_amount) AS withholding_amount, sum(net_amount) AS net_amount FROM div GROUP BY 1, 2, 3)""", CGT_SQL)),
    "a26_dividend_summary": (dividend_totals, with_sql(["payments", "div", "div_year"], f"SELECT {rounded_sql(['account', 'year', 'n_payments'], DIV)} FROM div_year", CGT_SQL)),
    "a26_dividends_by_symbol": (lambda s, sf: dividend_totals(s, sf, True), with_sql(["payments", "div"], "SELECT " + rounded_sql(["account", "year", "symbol", "n_payments"], DIV)
        + """ FROM (SELECT account, year(payment_date)::INT AS year, symbol, count(*) AS n_payments, sum(gross_amount) AS total_gross, sum(withholding_amount) AS total_withholding,
  sum(net_amount) AS total_net FROM div GROUP BY 1, 2, 3)""", CGT_SQL)),
    "l8_dividend_history": (history, with_sql(["payments", "div"], f"SELECT {rounded_sql(['account', 'symbol', 'payment_date'], ['gross_amount', 'net_amount'])} FROM div WHERE symbol = 'C42'", CGT_SQL)),
    "l9_j15_expected_dividends": (expected, with_sql(["holdings", "part_prices"], f"""SELECT account, h.symbol, {sig_sql('shares')} AS shares, {sig_sql('price')} AS price,
  {sig_sql('p_size / 1000.0 * 100')} AS yield_pct, {sig_sql('shares * price * (p_size / 1000.0)')} AS annual_gross, {sig_sql('shares * price * (p_size / 1000.0) * 0.15')} AS annual_withholding,
  {sig_sql('shares * price * (p_size / 1000.0) * 0.85')} AS annual_net FROM holdings h JOIN part_prices p ON h.symbol = p.symbol JOIN part q ON 'P' || q.p_partkey = h.symbol WHERE p_partkey % 3 = 0""")),
    "l9_expected_totals": (expected_totals, with_sql(["holdings", "part_prices"], f"""SELECT account, {sig_sql('sum(shares * price * (p_size / 1000.0))')} AS total_gross,
  {sig_sql('sum(shares * price * (p_size / 1000.0)) * 0.15')} AS total_withholding, {sig_sql('sum(shares * price * (p_size / 1000.0)) * 0.85')} AS total_net
  FROM holdings h JOIN part_prices p ON h.symbol = p.symbol JOIN part q ON 'P' || q.p_partkey = h.symbol WHERE p_partkey % 3 = 0 GROUP BY 1""")),
    "l7_annual_report": (annual, with_sql([*DISPOSAL_NAMES, "yearly_cgt", "payments", "div", "div_year"], "SELECT " + money_sql(
        ["account", "year", "n_disposals", "n_payments", "first_instalment", "second_instalment", "preliminary_return", "final_return"],
        ["net_gain", "taxable_gain", "estimated_tax", *DIV], 2) + """ FROM (SELECT account, year, coalesce(n_disposals, 0) AS n_disposals, coalesce(n_payments, 0) AS n_payments,
  make_date(year, 12, 15) AS first_instalment, make_date(year + 1, 1, 31) AS second_instalment, make_date(year + 1, 10, 31) AS preliminary_return, make_date(year + 1, 11, 15) AS final_return,
  coalesce(net_gain, 0) AS net_gain, coalesce(taxable_gain, 0) AS taxable_gain, coalesce(estimated_tax, 0) AS estimated_tax, coalesce(total_gross, 0) AS total_gross,
  coalesce(total_withholding, 0) AS total_withholding, coalesce(total_net, 0) AS total_net FROM yearly_cgt FULL JOIN div_year USING (account, year))""", cgt_ctes("disposal"))),
    "f8_commissions": (fees, with_sql(["trades_raw", "trades"], f"""SELECT account, symbol, ts, trade_id, {sig_sql(fee_sql('quantity', 'price'))} AS tiered,
  {sig_sql(fee_sql('quantity', 'price', 0.005, 1.0, 0.0))} AS fixed, {sig_sql(fee_sql('quantity', 'price', venue=0.0))} AS no_exchange, {sig_sql(fee_sql('quantity', 'price', venue=-0.002))} AS adding FROM trades""")),
    "f9_fee_breakdown": (fee_parts, with_sql(["trades_raw", "trades"], f"""SELECT account, symbol, ts, trade_id, {sig_sql(BASE_FEE)} AS base_fee, {sig_sql('quantity * 0.003')} AS exchange_fee,
  {sig_sql(LEVY)} AS regulatory_fee, {sig_sql(f'{BASE_FEE} + quantity * 0.003 + {LEVY}')} AS total_fee, {sig_sql(f'({BASE_FEE} + quantity * 0.003 + {LEVY}) / (quantity * price) * 100')} AS fee_pct FROM trades""")),
    "a29_rebalance_cost": (costs_of_trades, with_sql(["trades_raw", "trades"], "SELECT " + rounded_sql(["account", "trade_count"], ["total_fees", "total_traded_value", "avg_fee_per_trade", "fee_as_pct"])
        + """ FROM (SELECT account, count(*) AS trade_count, sum(fee) AS total_fees, sum(quantity * price) AS total_traded_value, avg(fee) AS avg_fee_per_trade,
  sum(fee) / sum(quantity * price) * 100 AS fee_as_pct FROM trades GROUP BY 1)""")),
    "l10_marked_positions": (positions_marked, osql(["holdings", "part_prices", "marked"], "SELECT " + rounded_sql(["account", "symbol"],
        ["shares", "total_cost", "current_price", "market_value", "unrealized_pnl", "unrealized_pnl_pct"]) + " FROM (SELECT *, unrealized_pnl / total_cost * 100 AS unrealized_pnl_pct FROM marked)")),
    "a27_o7_portfolio_summary": (portfolio, osql(["holdings", "part_prices", "accounts", "marked"], "SELECT " + rounded_sql(["account", "n_positions"], PORTFOLIO) + """ FROM (
  SELECT a.account, coalesce(n, 0) AS n_positions, coalesce(inv, 0) + account_value / 10 AS total_value, account_value / 10 AS cash, coalesce(inv, 0) AS invested, coalesce(tc, 0) AS total_cost,
  coalesce(pnl, 0) AS unrealized_pnl, CASE WHEN tc > 0 THEN pnl / tc * 100 ELSE 0 END AS unrealized_pnl_pct, coalesce(big, 0) AS largest_position, coalesce(small, 0) AS smallest_position
  FROM accounts a LEFT JOIN (SELECT account, count(*) AS n, sum(market_value) AS inv, sum(total_cost) AS tc, sum(unrealized_pnl) AS pnl, max(market_value) AS big, min(market_value) AS small
  FROM marked GROUP BY 1) m ON a.account = m.account)""")),
    "a27_sector_allocation": (allocation, osql(["holdings", "part_prices", "marked"], f"""SELECT account, sector, {sig_sql('v * 100 / sum(v) OVER (PARTITION BY account)')} AS allocation_pct
  FROM (SELECT account, sector, sum(market_value) AS v FROM marked GROUP BY 1, 2)""")),
    "j18_resolved_prices": (resolved, osql(["part_prices"], f"""SELECT s.symbol, CASE WHEN p.symbol IS NULL THEN 'default' WHEN right(s.symbol, 1) <> '3' THEN 'feed' ELSE 'panel' END AS price_source,
  {sig_sql("CASE WHEN p.symbol IS NULL THEN 100 WHEN right(s.symbol, 1) <> '3' THEN p.price + 1 ELSE p.price END")} AS price FROM (SELECT 'P' || p_partkey AS symbol FROM part) s
  LEFT JOIN part_prices p ON s.symbol = p.symbol""")),
    "l12_l14_j14_o3_rebalance_orders": (orders, osql(ORDER_NAMES, "SELECT " + rounded_sql(["account", "symbol", "action", "reason", "sector"], ORDER_NUMBERS) + " FROM done_orders")),
    "l13_initial_orders": (first_orders, osql(["targets", "accounts", "part_prices", "each", "qty"], "SELECT account, symbol, 'BUY' AS action, " + rounded_sql([], ["quantity", "price", "value", "fee", "net_value"])
        + f""" FROM (SELECT *, quantity * price AS value, {fee_sql('quantity', 'price')} AS fee, -(quantity * price + ({fee_sql('quantity', 'price')})) AS net_value FROM qty) WHERE value >= 1""")),
    "a28_order_costs": (order_costs, osql(ORDER_NAMES, "SELECT " + rounded_sql(["account", "n_buys", "n_sells"], ["total_fees", "total_buys", "total_sells", "net_cash_flow"]) + """ FROM (SELECT *,
  total_sells - total_buys - total_fees AS net_cash_flow FROM (SELECT account, count(*) FILTER (action = 'BUY') AS n_buys, count(*) FILTER (action = 'SELL') AS n_sells, sum(fee) AS total_fees,
  sum(CASE WHEN action = 'BUY' THEN value ELSE 0 END) AS total_buys, sum(CASE WHEN action = 'SELL' THEN value ELSE 0 END) AS total_sells FROM done_orders GROUP BY 1))""")),
    "u2_exits": (exits, osql(["holdings", "targets"], f"""SELECT account, symbol, {sig_sql('shares')} AS shares FROM holdings h WHERE shares > 0
  AND NOT EXISTS (SELECT 1 FROM targets t WHERE t.account = h.account AND t.symbol = h.symbol)""")),
    "a30_execution_summary": (executions, with_sql(["fills"], "SELECT " + rounded_sql(["account", "total_orders", "filled", "rejected"], ["total_value", "total_fees", "buy_value", "sell_value"])
        + """ FROM (SELECT account, count(*) AS total_orders, count(*) FILTER (status = 'filled') AS filled, count(*) FILTER (status = 'rejected') AS rejected,
  sum(CASE WHEN status = 'filled' THEN quantity * fill_price ELSE 0 END) AS total_value, sum(CASE WHEN status = 'filled' THEN fee ELSE 0 END) AS total_fees,
  sum(CASE WHEN status = 'filled' AND action = 'BUY' THEN quantity * fill_price ELSE 0 END) AS buy_value, sum(CASE WHEN status = 'filled' AND action = 'SELL' THEN quantity * fill_price ELSE 0 END) AS sell_value
  FROM fills GROUP BY 1)""")),
}
