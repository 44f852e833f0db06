"""Financial ratios as column expressions over one panel row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from .columns import ratio


def _over(top: str, bottom: str) -> str:
    return f"try_divide({top}, {bottom} + 1e-12D)"


def ratio_columns() -> dict[str, Column]:
    """Name to expression; inputs are statement items, their ``_ttm`` sums and ``_prev`` balance items."""
    return {name: F.expr(text) for name, text in ratio_texts().items()}


def ratio_texts() -> dict[str, str]:
    """The ratios as SQL expressions; a zero divisor gives NULL."""
    debt, cash, assets, equity, cap = "total_debt", "cash_items", "total_assets", "total_equity", "MthCap"
    tca, tcl, inv, ltd, std = "current_assets", "current_liabilities", "inventories", "long_term_debt", "short_term_debt"
    rev, profit, op, ocf, cor = "revenue_ttm", "net_income_ttm", "operating_income_ttm", "operating_cash_ttm", "cost_of_revenue_ttm"
    interest = "abs(interest_expense_ttm)"
    ebitda = f"({op} + depreciation_ttm)"
    ev = f"({cap} + {debt} - coalesce({cash}, 0D))"
    invested = f"({equity} + {debt} - coalesce({cash}, 0D))"
    # A missing change stays missing: greatest alone would turn it into 0.
    capex = "(CASE WHEN fixed_asset_change_ttm IS NOT NULL THEN greatest(-fixed_asset_change_ttm, 0D) END)"
    free = f"({ocf} - {capex})"

    def mean(item: str) -> str:
        return f"({item} + {item}_prev) / 2"

    value = {
        "bm": _over(equity, cap), "ptb": _over(f"{cap} + 1e-12D", equity), "ps": _over(f"{cap} + 1e-12D", rev),
        "pcf": _over(f"{cap} + 1e-12D", ocf), "npm": _over(profit, rev), "gpm": _over("gross_profit_ttm", rev),
        "roa": _over(profit, assets), "roe": _over(profit, equity), "aftret_eq": _over(profit, mean(equity)),
        "aftret_equity": _over(profit, mean(equity)), "EBIT_ttm": op, "EBITDA_ttm": ebitda,
        "roce": _over(op, f"{assets} - {tcl}"),
        "pretret_noa": _over(op, f"({assets} - {tcl} + ({assets}_prev - {tcl}_prev)) / 2"),
        "cash": cash, "EV": ev, "evm": _over(ev, ebitda), "debt_ebitda": _over(debt, ebitda),
        "pe_inc": _over(cap, profit), "pe_exi": _over(cap, "net_income_common_ttm"), "pe_op_basic": _over(cap, op),
        "pe_op_dil": _over(cap, op),
    }
    margins = {
        "opmbd": _over(op, rev), "opmad": _over(ebitda, rev), "ptpm": _over("pretax_income_ttm", rev), "cfm": _over(ocf, rev),
        "dpr": _over("-coalesce(dividends_paid_ttm, 0D)", profit),
    }
    strength = {
        "de_ratio": _over(debt, equity), "capital_ratio": _over(equity, assets), "debt_at": _over(debt, assets),
        "debt_assets": _over(debt, assets), "debt_capital": _over(debt, f"{debt} + {equity}"), "dltt_be": _over(ltd, equity),
        "intcov": _over(op, interest), "intcov_ratio": _over(op, interest), "int_debt": _over(interest, debt),
        "int_totdebt": _over(interest, debt), "curr_ratio": _over(tca, tcl), "quick_ratio": _over(f"({tca} - {inv})", tcl),
        "cash_ratio": _over(cash, tcl), "cash_conversion": _over(ocf, profit), "cash_lt": _over(cash, assets),
        "invt_act": _over(inv, tca), "rect_act": _over("receivables", tca), "short_debt": _over(std, debt),
        "curr_debt": _over(std, debt), "lt_debt": _over(ltd, debt), "profit_lct": _over(profit, tcl),
        "ocf_lct": _over(ocf, tcl), "cash_debt": _over(cash, debt), "capex_ttm": capex, "fcf_ttm": free,
        "fcf_ocf": _over(free, ocf),
    }
    use = {
        "at_turn": _over(rev, mean(assets)), "inv_turn": _over(cor, mean(inv)), "rect_turn": _over(rev, mean("receivables")),
        "pay_turn": _over(cor, mean("payables")), "invcap": invested, "sale_invcap": _over(rev, invested),
        "sale_equity": _over(rev, equity), "sale_nwc": _over(rev, f"{tca} - {tcl}"),
        "accrual": _over(f"({profit} - {ocf})", assets), "GProf": _over("gross_profit_ttm", assets),
        "rd_sale": _over("research_ttm", rev), "lt_ppent": _over("ppe", assets), "efftax": _over("income_tax_ttm", "pretax_income_ttm"),
    }
    return {**value, **margins, **strength, **use}


# Intermediate amounts among the outputs; the others are ratios and are winsorized.
AMOUNTS = ["EBIT_ttm", "EBITDA_ttm", "cash", "EV", "capex_ttm", "fcf_ttm", "invcap"]

# The smaller ratio set that works without the panel, from averages supplied as ``_avg`` columns.
BASIC_RATIOS = {
    "bm": ["total_equity", "MthCap"], "ptb": ["total_equity", "MthCap"], "ps": ["revenue_ttm", "MthCap"],
    "pcf": ["operating_cash_ttm", "MthCap"], "npm": ["net_income_ttm", "revenue_ttm"],
    "roa": ["net_income_ttm", "total_assets"], "roe": ["net_income_ttm", "total_equity"],
    "gpm": ["gross_profit_ttm", "revenue_ttm"], "de_ratio": ["total_debt", "total_equity"],
    "debt_at": ["total_debt", "total_assets"], "debt_assets": ["total_debt", "total_assets"],
    "curr_ratio": ["current_assets", "current_liabilities"],
    "quick_ratio": ["current_assets", "current_liabilities", "inventories"],
    "cash_ratio": ["cash_items", "current_liabilities"], "at_turn": ["revenue_ttm", "total_assets_avg"],
    "inv_turn": ["cost_of_revenue_ttm", "inventories_avg"], "rect_turn": ["revenue_ttm", "receivables_avg"],
}


def ratio_names() -> list[str]:
    """Names of the winsorized ratios in formula order."""
    return [n for n in ratio_texts() if n not in AMOUNTS]


def with_previous(df: DataFrame, by: str = "TICKER", order: str = "public_date") -> DataFrame:
    """Previous row's balance items of the same ticker, as ``_prev`` columns."""
    w = Window.partitionBy(by).orderBy(order)
    return df.select("*", *[F.lag(i).over(w).alias(f"{i}_prev") for i in S.AVERAGED_ITEMS])


def with_ratios(df: DataFrame) -> DataFrame:
    """Panel rows with all ratios; the helper columns leave again."""
    helpers = {f"{i}_prev" for i in S.AVERAGED_ITEMS}
    wide = df if helpers <= set(df.columns) else with_previous(df)
    return wide.select(*df.columns, *[e.alias(n) for n, e in ratio_columns().items()])


def with_averages(df: DataFrame, by: str = "TICKER", order: str = "public_date",
                  items: list[str] | None = None) -> DataFrame:
    """Mean of the current and the previous row as ``_avg`` columns; NULL if either is."""
    w = Window.partitionBy(by).orderBy(order)
    items = [i for i in (items or S.AVERAGED_ITEMS) if i in df.columns]
    return df.select("*", *[((F.col(i) + F.lag(i).over(w)) / 2).alias(f"{i}_avg") for i in items])


def with_basic_ratios(df: DataFrame) -> DataFrame:
    """The ratios whose inputs exist in ``df``."""
    if "total_debt" not in df.columns and {"short_term_debt", "long_term_debt"} <= set(df.columns):
        df = df.withColumn("total_debt", total_debt())
    c, eps = F.col, F.lit(1e-12)
    have = set(df.columns)
    over = {
        "bm": lambda: ratio(c("total_equity"), c("MthCap")),
        "ptb": lambda: ratio(c("MthCap") + eps, c("total_equity")),
        "ps": lambda: ratio(c("MthCap") + eps, c("revenue_ttm")),
        "pcf": lambda: ratio(c("MthCap") + eps, c("operating_cash_ttm")),
        "quick_ratio": lambda: ratio(c("current_assets") - c("inventories"), c("current_liabilities")),
    }
    made = []
    for name, inputs in BASIC_RATIOS.items():
        if set(inputs) <= have:
            made.append((over[name]() if name in over else ratio(c(inputs[0]), c(inputs[1]))).alias(name))
    return df.select("*", *made)


def total_debt() -> Column:
    return F.coalesce(F.col("short_term_debt"), F.lit(0.0)) + F.coalesce(F.col("long_term_debt"), F.lit(0.0))
