"""Names, thresholds and rates that results depend on."""

from __future__ import annotations

# Feature names by category.
FEATURE_CATEGORIES = {
    "valuation": ["bm", "ptb", "ps", "pcf", "pe_inc", "pe_exi", "pe_op_basic", "pe_op_dil", "evm", "dpr", "divyield"],
    "profitability": ["npm", "gpm", "roa", "roe", "roce", "opmbd", "opmad", "ptpm", "cfm", "efftax", "GProf",
                      "aftret_eq", "aftret_equity", "pretret_noa"],
    "solvency": ["de_ratio", "debt_at", "debt_assets", "debt_capital", "capital_ratio", "intcov", "intcov_ratio",
                 "dltt_be", "int_debt", "int_totdebt"],
    "liquidity": ["curr_ratio", "quick_ratio", "cash_ratio", "cash_conversion"],
    "efficiency": ["at_turn", "inv_turn", "rect_turn", "pay_turn", "sale_invcap", "sale_equity", "sale_nwc"],
    "financial_soundness": ["cash_lt", "invt_act", "rect_act", "short_debt", "curr_debt", "lt_debt", "profit_lct",
                            "ocf_lct", "cash_debt", "fcf_ocf"],
    "other": ["accrual", "rd_sale", "lt_ppent"],
    "macro": ["FEDFUNDS", "DGS10", "USACPIALLMINMEI", "1mo_inf_rate", "1yr_inf_rate", "GDP", "1mo_GDP", "1yr_GDP"],
    "size": ["MthCap"],
}
ALL_FEATURES = [name for names in FEATURE_CATEGORIES.values() for name in names]
NOT_NEUTRALIZED = FEATURE_CATEGORIES["macro"] + FEATURE_CATEGORIES["size"]

# Derived macro columns as (series, months).
MACRO_CHANGES = {"1mo_inf_rate": ("USACPIALLMINMEI", 1), "1yr_inf_rate": ("USACPIALLMINMEI", 12), "1mo_GDP": ("GDP", 1), "1yr_GDP": ("GDP", 12)}

# Model parameters and training thresholds.
FOREST = {"trees": 500, "depth": 12, "feature_share": 0.3, "min_leaf": 50, "sample_share": 0.7, "seed": 42}
# A fitted forest is kept in parts of so many trees.
FOREST_PART_TREES = 21
RIDGE_ALPHA = 1.0
# Ledgers: rows of a partition, and of a key that one task may work off.
PART_ROWS = 200_000
KEY_ROWS = 1_000_000
ROE_WEIGHT = 0.3
MISSING_THRESHOLD = 0.5
ROW_COMPLETENESS = 0.8
TARGET_PERCENTILES = (1, 99)

# Size buckets, ascending upper bounds; above the last bound comes the top bucket.
CAP_BASE_YEAR = 2021
CAP_BOUNDS = {"Nano Cap": 50e6, "Micro Cap": 300e6, "Small Cap": 2e9, "Mid Cap": 10e9, "Large Cap": 200e9}
CAP_TOP = "Mega Cap"
CAP_ORDER = list(CAP_BOUNDS) + [CAP_TOP]

# Commission schedules.
FEES = {
    "tiered": {"per_share": 0.0035, "minimum": 0.35, "max_share": 0.01, "remove": 0.003, "add": -0.002},
    "fixed": {"per_share": 0.005, "minimum": 1.00, "max_share": 0.01, "remove": 0.0, "add": 0.0},
}
SEC_RATE = 0.0000278
TAF_PER_SHARE = 0.000145
TAF_MAX = 7.27

# Tax rates.
CGT_RATE = 0.33
CGT_EXEMPTION = 1270.0
WITHHOLDING = 0.15

# Walk-forward defaults.
N_STOCKS = 15
INITIAL_CAPITAL = 30000.0
MIN_CAP = "Mid Cap"
DELIST_RETURN = -0.30
FREQ_TARGET = {"M": "1mo_return", "Q": "3mo_return", "S": "6mo_return", "A": "1yr_return", "Y": "1yr_return"}
FREQ_PERIODS = {"M": 12, "S": 2, "Q": 4, "A": 1, "Y": 1}
HORIZONS = {"1mo_return": 1, "3mo_return": 3, "6mo_return": 6, "1yr_return": 12}
MIN_TRAIN_ROWS = 500

# Panel pipeline.
FUNDAMENTAL_LAG_MONTHS = 1
MACRO_LAG_ROWS = 1
WINSOR_MAD = 5.0
MIN_PRICE = 1.0
MIN_MARKET_CAP = 5e6
MIN_EQUITY = 0.0
RETURN_BOUNDS = (-0.99, 10.0)
OUTLIER_Z = 3.0
OUTLIER_SHARE = 0.25
OUTLIER_FLOOR = 50
FINANCIAL_SECTOR = "Financial Services"
FINANCIAL_INDUSTRY_PREFIX = "103"
EPS = 1e-12

# Expected holding days per target, for compliance checks.
HOLDING_DAYS = {"1mo_return": 30, "3mo_return": 91, "6mo_return": 182, "1yr_return": 365}

# Words that decide security type and financial companies.
COMMON_STOCK_WORDS = ["common stock", "common_stock", "equity"]
EXCLUDED_TYPE_WORDS = ["etf", "fund", "preferred", "adr", "reit", "trust", "lp", "warrant"]
FINANCIAL_SECTOR_WORDS = ["40", "financials"]
FINANCIAL_INDUSTRY_WORDS = ["bank", "insurance", "financial", "asset management", "capital markets", "mortgage",
                            "credit", "investment"]

# Name parts that mark ratio columns (name-based selection, kept for the legacy option).
RATIO_WORDS = ["ratio", "turn", "ptb", "ps", "pcf", "pe_", "bm", "npm", "gpm", "roa", "roe", "evm", "dpr", "opm",
               "ptpm", "cfm", "roce", "efftax", "debt_", "int_", "profit_", "ocf_", "cash_", "fcf_", "accrual",
               "sale_", "rd_sale", "lt_ppent"]

# Name parts that assign a wide statement column to one or more statements.
INCOME_WORDS = ["revenue", "income", "expense", "profit", "loss", "tax", "earning", "ebit", "depreciation",
                "amortization", "research", "cost", "margin", "interest", "dividend", "eps", "share"]
BALANCE_WORDS = ["asset", "liabilit", "equity", "debt", "cash", "inventory", "receivable", "payable", "capital",
                 "stock", "share", "book", "property", "plant", "equipment", "intangible", "goodwill", "investment",
                 "retain", "treasury"]
CASHFLOW_WORDS = ["cashflow", "cash flow", "operating", "investing", "financing", "capex", "capital expenditure",
                  "dividend", "repurchase", "issuance", "free cash"]
STATEMENT_META = ["code", "date", "filing_date", "currency", "fiscalYear", "fiscalQuarter"]
