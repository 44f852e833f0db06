"""Column layouts of the tables the library works on, and vendor name maps."""

from __future__ import annotations

from pyspark.sql import types as T

KEYS = ["ticker", "fiscal_year", "fiscal_period", "publish_date"]

# Delimited-file headers of vendor A, mapped to column names. The vendor's own company id is the price
# header that ends in "Id".
PRICE_HEADERS = {
    "Ticker": "ticker", "Date": "date", "Adj. Close": "adj_close", "Dividend": "dividend",
    "Shares Outstanding": "shares",
}
KEY_HEADERS = {
    "Ticker": "ticker", "Fiscal Year": "fiscal_year", "Fiscal Period": "fiscal_period", "Publish Date": "publish_date",
}
INCOME_HEADERS = {
    "Revenue": "revenue",
    "Cost of Revenue": "cost_of_revenue",
    "Gross Profit": "gross_profit",
    "Operating Income (Loss)": "operating_income",
    "Interest Expense, Net": "interest_expense",
    "Pretax Income (Loss)": "pretax_income",
    "Income Tax (Expense) Benefit, Net": "income_tax",
    "Net Income": "net_income",
    "Net Income (Common)": "net_income_common",
    "Depreciation & Amortization": "depreciation",
    "Research & Development": "research",
}
BALANCE_HEADERS = {
    "Total Assets": "total_assets",
    "Total Equity": "total_equity",
    "Total Current Assets": "current_assets",
    "Total Current Liabilities": "current_liabilities",
    "Inventories": "inventories",
    "Cash, Cash Equivalents & Short Term Investments": "cash_items",
    "Accounts & Notes Receivable": "receivables",
    "Payables & Accruals": "payables",
    "Property, Plant & Equipment, Net": "ppe",
    "Short Term Debt": "short_term_debt",
    "Long Term Debt": "long_term_debt",
    "Total Liabilities": "total_liabilities",
}
CASHFLOW_HEADERS = {
    "Net Cash from Operating Activities": "operating_cash",
    "Change in Fixed Assets & Intangibles": "fixed_asset_change",
    "Dividends Paid": "dividends_paid",
    "Cash from (Repurchase of) Equity": "equity_cash",
}

# Vendor B field names; several sources may feed one target, first non-null in file order wins.
B_PRICES = {"code": "ticker", "date": "date", "adjusted_close": "adj_close", "close": "close", "open": "open",
            "high": "high", "low": "low", "volume": "volume"}
B_META = {"code": "ticker", "filing_date": "publish_date", "date": "report_date", "fiscalYear": "fiscal_year",
          "fiscalQuarter": "fiscal_period"}
B_INCOME = {
    "totalRevenue": "revenue", "costOfRevenue": "cost_of_revenue", "grossProfit": "gross_profit",
    "operatingIncome": "operating_income", "interestExpense": "interest_expense", "incomeBeforeTax": "pretax_income",
    "incomeTaxExpense": "income_tax", "netIncome": "net_income",
    "netIncomeApplicableToCommonShares": "net_income_common", "depreciation": "depreciation",
    "researchDevelopment": "research", "researchAndDevelopmentExpenses": "research",
    "depreciationAndAmortization": "depreciation",
}
B_BALANCE = {
    "totalAssets": "total_assets", "totalStockholderEquity": "total_equity", "totalShareholderEquity": "total_equity",
    "totalCurrentAssets": "current_assets", "totalCurrentLiabilities": "current_liabilities",
    "inventory": "inventories", "netReceivables": "receivables", "accountsReceivable": "receivables",
    "shortTermDebt": "short_term_debt", "shortLongTermDebt": "short_term_debt", "longTermDebt": "long_term_debt",
    "longTermDebtNoncurrent": "long_term_debt", "cashAndShortTermInvestments": "cash_items", "cash": "cash_items",
    "cashAndCashEquivalents": "cash_items", "propertyPlantEquipment": "ppe", "propertyPlantAndEquipmentNet": "ppe",
    "totalLiabilities": "total_liabilities", "accountsPayable": "payables",
    "commonStockSharesOutstanding": "shares", "sharesOutstanding": "shares", "Shares Outstanding": "shares",
    "capitalExpenditures": "fixed_asset_change",
}
B_CASHFLOW = {
    "totalCashFromOperatingActivities": "operating_cash", "operatingCashFlow": "operating_cash",
    "capitalExpenditures": "fixed_asset_change", "dividendsPaid": "dividends_paid", "dividendPayout": "dividends_paid",
    "issuanceOfStock": "equity_cash", "repurchaseOfStock": "equity_cash",
}
B_COMPANIES = {
    "Code": "ticker", "Name": "company_name", "Exchange": "exchange", "Type": "security_type", "Sector": "sector",
    "Industry": "industry", "GicSector": "gics_sector", "GicGroup": "gics_group", "GicIndustry": "gics_industry",
    "GicSubIndustry": "gics_subindustry",
}
INCOME_ITEMS = list(INCOME_HEADERS.values())
BALANCE_ITEMS = list(BALANCE_HEADERS.values())
CASHFLOW_ITEMS = list(CASHFLOW_HEADERS.values())
FLOW_ITEMS = INCOME_ITEMS + CASHFLOW_ITEMS
AVERAGED_ITEMS = ["total_assets", "total_equity", "current_assets", "current_liabilities", "inventories",
                  "receivables", "payables"]


def _fields(names, kind):
    return [T.StructField(n, kind) for n in names]


_STATEMENT_KEYS = [T.StructField("ticker", T.StringType()), T.StructField("fiscal_year", T.IntegerType()),
                   T.StructField("fiscal_period", T.StringType()), T.StructField("publish_date", T.DateType())]

PRICES = T.StructType([
    T.StructField("ticker", T.StringType()), T.StructField("id", T.StringType()), T.StructField("date", T.DateType()),
    *_fields(["adj_close", "dividend", "shares"], T.DoubleType())])
INCOME = T.StructType(_STATEMENT_KEYS + _fields(INCOME_ITEMS, T.DoubleType()))
BALANCE = T.StructType(_STATEMENT_KEYS + _fields(BALANCE_ITEMS, T.DoubleType()))
CASHFLOW = T.StructType(_STATEMENT_KEYS + _fields(CASHFLOW_ITEMS, T.DoubleType()))
COMPANIES = T.StructType(_fields(["ticker", "company_name", "industry_id", "sector", "industry", "gics_sector",
                                  "security_type", "exchange"], T.StringType()))
INDUSTRIES = T.StructType(_fields(["industry_id", "sector", "industry"], T.StringType()))
BENCHMARK = T.StructType([T.StructField("date", T.DateType()), T.StructField("level", T.DoubleType())])
TRADES = T.StructType([
    *_fields(["account", "symbol"], T.StringType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("trade_id", T.StringType()), T.StructField("side", T.StringType()),
    *_fields(["quantity", "price", "fee"], T.DoubleType())])
