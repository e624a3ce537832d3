"""Statements, ratings and company information: selection, reshaping and ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.windows import ordered

# Items of each statement, and fields of the company information. Inventory is kept for two ratios.
BALANCE = "TotalDebt TangibleBookValue TotalEquityGrossMinorityInterest StockholdersEquity TotalLiabilitiesNetMinorityInterest CurrentLiabilities TotalAssets CurrentAssets AccountsReceivable CashAndCashEquivalents OrdinarySharesNumber".split()
CASHFLOW = "FreeCashFlow CapitalExpenditure OperatingCashFlow ChangeInWorkingCapital DepreciationAndAmortization NetIncomeFromContinuingOperations".split()
INCOME = "EBITDA DilutedEPS NetIncome TaxProvision OperatingIncome OperatingExpense GrossProfit CostOfRevenue TotalRevenue".split()
INFO = "enterpriseValue trailingPE forwardPE marketCap sharesShort shortRatio priceToBook trailingEps forwardEps targetHighPrice targetLowPrice targetMeanPrice targetMedianPrice earningsGrowth revenueGrowth currentPrice".split()
ITEMS = {"balance_sheet": BALANCE, "cashflow": CASHFLOW, "income_stmt": INCOME}


def to_long(wide: DataFrame, source: str) -> DataFrame:
    """(ticker, source, item, period, value) of a statement with a column for each period end."""
    periods = [c for c in wide.columns if c not in ("ticker", "item")]
    long = wide.unpivot(["ticker", "item"], periods, "period", "value")
    return long.select("ticker", F.lit(source).alias("source"), "item", F.to_date("period").alias("period"), F.col("value").cast("double").alias("value"))


def to_wide(long: DataFrame, items: list[str]) -> DataFrame:
    """A row for each (ticker, period) with a column for each item."""
    return long.groupBy("ticker", "period").pivot("item", items).agg(F.first("value", ignorenulls=True))


def union_statements(*statements: DataFrame) -> DataFrame:
    out = statements[0]
    for s in statements[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out.select("source", *[c for c in out.columns if c != "source"])


def select_items(long: DataFrame, items: dict[str, list[str]] | None = None, extra: tuple[str, ...] = ("Inventory",)) -> tuple[DataFrame, DataFrame]:
    """Rows of the wanted items, and the tickers (with their number of items) that lack any: those are rejected whole."""
    items = items or ITEMS
    wanted = F.lit(False)
    for source, names in items.items():
        wanted = wanted | ((F.col("source") == source) & F.col("item").isin(names))
    total = sum(map(len, items.values()))
    have = long.groupBy("ticker").agg(F.countDistinct(F.when(wanted, F.struct("source", "item"))).alias("n_items"))
    good = have.where(F.col("n_items") == total).select("ticker")
    return long.where(wanted | F.col("item").isin(*extra)).join(good, "ticker", "left_semi"), have.where(F.col("n_items") < total)


def select_info(info: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """A row for each ticker of (ticker, field, value), numbers where they can be read as such."""
    fields = fields or INFO
    value = F.col("value").try_cast("double")
    clean = info.where(F.col("field").isin(fields)).withColumn("value", F.when(~F.isnan(value), value))
    return clean.groupBy("ticker").pivot("field", fields).agg(F.first("value", ignorenulls=True))


def ratings_since(ratings: DataFrame, since: str = "2015-01-01") -> DataFrame:
    return ratings.where(F.to_date("rating_ts") >= F.lit(since).cast("date"))


# Ratios as quotients of items; m_ stands for company information.
QUOTIENTS = {
    "roa": ("NetIncome", "TotalAssets"), "roe": ("NetIncome", "StockholdersEquity"), "cash_conversion": ("OperatingCashFlow", "NetIncome"),
    "pe_ratio": ("currentPrice", "trailingEps"), "ev_ebitda": ("enterpriseValue", "EBITDA"), "price_to_sales": ("marketCap", "TotalRevenue"),
    "fcf_margin": ("FreeCashFlow", "TotalRevenue"), "ocf_margin": ("OperatingCashFlow", "TotalRevenue"), "fcf_conversion": ("FreeCashFlow", "NetIncome"),
    "capex_intensity": ("CapitalExpenditure", "TotalRevenue"), "reinvestment_rate": ("CapitalExpenditure", "OperatingCashFlow"),
    "current_ratio": ("CurrentAssets", "CurrentLiabilities"), "cash_ratio": ("CashAndCashEquivalents", "CurrentLiabilities"),
    "debt_to_equity": ("TotalDebt", "StockholdersEquity"), "debt_to_assets": ("TotalDebt", "TotalAssets"), "equity_ratio": ("StockholdersEquity", "TotalAssets"),
    "tangible_equity_ratio": ("TangibleBookValue", "TotalAssets"), "asset_turnover": ("TotalRevenue", "TotalAssets"), "receivables_turnover": ("TotalRevenue", "AccountsReceivable"),
    "inventory_turnover": ("CostOfRevenue", "Inventory"), "book_value_per_share": ("StockholdersEquity", "OrdinarySharesNumber"), "tangible_book_per_share": ("TangibleBookValue", "OrdinarySharesNumber"),
    "revenue_per_share": ("TotalRevenue", "OrdinarySharesNumber"), "operating_margin": ("OperatingIncome", "TotalRevenue"), "ebitda_margin": ("EBITDA", "TotalRevenue"), "gross_margin": ("GrossProfit", "TotalRevenue"),
}


def ratios(wide: DataFrame) -> DataFrame:
    """ticker, period and every ratio whose inputs ``wide`` (items and company information as columns) has."""
    have = set(wide.columns)
    out = {n: F.try_divide(a, b) for n, (a, b) in QUOTIENTS.items() if {a, b} <= have}
    c = lambda n: F.col(n)
    if {"CurrentAssets", "CurrentLiabilities"} <= have:
        out["working_capital_ratio"] = F.try_divide(c("CurrentAssets") - c("CurrentLiabilities"), c("TotalAssets"))
    if {"OperatingCashFlow", "CapitalExpenditure"} <= have:
        out["fcf_after_capex"] = c("OperatingCashFlow") + c("CapitalExpenditure")
    if {"CurrentAssets", "CurrentLiabilities", "Inventory"} <= have:
        out["quick_ratio"] = F.try_divide(c("CurrentAssets") - c("Inventory"), c("CurrentLiabilities"))
    if {"ChangeInWorkingCapital", "TotalRevenue"} <= have:
        before = F.lag("TotalRevenue").over(ordered(time="period"))
        out["working_capital_efficiency"] = F.try_divide(c("ChangeInWorkingCapital"), c("TotalRevenue") - before)
    return wide.select("ticker", "period", *[x.alias(n) for n, x in out.items()])


def market_context(wide: DataFrame, info: DataFrame) -> DataFrame:
    return wide.join(info, "ticker")


# Yearly growth over the value before, or over its size where it may be negative.
GROWTH = {"asset_growth": ("TotalAssets", False), "equity_growth": ("StockholdersEquity", False), "debt_growth": ("TotalDebt", True), "cash_growth": ("CashAndCashEquivalents", True), "fcf_growth": ("FreeCashFlow", True), "ocf_growth": ("OperatingCashFlow", True), "capex_growth": ("CapitalExpenditure", True)}


def growth(wide: DataFrame, columns: dict[str, tuple[str, bool]] | None = None) -> DataFrame:
    def one(item: str, size: bool) -> Column:
        before = F.lag(item).over(ordered(time="period"))
        return F.try_divide(F.col(item) - before, F.abs(before) if size else before)

    columns = columns or {n: x for n, x in GROWTH.items() if x[0] in wide.columns}
    return wide.select("ticker", "period", *[one(*x).alias(n) for n, x in columns.items()])


def pe_gap(info: DataFrame, small: float = 1.0) -> DataFrame:
    """Trailing less forward price-earnings ratio, as positive, small or negative."""
    gap = F.col("trailingPE") - F.col("forwardPE")
    kind = F.when(F.abs(gap) <= small, "small").when(gap > 0, "positive").when(gap < 0, "negative")
    return info.select("ticker", gap.alias("pe_gap"), kind.alias("pe_outlook"))
