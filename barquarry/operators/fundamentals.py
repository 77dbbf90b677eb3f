"""Fundamental ratios: one snapshot per symbol, constant over the symbol's bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barquarry.functions.rolling import Rolling
from barquarry.operators.layout import Layout

# Output column to key of the snapshot map.
DIRECT = {
    "TRAILING_PE": "trailingPE",
    "FORWARD_PE": "forwardPE",
    "PEG_RATIO": "trailingPegRatio",
    "PRICE_TO_BOOK": "priceToBook",
    "PRICE_TO_SALES": "priceToSalesTrailing12Months",
    "RETURN_ON_EQUITY": "returnOnEquity",
    "RETURN_ON_ASSETS": "returnOnAssets",
    "PROFIT_MARGINS": "profitMargins",
    "GROSS_MARGINS": "grossMargins",
    "OPERATING_MARGINS": "operatingMargins",
    "CURRENT_RATIO": "currentRatio",
    "QUICK_RATIO": "quickRatio",
    "TOTAL_CASH_PS": "totalCashPerShare",
    "DIVIDEND_YIELD": "dividendYield",
    "PAYOUT_RATIO": "payoutRatio",
    "DIVIDEND_RATE": "dividendRate",
    "REVENUE_GROWTH": "revenueGrowth",
    "EARNINGS_GROWTH": "earningsGrowth",
    "REVENUE_PS": "revenuePerShare",
    "OPERATING_CF": "operatingCashflow",
    "FREE_CASHFLOW": "freeCashflow",
}
FUNDAMENTAL_COLUMNS = [*DIRECT, "DEBT_TO_EQUITY", "PRICE_TO_CF"]
VALID_HOURS = 24


def newest_snapshots(fundamentals: DataFrame) -> DataFrame:
    """The latest snapshot of each symbol; any one if snapshots carry no time."""
    if "fetched_at" not in fundamentals.columns:
        return fundamentals.dropDuplicates(["symbol"])
    w = Window.partitionBy("symbol").orderBy(F.col("fetched_at").desc())
    numbered = fundamentals.withColumn("_age", F.row_number().over(w))
    return numbered.where(F.col("_age") == 1).drop("_age")


def fresh_snapshots(fundamentals: DataFrame, as_of: Column) -> DataFrame:
    """Latest snapshot per symbol that is less than a day old at ``as_of``."""
    recent = fundamentals.where(
        (F.col("fetched_at") > as_of - F.expr(f"INTERVAL {VALID_HOURS} HOURS"))
        & (F.col("fetched_at") <= as_of)
    )
    return newest_snapshots(recent)


def _info(key: str) -> Column:
    return F.try_element_at(F.col("info"), F.lit(key))


def _has(*keys: str) -> Column:
    present = F.lit(True)
    for key in keys:
        present = present & F.map_contains_key(F.col("info"), key)
    return F.coalesce(present, F.lit(False))


def ratios(snapshots: DataFrame) -> DataFrame:
    """symbol, the 22 ratios that need no price, and the cash flow per share for the last one."""
    zero = F.lit(0.0)
    direct = {
        name: F.coalesce(_info(key) * 100 if key == "dividendYield" else _info(key), zero)
        for name, key in DIRECT.items()
    }
    debt = (
        F.when(
            _has("totalDebt", "totalStockholderEquity"),
            F.coalesce(F.try_divide(_info("totalDebt"), _info("totalStockholderEquity")), zero),
        )
        .when(_has("debtToEquity"), F.coalesce(_info("debtToEquity"), zero))
        .otherwise(zero)
    )
    per_share = F.when(
        _has("operatingCashflow", "sharesOutstanding"),
        F.try_divide(_info("operatingCashflow"), _info("sharesOutstanding")),
    )
    return snapshots.select(
        "symbol",
        *[v.alias(n) for n, v in direct.items()],
        debt.alias("DEBT_TO_EQUITY"),
        per_share.alias("_cash_flow_per_share"),
    )


def last_closes(bars: DataFrame) -> DataFrame:
    """Close of each symbol's last bar: aggregated before the shuffle, no sort."""
    return bars.groupBy("symbol").agg(F.max_by("close", "date").alias("last_close"))


def _with_price(joined: DataFrame, last_close: Column) -> dict[str, Column]:
    zero = F.lit(0.0)
    made = {n: F.coalesce(F.col(n), zero) for n in FUNDAMENTAL_COLUMNS if n != "PRICE_TO_CF"}
    made["PRICE_TO_CF"] = F.coalesce(F.try_divide(last_close, F.col("_cash_flow_per_share")), zero)
    return made


def fundamental_columns(bars: DataFrame, snapshots: DataFrame) -> DataFrame:
    """One row per symbol with bars, with all 23 columns; missing values are 0."""
    joined = last_closes(bars).join(ratios(newest_snapshots(snapshots)), "symbol", "left")
    made = _with_price(joined, F.col("last_close"))
    return joined.select("symbol", *[v.alias(n) for n, v in made.items()])


def add_fundamentals(
    bars: DataFrame,
    frame: DataFrame,
    snapshots: DataFrame,
    layout: Layout,
    as_of: str | None = None,
) -> DataFrame:
    """``frame`` (bars with or without indicators) with the fundamental columns.

    With ``as_of`` only snapshots less than a day old then count; of several of a symbol the
    latest does, so one row per symbol is joined and no bar is multiplied. Spark broadcasts the
    small side if its measured size allows, and otherwise shuffles it to the partitioning the
    frame already has. The last close comes from the frame; in a block layout, from ``bars``.
    """
    if as_of is not None:
        snapshots = fresh_snapshots(snapshots, F.lit(as_of).cast("timestamp"))
    if layout.blocked:
        return frame.join(fundamental_columns(bars, snapshots), "symbol", "left")
    whole = Rolling(layout.keys).whole
    priced = frame.withColumn("_last_close", F.max_by("CLOSE", "date").over(whole))
    joined = priced.join(ratios(newest_snapshots(snapshots)), "symbol", "left")
    made = _with_price(joined, F.col("_last_close"))
    return joined.select(*frame.columns, *[v.alias(n) for n, v in made.items()])
