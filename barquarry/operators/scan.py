"""Latest-bar scan: which symbols meet a strategy on their last bar, with target and stop."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barquarry.functions.rolling import Rolling
from barquarry.functions.scalars import base_symbol, display_symbol, iso_date, listed as listed_name
from barquarry.operators.layout import Layout
from barquarry.operators.rules import all_met, value
from barquarry.operators.strategy import Strategy


def latest_bars(frame: DataFrame, layout: Layout) -> DataFrame:
    """Last row of every series, found on the sort order the indicators already have."""
    if "_ends" in frame.columns:
        return frame.where(F.col("_ends") & layout.own()).drop("_ends")
    following = F.lead("date", 1).over(Rolling(layout.keys).ordered)
    return (
        frame.withColumn("_next", following)
        .where(F.col("_next").isNull() & layout.own())
        .drop("_next")
    )


def scan(frame: DataFrame, strategies: Sequence[Strategy], layout: Layout) -> DataFrame:
    """One row per (strategy, symbol) whose last bar meets all entry rules."""
    last = latest_bars(frame, layout)
    hits = [
        F.when(
            all_met(s.entry),
            F.struct(
                F.lit(s.name).alias("strategy"),
                value(s.stop).alias("stop_loss"),
                value(s.target).alias("take_profit"),
            ),
        )
        for s in strategies
    ]
    marked = last.select("symbol", "date", "CLOSE", F.array(*hits).alias("_hits"))
    return marked.select(
        "symbol", "date", "CLOSE", F.explode(F.array_compact("_hits")).alias("_hit")
    ).select(
        F.col("_hit.strategy").alias("strategy"),
        "symbol",
        F.col("date").alias("entry_date"),
        F.col("CLOSE").alias("entry_price"),
        F.col("_hit.stop_loss").alias("stop_loss"),
        F.col("_hit.take_profit").alias("take_profit"),
    )


def with_compliance(rows: DataFrame, compliance: DataFrame | Sequence[str]) -> DataFrame:
    """Flag ``compliant``: is the base symbol on the list? The list keeps one row per symbol; a short one can be given as it is."""
    if not isinstance(compliance, DataFrame):
        return rows.withColumn("compliant", listed_name(base_symbol(F.col("symbol")), compliance))
    listed = compliance.select(F.col("symbol").alias("_base")).distinct().withColumn(
        "_listed", F.lit(True)
    )
    return (
        rows.join(listed, base_symbol(F.col("symbol")) == F.col("_base"), "left")
        .withColumn("compliant", F.coalesce("_listed", F.lit(False)))
        .drop("_base", "_listed")
    )


def with_estimates(hits: DataFrame, amount: float) -> DataFrame:
    """Estimated profit and loss in percent of the entry price and in money."""
    entry = F.col("entry_price")
    profit = (F.try_divide(F.col("take_profit"), entry) - 1) * 100
    loss = (F.try_divide(F.col("stop_loss"), entry) - 1) * 100
    return hits.withColumns({"est_profit_pct": profit, "est_loss_pct": loss}).withColumns(
        {
            "est_profit_rp": F.col("est_profit_pct") * F.lit(float(amount)) / 100,
            "est_loss_rp": F.col("est_loss_pct") * F.lit(float(amount)) / 100,
        }
    )


def scan_rows(hits: DataFrame, compliance: DataFrame, amount: float) -> DataFrame:
    """The 13 columns of a scan result, preceded by the strategy."""
    out = with_estimates(with_compliance(hits, compliance), amount)
    return out.select(
        "strategy",
        display_symbol(F.col("symbol"), F.col("compliant")).alias("ticker"),
        F.col("entry_price").alias("price"),
        "entry_price",
        "stop_loss",
        "take_profit",
        "est_profit_pct",
        "est_profit_rp",
        "est_loss_pct",
        "est_loss_rp",
        F.lit(None).cast("double").alias("pnl"),
        iso_date(F.col("entry_date")).alias("entry_date"),
        F.lit(None).cast("string").alias("close_date"),
        F.lit(None).cast("int").alias("hold_period"),
    )
