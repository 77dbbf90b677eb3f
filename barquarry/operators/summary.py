"""Per-symbol and overall figures of extracted trades."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SUMMARY_COLUMNS = [
    "strategy",
    "symbol",
    "total_trades",
    "wins",
    "losses",
    "winrate",
    "avg_holding_days",
    "net_profit",
    "final_equity",
    "avg_win_pct",
    "avg_loss_pct",
    "risk_reward",
    "best_roi_pct",
    "exit_reason_count",
]
_COUNTS = "map<string,bigint>"


def symbol_summary(
    trades: DataFrame, amount: float, symbols: DataFrame | None = None, names: Sequence[str] = ()
) -> DataFrame:
    """One row per (strategy, symbol).

    Trades are first aggregated per exit reason, which both counts the reasons and leaves only
    a few rows per symbol for the second step. With strategy ``names``, symbols without trades get a row
    of zeros: those of ``symbols``, or those that have a row without a strategy among the trades.
    """
    c, zero = F.col, F.lit(0.0)
    win = c("pnl") > 0
    if names and symbols is None:
        all_names = F.array(*[F.lit(n) for n in names])
        of = F.when(c("strategy").isNull(), all_names).otherwise(F.array("strategy"))
        trades = trades.withColumn("strategy", F.explode(of))
    by_reason = trades.groupBy("strategy", "symbol", "exit_reason").agg(
        F.count("exit_reason").alias("n"),
        F.count_if(win).alias("wins"),
        F.sum("hold_period").alias("held"),
        F.sum("pnl").alias("net"),
        F.sum(F.when(win, c("roi_pct"))).alias("win_pct"),
        F.sum(F.when(~win, c("roi_pct"))).alias("loss_pct"),
        F.max("roi_pct").alias("best"),
    )
    totals = by_reason.groupBy("strategy", "symbol").agg(
        F.sum("n").alias("total_trades"),
        F.sum("wins").alias("wins"),
        F.sum("held").alias("held"),
        F.sum("net").alias("net_profit"),
        F.sum("win_pct").alias("win_pct"),
        F.sum("loss_pct").alias("loss_pct"),
        F.max("best").alias("best"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(c("exit_reason").isNotNull(), F.struct("exit_reason", "n"))))).alias(
            "exit_reason_count"
        ),
    )
    if symbols is not None:
        wanted = symbols.select("symbol").distinct().select(
            F.explode(F.array(*[F.lit(n) for n in names])).alias("strategy"), "symbol"
        )
        totals = wanted.join(totals, ["strategy", "symbol"], "left")
    whole = F.lit(0).cast("bigint")
    out = totals.withColumns(
        {
            "total_trades": F.coalesce("total_trades", whole),
            "wins": F.coalesce("wins", whole),
            "net_profit": F.coalesce("net_profit", zero),
        }
    ).withColumns(
        {
            "losses": c("total_trades") - c("wins"),
            "winrate": F.coalesce(F.try_divide(c("wins"), c("total_trades")) * 100, zero),
            "avg_holding_days": F.coalesce(F.try_divide(c("held"), c("total_trades")), zero),
            "final_equity": c("net_profit") + F.lit(float(amount)),
            "avg_win_pct": F.coalesce(F.try_divide(c("win_pct"), c("wins")), zero),
            "best_roi_pct": F.coalesce("best", zero),
            "exit_reason_count": F.coalesce("exit_reason_count", F.create_map().cast(_COUNTS)),
        }
    )
    out = out.withColumn(
        "avg_loss_pct", F.coalesce(F.try_divide(c("loss_pct"), c("losses")), zero)
    )
    ratio = F.when(c("avg_loss_pct") < 0, F.abs(c("avg_win_pct") / c("avg_loss_pct")))
    return out.withColumn("risk_reward", ratio).select(*SUMMARY_COLUMNS)


def overall_summary(summary: DataFrame, amount: float) -> DataFrame:
    """Totals per strategy; win rate and holding time are plain means over symbols."""
    return summary.groupBy("strategy").agg(
        F.sum("total_trades").alias("total_trades"),
        F.avg("winrate").alias("avg_winrate"),
        F.avg("avg_holding_days").alias("avg_holding_days"),
        F.sum("net_profit").alias("net_profit"),
        (F.sum("net_profit") + F.lit(float(amount))).alias("final_equity"),
    )


def exit_reason_totals(summary: DataFrame) -> DataFrame:
    return (
        summary.select("strategy", F.explode("exit_reason_count").alias("exit_reason", "n"))
        .groupBy("strategy", "exit_reason")
        .agg(F.sum("n").alias("n"))
    )
