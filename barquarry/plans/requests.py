"""Whole requests: bars in, scan rows or trades and summaries out."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barquarry.operators.fundamentals import FUNDAMENTAL_COLUMNS, add_fundamentals
from barquarry.operators.indicators import add_technical
from barquarry.operators.layout import Layout
from barquarry.operators.position_fold import bounded_fold_trades, fold_trades
from barquarry.operators.scan import scan, scan_rows
from barquarry.operators.strategy import Strategy, columns_of
from barquarry.operators.summary import symbol_summary
from barquarry.operators.trades import TRADE_COLUMNS, frame_trades, in_range, marked_symbols
from barquarry.sources.bars import restrict, split_duplicates, split_rejects

# Bars a family of indicators needs, by a mark in the rule text.
_FAMILY_ROWS = {
    "ATR14": 14,
    "RSI14": 14,
    "BB_": 20,
    "MACD": 26,
    "STOCH": 14,
    "FIB_": 50,
    "PERCENT_SPIKE": 30,
    "HIGH_VOL_DAYS": 30,
}
# The marked families above, the pattern below, and months read for a longest window of up to so many bars.
_MONTHS = ((30, 3), (100, 6), (200, 12))
_DEFAULT_MONTHS = 24
_NUMBERED = re.compile(r"(?:MA|VMA|HH|LL)(\d+)")


def lookback_months(strategies: Sequence[Strategy]) -> int:
    """Months of history that the longest window in the rules calls for."""
    rules = [r for s in strategies for r in (*s.entry, *s.tp, *s.sl)]
    rows = [int(n) for r in rules for n in _NUMBERED.findall(r)]
    rows += [n for r in rules for mark, n in _FAMILY_ROWS.items() if mark in r]
    longest = max(rows, default=0)
    if longest == 0:
        return _DEFAULT_MONTHS
    return next((months for limit, months in _MONTHS if longest <= limit), _DEFAULT_MONTHS)


def recent_bars(bars: DataFrame, strategies: Sequence[Strategy], as_of: str) -> DataFrame:
    """Bars of the look-back period before ``as_of``. The filter reaches the bar files."""
    first = F.add_months(F.lit(as_of).cast("date"), -lookback_months(strategies))
    return bars.where(F.col("date") >= first)


def requested_bars(
    bars: DataFrame,
    strategies: Sequence[Strategy],
    *,
    symbols: DataFrame | Sequence[str] | None = None,
    as_of: str | None = None,
    complete: bool = False,
) -> DataFrame:
    """The bars a request works on: of the asked symbols, in the look-back period, and usable.

    Bars with a missing or non-positive price are left out (``split_rejects`` names them), equal bars of one symbol
    and date are made one and contradicting ones left out (``split_duplicates``), unless the
    caller promises that there are none of these.
    """
    bars = restrict(bars, symbols=symbols)
    if as_of is not None:
        bars = recent_bars(bars, strategies, as_of)
    return bars if complete else split_duplicates(split_rejects(bars)[0])[0]


def indicator_frame(
    bars: DataFrame,
    columns: Sequence[str],
    layout: Layout,
    *,
    snapshots: DataFrame | None = None,
    as_of: str | None = None,
    decimals: int | None = None,
    warmup: str = "zero",
    complete: bool = False,
    latest: bool = False,
) -> DataFrame:
    """Bars with just the columns some rules need, technical and fundamental; ``latest`` as in ``add_technical``."""
    technical = [n for n in columns if n not in FUNDAMENTAL_COLUMNS]
    frame = add_technical(bars, layout, technical, warmup=warmup, complete=complete, decimals=decimals, latest=latest)
    if len(technical) < len(columns):
        if snapshots is None:
            raise ValueError("rules name fundamental columns but no snapshots are given")
        # A join may move rows.
        frame = add_fundamentals(bars, frame.drop("_ends"), snapshots, layout, as_of)
    return frame


def scan_request(
    bars: DataFrame,
    strategies: Sequence[Strategy],
    compliance: DataFrame,
    layout: Layout,
    *,
    amount: float = 1_000_000.0,
    snapshots: DataFrame | None = None,
    symbols: DataFrame | Sequence[str] | None = None,
    as_of: str | None = None,
    decimals: int | None = None,
    complete: bool = False,
) -> DataFrame:
    """Scan rows. ``as_of`` sets the look-back period and which snapshots are fresh."""
    bars = requested_bars(bars, strategies, symbols=symbols, as_of=as_of, complete=complete)
    frame = indicator_frame(
        bars,
        columns_of(strategies),
        layout,
        snapshots=snapshots,
        as_of=as_of,
        decimals=decimals,
        complete=True,
        latest=True,
    )
    return scan_rows(scan(frame, strategies, layout), compliance, amount)


def extract_trades(
    frame: DataFrame, strategies: Sequence[Strategy], amount: float, layout: Layout, marks: bool = False
) -> DataFrame:
    """Trades of any mix of strategies over one shared indicator frame with ``_in``.

    ``marks`` adds a row without a strategy for each symbol that has bars.
    """
    plain = [s for s in strategies if not s.needs_fold]
    folded = [s for s in strategies if s.needs_fold]
    parts = []
    if plain:
        parts.append(frame_trades(frame, plain, amount, layout, marks))
    elif marks:
        parts.append(marked_symbols(frame, layout))
    if folded and layout.blocked:
        bounded = [s for s in folded if not s.partial_tp]
        endless = [s for s in folded if s.partial_tp]
        if bounded:
            parts.append(bounded_fold_trades(frame, bounded, amount, layout))
        if endless:
            parts.append(fold_trades(frame, endless, amount, layout))
    elif folded:
        parts.append(fold_trades(frame, folded, amount, layout))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.select(*TRADE_COLUMNS)


def backtest_request(
    bars: DataFrame,
    strategies: Sequence[Strategy],
    layout: Layout,
    *,
    amount: float = 1_000_000.0,
    period: str | None = None,
    start: str | None = None,
    end: str | None = None,
    snapshots: DataFrame | None = None,
    symbols: DataFrame | Sequence[str] | None = None,
    as_of: str | None = None,
    decimals: int | None = None,
    complete: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(trades, per-symbol summary). Symbols with bars but no trades are in the summary.

    ``as_of`` sets the look-back period and which snapshots are fresh.
    """
    bars = requested_bars(bars, strategies, symbols=symbols, as_of=as_of, complete=complete)
    frame = indicator_frame(
        bars,
        columns_of(strategies),
        layout,
        snapshots=snapshots,
        as_of=as_of,
        decimals=decimals,
        complete=True,
    )
    ranged = in_range(frame, layout, period=period, start=start, end=end)
    # The symbols come out of the pass that finds the trades, so the bars are read once.
    rows = extract_trades(ranged, strategies, amount, layout, marks=True)
    names = [s.name for s in strategies]
    return rows.where(F.col("strategy").isNotNull()), symbol_summary(rows, amount, names=names)
