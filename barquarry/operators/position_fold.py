"""Positions that change while open: partial exits, averaging, long holds.

Catalyst computes every level beforehand as a pair (a, b) with level = a * average entry + b,
so the Python part sees numbers only. Two forms share one step function:

* ``fold_trades`` streams each series once, in date order, through Arrow batches. A task keeps
  one open position per strategy and one batch, whatever the length of the series.
* ``candidate_exits`` (block layouts, strategies that always leave within max_hold bars) plays
  every signal bar of a block by itself; overlaps are then removed as for all other trades.

A strategy with partial exits has no bound on how long a position stays open, so its series
can only be followed from the start: that one series is sequential, in constant memory.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barquarry.functions.scalars import days_held
from barquarry.operators.layout import Layout
from barquarry.operators.rules import affine_in_entry
from barquarry.operators.strategy import Strategy
from barquarry.operators.trades import TRADE_COLUMNS, entry_columns

RESIDUE = 1e-9  # a position with less than this share of its first size left is closed
RESTOP_ATR = 1.5


@dataclass(frozen=True)
class Shape:
    """What the step function needs to know of a strategy."""

    name: str
    index: int
    stops: int
    ratios: tuple[float, ...]
    downs: int
    ups: int
    sized: bool
    hold: int
    trailing: float | None

    @classmethod
    def of(cls, s: Strategy, index: int) -> Shape:
        return cls(
            name=s.name,
            index=index,
            stops=len(s.sl),
            ratios=s.partial_ratios,
            downs=len(s.avg_down),
            ups=len(s.avg_up),
            sized=bool(s.amount),
            hold=s.max_hold,
            trailing=s.trailing,
        )


@dataclass
class Position:
    entry_date: object
    entry: float
    stop: float
    target: float
    qty: float
    first_qty: float
    peak: float
    bars: int = 0
    downs: int = 0
    ups: int = 0
    taken: set[int] = field(default_factory=set)


def level_columns(strategies: Sequence[Strategy], amount: float) -> dict[str, Column]:
    cols: dict[str, Column] = {}
    for i, s in enumerate(strategies):
        groups = {"sl": s.sl, "pt": s.partial_tp, "dn": s.avg_down, "up": s.avg_up}
        for kind, rules in groups.items():
            for n, rule in enumerate(rules):
                cols[f"_{kind}{i}_{n}a"], cols[f"_{kind}{i}_{n}b"] = affine_in_entry(rule)
        if s.amount:
            cols[f"_sz{i}_0a"], cols[f"_sz{i}_0b"] = affine_in_entry(s.amount, amount)
    return cols


class Bars:
    """Plain lists of one run of bars, for fast element access."""

    def __init__(self, pdf: pd.DataFrame) -> None:
        self.columns = {
            n: pdf[n].to_numpy(dtype=float).tolist()
            for n in pdf.columns
            if n not in ("symbol", "date", "_block", "_own", "_rn")
        }
        self.dates = pdf["date"].tolist()
        self.rows = pdf["_rn"].tolist()

    def level(self, kind: str, i: int, n: int, at: int, entry: float) -> float:
        a = self.columns[f"_{kind}{i}_{n}a"][at]
        b = self.columns[f"_{kind}{i}_{n}b"][at]
        return b if a == 0.0 else a * entry + b


def open_position(shape: Shape, bars: Bars, at: int) -> Position:
    i, col = shape.index, bars.columns
    price, qty = col["CLOSE"][at], col[f"_qty{i}"][at]
    return Position(
        entry_date=bars.dates[at],
        entry=price,
        stop=col[f"_stop{i}"][at],
        target=col[f"_target{i}"][at],
        qty=qty,
        first_qty=qty,
        peak=price,
    )


def _exit_row(shape: Shape, p: Position, bars: Bars, at: int, price: float, qty: float, why: str):
    return (
        shape.name, p.entry_date, bars.dates[at], p.entry, price, (price - p.entry) * qty,
        (price / p.entry - 1) * 100, why, p.stop, p.target,
    )


def _average(shape: Shape, p: Position, bars: Bars, at: int, down: bool) -> None:
    i, close = shape.index, bars.columns["CLOSE"][at]
    kind, limit = ("dn", shape.downs) if down else ("up", shape.ups)
    for n in range(limit):
        if (p.downs if down else p.ups) >= limit:
            return
        level = bars.level(kind, i, n, at, p.entry)
        if not (close <= level if down else close >= level):
            continue
        more = p.first_qty
        if shape.sized:
            money = bars.level("sz", i, 0, at, p.entry)
            if np.isfinite(money):
                more = float(np.floor(money / close))
        total = p.qty + more
        p.entry = (p.entry * p.qty + close * more) / total
        p.qty = total
        if down:
            p.downs += 1
            p.stop = p.entry - bars.columns["ATR14"][at] * RESTOP_ATR
        else:
            p.ups += 1


def step(shape: Shape, p: Position, bars: Bars, at: int) -> tuple[list[tuple], bool]:
    """One bar of an open position: (exit rows, still open)."""
    i, col = shape.index, bars.columns
    high, low = col["HIGH"][at], col["LOW"][at]
    rows: list[tuple] = []
    p.bars += 1
    if shape.trailing is not None:
        p.peak = max(p.peak, high)

    for n, ratio in enumerate(shape.ratios):
        level = bars.level("pt", i, n, at, p.entry)
        if n in p.taken or not high >= level:
            continue
        qty = p.first_qty * ratio
        p.qty -= qty
        p.taken.add(n)
        rows.append(_exit_row(shape, p, bars, at, level, qty, f"Partial TP {n + 1}"))
        if p.qty <= RESIDUE * p.first_qty:
            return rows, False

    _average(shape, p, bars, at, down=True)
    _average(shape, p, bars, at, down=False)
    if shape.ratios:
        return rows, True

    price, why = None, ""
    if shape.trailing is not None and low <= p.peak * (1 - shape.trailing):
        price, why = p.peak * (1 - shape.trailing), "Trailing Stop Hit"
    for n in range(shape.stops if price is None else 0):
        level = bars.level("sl", i, n, at, p.entry)
        if low <= level:
            price, why = level, f"SL Hit (Level {n + 1})"
            break
    if price is None and high >= p.target:
        price, why = p.target, "TP Hit"
    if price is None and p.bars >= shape.hold:
        price, why = col["CLOSE"][at], "MaxHold Exit"
    if price is None:
        return rows, True
    rows.append(_exit_row(shape, p, bars, at, price, p.qty, why))
    return rows, False


_RAW = [
    "strategy", "entry_date", "close_date", "entry_price", "exit_price", "pnl", "roi_pct",
    "exit_reason", "stop_loss", "take_profit",
]


def _raw_schema(date_type: str) -> str:
    return (
        f"strategy string, entry_date {date_type}, close_date {date_type}, entry_price double, "
        "exit_price double, pnl double, roi_pct double, exit_reason string, stop_loss double, "
        "take_profit double"
    )


def _inputs(frame: DataFrame, strategies: Sequence[Strategy], amount: float, layout: Layout):
    cols = {**entry_columns(strategies, amount), **level_columns(strategies, amount)}
    wide = frame.withColumns(cols)
    extra = ["ATR14"] if any(s.avg_down for s in strategies) else []
    return wide.select(
        *layout.keys,
        "date",
        "_rn",
        "HIGH",
        "LOW",
        "CLOSE",
        *extra,
        F.col("_in").cast("double").alias("_inside"),
        *(["_own"] if layout.blocked else []),
        *cols,
    )


def _follow(shape: Shape, p: Position | None, bars: Bars) -> tuple[list[tuple], Position | None]:
    """Run one strategy over consecutive bars, starting flat or in a position."""
    rows: list[tuple] = []
    inside = bars.columns["_inside"]
    entries = np.flatnonzero(~np.isnan(bars.columns[f"_qty{shape.index}"]))
    at, end = 0, len(bars.dates)
    while at < end:
        if p is None:
            nxt = np.searchsorted(entries, at)
            if nxt == len(entries):
                break
            at = int(entries[nxt])
            p = open_position(shape, bars, at)
        elif inside[at]:
            done, still_open = step(shape, p, bars, at)
            rows.extend(done)
            if not still_open:
                p = None
        at += 1
    return rows, p


def fold_trades(
    frame: DataFrame, strategies: Sequence[Strategy], amount: float, layout: Layout
) -> DataFrame:
    """Trades by streaming every series in date order. ``frame`` has indicators and ``_in``."""
    shapes = [Shape.of(s, i) for i, s in enumerate(strategies)]
    data = _inputs(frame, strategies, amount, layout)
    if layout.blocked:
        data = data.where("_own").drop("_own", "_block")
    ordered = data.repartition("symbol").sortWithinPartitions("symbol", "_rn")
    columns = ["symbol", *_RAW]

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current: object = None
        state: dict[str, Position | None] = {}
        for batch in batches:
            if batch.empty:
                continue
            symbols = batch["symbol"].to_numpy()
            cuts = np.flatnonzero(symbols[1:] != symbols[:-1]) + 1
            out: list[tuple] = []
            for a, b in zip([0, *cuts], [*cuts, len(batch)]):
                symbol = symbols[a]
                if symbol != current:
                    current, state = symbol, {}
                bars = Bars(batch.iloc[a:b])
                for shape in shapes:
                    rows, state[shape.name] = _follow(shape, state.get(shape.name), bars)
                    out.extend((symbol, *r) for r in rows)
            if out:
                yield pd.DataFrame(out, columns=columns)

    schema = "symbol string, " + _raw_schema(dict(frame.dtypes)["date"])
    raw = ordered.mapInPandas(stream, schema)
    return raw.withColumn("hold_period", days_held(F.col("entry_date"), F.col("close_date"))).select(
        *TRADE_COLUMNS
    )


def candidate_exits(
    frame: DataFrame, strategies: Sequence[Strategy], amount: float, layout: Layout
) -> DataFrame:
    """Per signal bar of a block: the trade it would become. Same shape as window candidates."""
    if any(s.partial_tp for s in strategies):
        raise ValueError("a position with partial exits has no longest holding time")
    shapes = [Shape.of(s, i) for i, s in enumerate(strategies)]
    data = _inputs(frame, strategies, amount, layout)
    keys = list(layout.keys)
    columns = [*keys, "entry_rn", "exit_rn", "qty", "first_price", *_RAW]

    def play(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_rn", ignore_index=True)
        bars = Bars(pdf)
        own = pdf["_own"].to_numpy() if layout.blocked else np.ones(len(pdf), dtype=bool)
        inside = bars.columns["_inside"]
        out: list[tuple] = []
        for shape in shapes:
            entries = np.flatnonzero(~np.isnan(bars.columns[f"_qty{shape.index}"]) & own)
            for at in entries.tolist():
                p = open_position(shape, bars, at)
                first = (p.entry, p.qty)
                nxt, rows = at + 1, []
                while nxt < len(pdf) and not rows:
                    if inside[nxt]:
                        rows, _ = step(shape, p, bars, nxt)
                    nxt += 1
                row = rows[0] if rows else (
                    shape.name, p.entry_date, None, first[0], None, None, None, None, None, None
                )
                exit_rn = bars.rows[nxt - 1] if rows else None
                out.append((*key, bars.rows[at], exit_rn, first[1], first[0], *row))
        return pd.DataFrame(out, columns=columns)

    kinds = dict(frame.dtypes)
    schema = (
        ", ".join(f"{k} {kinds[k]}" for k in keys)
        + ", entry_rn bigint, exit_rn bigint, qty double, first_price double, "
        + _raw_schema(kinds["date"])
    )
    return data.groupBy(*keys).applyInPandas(play, schema)


def bounded_fold_trades(
    frame: DataFrame, strategies: Sequence[Strategy], amount: float, layout: Layout
) -> DataFrame:
    """Trades of strategies that always leave within max_hold bars, for long series."""
    from barquarry.operators.trades import non_overlapping

    hold = max(1, *(s.max_hold for s in strategies))
    if layout.blocked and layout.lookahead < hold:
        raise ValueError(f"layout lookahead must be at least {hold}")
    played = candidate_exits(frame, strategies, amount, layout)
    candidates = played.withColumn(
        "exit", F.when(F.col("exit_rn").isNotNull(), F.struct(F.col("exit_rn").alias("rn")))
    ).drop("exit_rn", "first_price", "qty")
    kept = non_overlapping(candidates, layout, hold).where(F.col("exit").isNotNull())
    return kept.withColumn(
        "hold_period", days_held(F.col("entry_date"), F.col("close_date"))
    ).select(*TRADE_COLUMNS)
