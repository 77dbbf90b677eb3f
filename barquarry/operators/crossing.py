"""First exits of positions by crossing indexes, for all signal bars of a series at once.

Levels that are fixed at the entry (target, fixed stop, stop rules on the entry price alone) are searched in maxima
of highs and minima of lows over 2^k bars: a search skips the longest stretch that is proven not to reach
the level, then shorter ones, so a hold of n bars takes log n steps. Levels that move (trailing stop, stop
rules on the bar under test) are followed bar by bar, only for positions still open and no further
than the fixed levels allow.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

Rule = Callable[[dict[str, np.ndarray]], np.ndarray]
NONE = np.iinfo(np.int64).max


class Extremes:
    """Maxima of ``values`` over [t, t + 2^k), for k up to the longest search."""

    def __init__(self, values: np.ndarray, longest: int) -> None:
        self.rows = [values]
        while 2 << len(self.rows) - 1 <= min(longest, len(values)):
            last, half = self.rows[-1], 1 << len(self.rows) - 1
            self.rows.append(np.maximum(last[:-half], last[half:]))

    def first_reaching(self, level: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """For each search the first t in [start, end] with values[t] >= level, or NONE."""
        at = start.copy()
        for k in range(len(self.rows) - 1, -1, -1):
            row, step = self.rows[k], 1 << k
            inside = at + step <= end + 1
            skip = inside & ~(row[np.minimum(at, len(row) - 1)] >= level)
            at = np.where(skip, at + step, at)
        return np.where((at <= end) & (self.rows[0][np.minimum(at, len(self.rows[0]) - 1)] >= level), at, NONE)

    def greatest(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Maximum over [start, end]; ranges are not empty and no longer than the longest search."""
        k = np.frexp((end - start + 1).astype(np.float64))[1] - 1
        out = np.empty(len(start))
        for level in np.unique(k):
            own = k == level
            row = self.rows[level]
            out[own] = np.maximum(row[start[own]], row[end[own] + 1 - (1 << level)])
        return out


def first_exits(
    bars: dict[str, np.ndarray],
    usable: np.ndarray,
    entries: np.ndarray,
    target: np.ndarray,
    stops: Sequence[tuple[Rule, bool]],
    trailing: float | None,
    hold: int,
    last: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(bar, price, reason) of the first exit of each of ``entries``; bar is NONE where the data ends first.

    ``bars`` are the columns of a series in order, ``usable`` marks bars on which an exit may be. ``stops`` are
    rules in order of their levels, each with whether it names nothing but the entry price. Where ``bars`` are of several series,
    one after the other, ``last`` has for each entry the last bar of its series.
    """
    high, low, close = bars["HIGH"], bars["LOW"], bars["CLOSE"]
    n, count = len(close), len(entries)
    price = close[entries]
    own = {"ENTRY_PRICE": price}
    last = np.full(count, n - 1) if last is None else last
    start, end = entries + 1, np.minimum(entries + hold, last)
    highs = Extremes(np.where(usable, high, -np.inf), hold)
    lows = Extremes(np.where(usable, -low, -np.inf), hold)
    target = np.where(np.isnan(target), np.inf, target)
    first = highs.first_reaching(target, start, end)
    due = entries + hold
    first = np.where((due <= last) & usable[np.minimum(due, n - 1)], np.minimum(first, due), first)
    frozen = [np.broadcast_to(rule(own), (count,)).astype(float) if fixed else None for rule, fixed in stops]
    for level in frozen:
        if level is not None:
            first = np.minimum(first, lows.first_reaching(np.where(np.isnan(level), np.inf, -level), start, end))
    moving = [(k, rule) for k, (rule, fixed) in enumerate(stops) if not fixed]
    if moving or trailing is not None:
        open_, peak, step = np.arange(count), price.copy(), 1
        while len(open_):
            at = entries[open_] + step
            open_ = open_[at <= np.minimum(first[open_], end[open_])]
            at = entries[open_] + step
            peak[open_] = np.maximum(peak[open_], high[at])
            hit = np.zeros(len(open_), dtype=bool)
            if trailing is not None:
                hit |= low[at] <= peak[open_] * (1.0 - trailing)
            here = {name: column[at] for name, column in bars.items()} | {"ENTRY_PRICE": price[open_]}
            for _, rule in moving:
                hit |= low[at] <= rule(here)
            hit &= usable[at]
            first[open_[hit]] = at[hit]
            open_ = open_[~hit]
            step += 1
    done = np.flatnonzero(first != NONE)
    at = first[done]
    here = {name: column[at] for name, column in bars.items()} | {"ENTRY_PRICE": price[done]}
    paid, reason = np.full(count, np.nan), np.full(count, "", dtype=object)
    undecided = np.ones(len(done), dtype=bool)

    def settle(hit: np.ndarray, level: np.ndarray, why: str) -> None:
        hit = hit & undecided
        paid[done[hit]], reason[done[hit]] = np.broadcast_to(level, hit.shape)[hit], why
        undecided[hit] = False

    if trailing is not None and len(done):
        peaks = np.maximum(price[done], Extremes(high, hold).greatest(entries[done] + 1, at))
        settle(low[at] <= peaks * (1.0 - trailing), peaks * (1.0 - trailing), "Trailing Stop Hit")
    for k, (rule, fixed) in enumerate(stops):
        level = frozen[k][done] if fixed else np.broadcast_to(rule(here), at.shape)
        settle(low[at] <= level, level, f"SL Hit (Level {k + 1})")
    settle(high[at] >= target[done], target[done], "TP Hit")
    settle(at - entries[done] >= hold, close[at], "MaxHold Exit")
    return first, paid, reason.tolist()
