"""First exits by crossing indexes, and overlap removal by pointers, against plain loops."""

import numpy as np
import pytest

from barquarry.operators.crossing import NONE, Extremes, first_exits
from barquarry.operators.rules import arithmetic
from barquarry.operators.trades import NEVER, chain_from, free_after


def test_first_reaching_and_greatest():
    r = np.random.default_rng(1)
    values = r.integers(0, 50, 300).astype(float)
    index = Extremes(values, 70)
    for _ in range(500):
        a = int(r.integers(300))
        b = min(299, a + int(r.integers(70)))
        level = float(r.integers(0, 60))
        want = next((t for t in range(a, b + 1) if values[t] >= level), NONE)
        assert index.first_reaching(np.array([level]), np.array([a]), np.array([b]))[0] == want
        assert index.greatest(np.array([a]), np.array([b]))[0] == values[a : b + 1].max()
    empty = index.first_reaching(np.array([0.0]), np.array([5]), np.array([4]))
    assert empty[0] == NONE


def plain_exit(bars, usable, e, target, stops, trailing, hold):
    price = bars["CLOSE"][e]
    peak = price
    for t in range(e + 1, min(e + hold, len(usable) - 1) + 1):
        peak = max(peak, bars["HIGH"][t])
        if not usable[t]:
            continue
        if trailing is not None and bars["LOW"][t] <= peak * (1.0 - trailing):
            return t, peak * (1.0 - trailing), "Trailing Stop Hit"
        here = {n: np.array([v[t]]) for n, v in bars.items()} | {"ENTRY_PRICE": np.array([price])}
        for k, rule in enumerate(stops):
            level = float(np.broadcast_to(rule(here), (1,))[0])
            if bars["LOW"][t] <= level:
                return t, level, f"SL Hit (Level {k + 1})"
        if bars["HIGH"][t] >= target:
            return t, target, "TP Hit"
        if t - e >= hold:
            return t, bars["CLOSE"][t], "MaxHold Exit"
    return None


@pytest.mark.parametrize("trailing", [None, 0.06])
@pytest.mark.parametrize("rules", [[], ["ENTRY_PRICE * 0.93"], ["ENTRY_PRICE - ATR14 * 2", "LEAST(MA20, ENTRY_PRICE / 0.9) * 0.95"]])
@pytest.mark.parametrize("hold", [1, 33, 90])
def test_first_exits(trailing, rules, hold):
    r = np.random.default_rng(hold)
    n = 400
    close = 100 * np.exp(np.cumsum(r.normal(0, 0.01, n)))
    bars = {"CLOSE": close, "HIGH": close * 1.01, "LOW": close * 0.99, "ATR14": r.uniform(1, 5, n), "MA20": close * r.uniform(0.8, 1.0, n)}
    bars["MA20"][r.integers(0, n, 30)] = np.nan
    usable = r.random(n) < 0.9
    entries = np.flatnonzero(r.random(n) < 0.5)
    target = close[entries] * 1.08
    target[::17] = np.nan
    found = [arithmetic(rule) for rule in rules]
    stops = [(f, names <= {"ENTRY_PRICE"}) for f, names in found]
    at, price, reason = first_exits(bars, usable, entries, target, stops, trailing, hold)
    for k, e in enumerate(entries):
        want = plain_exit(bars, usable, e, target[k], [f for f, _ in stops], trailing, hold)
        got = None if at[k] == NONE else (at[k], price[k], reason[k])
        assert got == want


def test_no_bars_and_no_entries():
    bars = {n: np.array([]) for n in ("CLOSE", "HIGH", "LOW")}
    at, price, reason = first_exits(bars, np.array([], bool), np.array([], int), np.array([]), [], None, 40)
    assert len(at) == len(price) == len(reason) == 0
    bars = {n: np.array([1.0]) for n in ("CLOSE", "HIGH", "LOW")}
    at, _, _ = first_exits(bars, np.array([True]), np.array([0]), np.array([0.5]), [], 0.5, 40)
    assert at.tolist() == [NONE]


def test_arithmetic_rules():
    f, names = arithmetic("entry_price - abs(ATR14 * -2) / (CLOSE - 1)")
    assert names == {"ENTRY_PRICE", "ATR14", "CLOSE"}
    values = {"ENTRY_PRICE": np.array([10.0, 10.0]), "ATR14": np.array([3.0, 3.0]), "CLOSE": np.array([3.0, 1.0])}
    got = f(values)
    assert got[0] == 7.0 and np.isnan(got[1])  # nothing is divided by zero: null
    for other in ("CASE WHEN CLOSE > 1 THEN 1 ELSE 2 END", "CLOSE > 1", "SQRT(CLOSE)", "0.1 + 0.2", "CLOSE * (0.1 + 0.2)", "ROUND(CLOSE, 2)"):
        assert arithmetic(other) is None
    with pytest.raises(ValueError):
        arithmetic("UNKNOWN * 2")
    assert arithmetic("CLOSE.__class__") is None


def test_pointers_follow_the_greedy_chain():
    r = np.random.default_rng(4)
    for n in (0, 1, 2, 50, 1000):
        entry = np.sort(r.choice(5 * n + 1, n, replace=False)).astype(np.int64)
        free = entry + r.integers(1, 40, n)
        free[r.random(n) < 0.02] = NEVER
        for start in (0, 7, 100):
            taken, at = [], start
            for k in range(n):
                if entry[k] >= at:
                    taken.append(k)
                    at = free[k]
            assert chain_from(entry, free, start) == taken
            if taken:
                assert free_after(entry, free)[taken[0]] == at
