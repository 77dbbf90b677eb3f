"""Technical indicator columns over a bar table.

``add_technical`` takes bars (symbol, date, open, high, low, close, volume) and adds the asked
columns with what they depend on; nothing else is planned. Columns are declared in stages:
the windows of one stage share a single sort, and a stage may use the columns of earlier ones.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, replace
from functools import lru_cache, reduce
from operator import add

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barquarry.functions.rolling import LARGE_ROWS, LONGEST_PARTED, Rolling, extreme_parts, sum_parts
from barquarry.functions.scalars import flag, nz
from barquarry.operators import bar_arrays
from barquarry.operators.bar_arrays import FIRST_FULL_DX, WILDER_DECAY, WILDER_ROWS, ema_step
from barquarry.operators.layout import SHORTEST_LOOKBACK, Layout
from barquarry.operators.recurrence import decayed_sums
from barquarry.session import computed_once

# Names of the 61 technical columns.
RAW_COLUMNS = ["OPEN", "HIGH", "LOW", "CLOSE", "PRICE", "VOLUME"]
RETURN_LAGS = [1, 7, 30, 50, 100]
MEAN_WINDOWS = [5, 10, 20, 50, 100, 200]
VOLUME_MEAN_WINDOWS = [5, 10, 20]
RANGE_WINDOWS = [3, 20]
CANDLE_FLAGS = [
    "THREE_RED_CANDLES",
    "THREE_GREEN_CANDLES",
    "DOJI",
    "HAMMER",
    "HANGING_MAN",
    "SHOOTING_STAR",
    "MORNING_STAR",
    "EVENING_STAR",
]
FIBONACCI = {"FIB_236": 0.236, "FIB_382": 0.382, "FIB_50": 0.5, "FIB_618": 0.618}
TECHNICAL_COLUMNS = [
    *RAW_COLUMNS,
    "PREVIOUS_PRICE",
    *[f"PRICE_RETURN_{n}D_PCT" for n in RETURN_LAGS],
    "PERCENT_SPIKE",
    "VOLUME_SPIKE",
    "RVOL",
    *[f"MA{n}" for n in MEAN_WINDOWS],
    *[f"VMA{n}" for n in VOLUME_MEAN_WINDOWS],
    "ATR14",
    "BB_MIDDLE",
    "BB_UPPER",
    "BB_LOWER",
    "BB_WIDTH",
    "BB_PERCENT_B",
    "RSI14",
    "MACD_LINE",
    "MACD_SIGNAL",
    "MACD_HISTOGRAM",
    "STOCH_K",
    "STOCH_D",
    *[f"{side}{n}" for n in RANGE_WINDOWS for side in ("HH", "LL")],
    *FIBONACCI,
    "SUPPORT",
    "RESISTANCE",
    "VWMA",
    "VWAP",
    *CANDLE_FLAGS,
    "ADX14",
    "ADX_PLUS",
    "ADX_MINUS",
    "TRADE_FREQUENCY",
    "HIGH_VOL_DAYS",
]

# From so many columns on, bars of short series are worked in arrays too; fewer are windows, which need no Python.
ARRAY_COLUMNS = 30

# Columns that can lose their value in mid-series although every bar is complete: quotients
# whose divisor can be zero.
MAY_LAPSE = {
    *[f"PRICE_RETURN_{n}D_PCT" for n in RETURN_LAGS],
    "VOLUME_SPIKE",
    "RVOL",
    "TRADE_FREQUENCY",
    "VWMA",
    "VWAP",
    "BB_PERCENT_B",
    "RSI14",
    "STOCH_K",
    "STOCH_D",
    "ADX14",
    "ADX_PLUS",
    "ADX_MINUS",
}

c = F.col


@dataclass(frozen=True)
class Derived:
    """One derived column: its stage, the derived columns it reads, and its expression."""

    stage: int
    needs: tuple[str, ...]
    build: Callable[[Rolling], Column]


# Inputs of rolling sums: stage of the value, the derived column it needs, and the value.
_INPUTS = {
    "CLOSE": (0, (), lambda: c("CLOSE")),
    "VOLUME": (0, (), lambda: c("VOLUME")),
    "HIGH": (0, (), lambda: c("HIGH")),
    "LOW": (0, (), lambda: c("LOW")),
    "BODY": (0, ("_BODY",), lambda: c("_BODY")),
    "MONEY": (0, ("_MONEY",), lambda: c("_MONEY")),
    "TR": (1, ("_TR",), lambda: c("_TR")),
    "GAIN": (1, ("_GAIN",), lambda: c("_GAIN")),
    "LOSS": (1, ("_LOSS",), lambda: c("_LOSS")),
    "STOCH": (2, ("STOCH_K",), lambda: c("STOCH_K")),
}
_ROLLING_NAME = re.compile(r"^_(RUN|SUM|TOP|BOTTOM)(\d*)_([A-Z]+)$")
_RUNNING_NAME = re.compile(r"^_(HEAD|TAIL)_(SUM|TOP|BOTTOM)(\d+)_([A-Z]+)$")
_WINDOWED_NAME = re.compile(r"^(VMA|MA|HH|LL)([1-9]\d*)$")
_EXPONENTIAL_NAME = re.compile(r"^_?EMA([1-9]\d*)$")
_EXPONENTIAL_INPUT = re.compile(r"^_IN_EMA([1-9]\d*)$")
_RETURN_NAME = re.compile(r"^PRICE_RETURN_(\d+)D_PCT$")
_OVER = {"SUM": F.sum, "TOP": F.max, "BOTTOM": F.min}


def _rolling_column(kind: str, n: int, source: str) -> Derived:
    """Helper columns: _RUN_x, and _SUMn_x / _TOPn_x / _BOTTOMn_x without a null guard."""
    stage, source_columns, value = _INPUTS[source]
    if kind == "RUN":
        return Derived(stage + 1, source_columns, lambda r: r.run_length(value()))
    if n > LONGEST_PARTED:
        return _long_column(kind, n, source)
    parts = sum_parts(n) if kind == "SUM" else extreme_parts(n)
    if parts == [(n, 0)]:
        return Derived(stage + 1, source_columns, lambda r: _OVER[kind](value()).over(r.trailing(n)))
    needs = tuple(dict.fromkeys(f"_{kind}{size}_{source}" for size, _ in parts))
    depth = 3 if n >= 2 * LARGE_ROWS else 2

    def build(r: Rolling) -> Column:
        pieces = [r.lag(c(f"_{kind}{size}_{source}"), at) for size, at in parts]
        if kind == "SUM":
            return reduce(add, pieces)
        return F.greatest(*pieces) if kind == "TOP" else F.least(*pieces)

    return Derived(stage + depth, needs, build)


def _long_column(kind: str, n: int, source: str) -> Derived:
    """A frame of n rows is the tail of one stretch of n rows and the head of the next (van Herk, Gil and Werman)."""
    head, tail = f"_HEAD_{kind}{n}_{source}", f"_TAIL_{kind}{n}_{source}"

    def build(r: Rolling) -> Column:
        before = r.lag(c(tail), n - 1)
        if kind == "SUM":
            # At the end of a stretch head and tail are the same rows.
            return F.when((c("_rn") + 1) % n == 0, c(head)).otherwise(before + c(head))
        return F.greatest(before, c(head)) if kind == "TOP" else F.least(before, c(head))

    return Derived(_INPUTS[source][0] + 2, (head, tail), build)


def _running_column(side: str, kind: str, n: int, source: str) -> Derived:
    stage, source_columns, value = _INPUTS[source]
    return Derived(stage + 1, source_columns, lambda r: _OVER[kind](value()).over(r.head(n) if side == "HEAD" else r.tail(n)))


def _rolled(kind: str, n: int, source: str) -> Derived:
    """A rolling value that is null unless all n inputs are present."""
    held = _rolling_column(kind, n, source)
    name, run = f"_{kind}{n}_{source}", f"_RUN_{source}"
    return Derived(held.stage, (name, run), lambda r: F.when(c(run) >= n, c(name)))


def _mean(n: int, source: str) -> Derived:
    total = _rolled("SUM", n, source)
    return Derived(total.stage, total.needs, lambda r: total.build(r) / float(n))


def _ratio_to_mean(n: int) -> Derived:
    mean = _mean(n, "VOLUME")
    return Derived(mean.stage, mean.needs, lambda r: c("VOLUME") / nz(mean.build(r)))


def _run_of_three(condition: Column) -> Callable[[Rolling], Column]:
    hit = F.coalesce(condition, F.lit(False)).cast("int")
    return lambda r: flag((c("_rn") >= 2) & (F.min(hit).over(r.trailing(3)) == 1))


def _ones(condition: Column) -> Column:
    return flag(condition).cast("double")


def _last_rows_of(total: str, n: int) -> Callable[[Rolling], Column]:
    """Rows counted in the last n, from a running count; whole numbers, so exact."""
    return lambda r: F.when(
        c("_rn") >= n - 1, c(total) - F.coalesce(r.lag(c(total), n), F.lit(0.0))
    )


def _ema_input(source: str, span: int) -> Callable[[Rolling], Column]:
    a = ema_step(span)
    absent = F.raise_error(F.lit(f"{source} is missing on a bar: reject such bars before averaging")).cast("double")

    def build(r: Rolling) -> Column:
        value = F.when(c(source).isNull(), absent).otherwise(c(source)) if source in RAW_COLUMNS else c(source)
        return F.when(c("_rn") == 0, value).otherwise(F.lit(a) * value)

    return build


def _wilder_input(source: str) -> Callable[[Rolling], Column]:
    """The first 14 values enter as their sum at row 13, later ones one by one."""
    last = WILDER_ROWS - 1
    return lambda r: (
        F.when(c("_rn") < last, F.lit(0.0))
        .when(c("_rn") == last, r.total(c(source)))
        .otherwise(c(source))
    )


def _star(first: Callable[[Column, Column], Column], now: Column) -> Callable[[Rolling], Column]:
    def build(r: Rolling) -> Column:
        two_back = first(r.lag(c("CLOSE"), 2), r.lag(c("OPEN"), 2))
        small_before = r.lag(c("_BODY")) < r.lag(c("_BODY10")) * 0.3
        return flag(two_back & small_before & now)

    return build


def _true_range(r: Rolling) -> Column:
    before = c("PREVIOUS_PRICE")
    return F.greatest(
        F.abs(c("HIGH") - c("LOW")), F.abs(c("HIGH") - before), F.abs(c("LOW") - before)
    )


def _clip_low(value: Column) -> Column:
    return F.when(value.isNotNull(), F.greatest(value, F.lit(0.0)))


def _when_wilder(value: Column) -> Column:
    enough = (c("_rn") >= WILDER_ROWS - 1) & (c("_SERIES_ROWS") >= 2 * WILDER_ROWS)
    return F.when(enough, value)


def _upper_shadow() -> Column:
    return c("HIGH") - F.greatest(c("CLOSE"), c("OPEN"))


def _lower_shadow() -> Column:
    return F.least(c("CLOSE"), c("OPEN")) - c("LOW")


def _shadow_flag(long_side: Callable[[], Column], short_side: Callable[[], Column]):
    return lambda r: flag(
        (long_side() >= c("_BODY") * 2)
        & (short_side() <= c("_BODY") * 0.5)
        & (c("_BODY") < (c("HIGH") - c("LOW")) * 0.2)
    )


def _adx_input(r: Rolling) -> Column:
    in_seed = c("_rn").between(WILDER_ROWS, FIRST_FULL_DX)
    return (
        F.when(c("_rn") < FIRST_FULL_DX, F.lit(0.0))
        .when(c("_rn") == FIRST_FULL_DX, F.avg(F.when(in_seed, c("_DX"))).over(r.so_far))
        .otherwise(c("_DX") / float(WILDER_ROWS))
    )


def _sd20(r: Rolling) -> Column:
    """Sample deviation of 20 rows from two halves (parallel form of Chan et al.)."""
    apart = (c("_SUM10_CLOSE") - r.lag(c("_SUM10_CLOSE"), 10)) / 10.0
    squares = c("_SQ10") + r.lag(c("_SQ10"), 10) + apart * apart * 5.0
    return F.when(c("_RUN_CLOSE") >= 20, F.sqrt(squares / 19.0))


# Recurrences run between stages: output -> (input, decay).
_AVERAGES_1 = {
    "_WTR": ("_IN_WTR", WILDER_DECAY),
    "_WUP": ("_IN_WUP", WILDER_DECAY),
    "_WDOWN": ("_IN_WDOWN", WILDER_DECAY),
}
_AVERAGES_2 = {
    "MACD_SIGNAL": ("_IN_SIGNAL", 1 - ema_step(9)),
    "_ADX": ("_IN_ADX", WILDER_DECAY),
}


def averaged(name: str) -> tuple[str, float] | None:
    """Input and decay of a column that is a recurrence; exponential averages of closes exist for every span."""
    if m := _EXPONENTIAL_NAME.match(name):
        return f"_IN_EMA{m.group(1)}", 1 - ema_step(int(m.group(1)))
    return _AVERAGES_1.get(name) or _AVERAGES_2.get(name)


_AVERAGES_1_AFTER = 2
_AVERAGES_2_AFTER = 4
_LAST_STAGE = 5


def _derived() -> dict[str, Derived]:
    close, high, low, volume, open_ = c("CLOSE"), c("HIGH"), c("LOW"), c("VOLUME"), c("OPEN")
    d: dict[str, Derived] = {}

    # Row arithmetic and windows over raw columns.
    d["_BODY"] = Derived(0, (), lambda r: F.abs(close - open_))
    d["_MONEY"] = Derived(0, (), lambda r: (high + low + close) / 3 * volume)
    d["PREVIOUS_PRICE"] = Derived(1, (), lambda r: r.lag(close))
    for n in RETURN_LAGS:
        d[f"PRICE_RETURN_{n}D_PCT"] = Derived(
            1, (), lambda r, n=n: (close / nz(r.lag(close, n)) - 1) * 100
        )
    d["_SQ10"] = Derived(1, (), lambda r: F.var_pop(close).over(r.trailing(10)) * 10.0)
    d["_TR"] = Derived(1, ("PREVIOUS_PRICE",), _true_range)
    d["_GAIN"] = Derived(1, ("PREVIOUS_PRICE",), lambda r: _clip_low(close - c("PREVIOUS_PRICE")))
    d["_LOSS"] = Derived(1, ("PREVIOUS_PRICE",), lambda r: _clip_low(c("PREVIOUS_PRICE") - close))
    d["_RISE"] = Derived(1, (), lambda r: high - r.lag(high))
    d["_FALL"] = Derived(1, (), lambda r: r.lag(low) - low)
    for name, this, other in (("_UP", "_RISE", "_FALL"), ("_DOWN", "_FALL", "_RISE")):
        d[name] = Derived(
            1,
            (this, other),
            lambda r, a=this, b=other: F.when((c(a) > c(b)) & (c(a) > 0), c(a)).otherwise(0.0),
        )
    d["THREE_RED_CANDLES"] = Derived(1, (), _run_of_three(close < open_))
    d["THREE_GREEN_CANDLES"] = Derived(1, (), _run_of_three(close > open_))
    d["_SERIES_ROWS"] = Derived(1, (), lambda r: F.count(F.lit(1)).over(r.whole))
    d["_BODY10"] = _mean(10, "BODY")

    # Volume.
    d["VOLUME_SPIKE"] = _ratio_to_mean(30)
    d["RVOL"] = _ratio_to_mean(10)
    money, traded = _rolled("SUM", 20, "MONEY"), _rolled("SUM", 20, "VOLUME")
    d["VWMA"] = Derived(
        money.stage, money.needs + traded.needs, lambda r: money.build(r) / nz(traded.build(r))
    )
    d["VWAP"] = Derived(2, ("VWMA",), lambda r: c("VWMA"))
    d["TRADE_FREQUENCY"] = Derived(_LAST_STAGE, ("VMA20",), lambda r: volume / nz(c("VMA20")) * 100)
    d["_N_HIGH_VOL"] = Derived(3, ("VMA20",), lambda r: r.total(_ones(volume > c("VMA20") * 1.5)))
    d["HIGH_VOL_DAYS"] = Derived(4, ("_N_HIGH_VOL",), _last_rows_of("_N_HIGH_VOL", 30))

    # Returns.
    d["_N_SPIKE"] = Derived(
        2, ("PRICE_RETURN_1D_PCT",), lambda r: r.total(_ones(c("PRICE_RETURN_1D_PCT") >= 1))
    )
    d["PERCENT_SPIKE"] = Derived(3, ("_N_SPIKE",), _last_rows_of("_N_SPIKE", 30))

    # Volatility and bands.
    d["ATR14"] = _mean(14, "TR")
    d["BB_MIDDLE"] = _mean(20, "CLOSE")
    d["_SD20"] = Derived(2, ("_SUM10_CLOSE", "_SQ10", "_RUN_CLOSE"), _sd20)
    d["BB_UPPER"] = Derived(_LAST_STAGE, ("BB_MIDDLE", "_SD20"), lambda r: c("BB_MIDDLE") + c("_SD20") * 2)
    d["BB_LOWER"] = Derived(_LAST_STAGE, ("BB_MIDDLE", "_SD20"), lambda r: c("BB_MIDDLE") - c("_SD20") * 2)
    d["BB_WIDTH"] = Derived(
        _LAST_STAGE, ("BB_UPPER", "BB_LOWER"), lambda r: c("BB_UPPER") - c("BB_LOWER")
    )
    d["BB_PERCENT_B"] = Derived(
        _LAST_STAGE, ("BB_LOWER", "BB_WIDTH"), lambda r: (close - c("BB_LOWER")) / nz(c("BB_WIDTH"))
    )
    d["SUPPORT"] = Derived(_LAST_STAGE, ("MA20", "ATR14"), lambda r: c("MA20") - c("ATR14") * 1.5)
    d["RESISTANCE"] = Derived(_LAST_STAGE, ("MA20", "ATR14"), lambda r: c("MA20") + c("ATR14") * 1.5)

    # Momentum.
    gain, loss = _mean(14, "GAIN"), _mean(14, "LOSS")
    d["RSI14"] = Derived(
        gain.stage,
        gain.needs + loss.needs,
        lambda r: 100 - 100 / (1 + gain.build(r) / nz(loss.build(r))),
    )
    d["STOCH_K"] = Derived(
        2, ("HH14", "LL14"), lambda r: (close - c("LL14")) / nz(c("HH14") - c("LL14")) * 100
    )
    d["STOCH_D"] = _mean(3, "STOCH")
    d["MACD_LINE"] = Derived(3, ("_EMA12", "_EMA26"), lambda r: c("_EMA12") - c("_EMA26"))
    d["_IN_SIGNAL"] = Derived(4, ("MACD_LINE",), _ema_input("MACD_LINE", 9))
    d["MACD_HISTOGRAM"] = Derived(
        5, ("MACD_LINE", "MACD_SIGNAL"), lambda r: c("MACD_LINE") - c("MACD_SIGNAL")
    )

    # Retracement levels. Like bands they are row arithmetic, so they wait for the last stage: the second has many columns.
    for name, part in FIBONACCI.items():
        d[name] = Derived(
            _LAST_STAGE, ("HH50", "LL50"), lambda r, p=part: c("HH50") - (c("HH50") - c("LL50")) * p
        )

    # Candles.
    d["DOJI"] = Derived(1, ("_BODY", "_BODY10"), lambda r: flag(c("_BODY") < c("_BODY10") * 0.1))
    d["HAMMER"] = Derived(1, ("_BODY",), _shadow_flag(_lower_shadow, _upper_shadow))
    d["HANGING_MAN"] = d["HAMMER"]
    d["SHOOTING_STAR"] = Derived(1, ("_BODY",), _shadow_flag(_upper_shadow, _lower_shadow))
    stars = ("_BODY", "_BODY10")
    d["MORNING_STAR"] = Derived(2, stars, _star(lambda cl, op: cl < op, close > open_))
    d["EVENING_STAR"] = Derived(2, stars, _star(lambda cl, op: cl > op, close < open_))

    # Directional movement.
    d["_IN_WTR"] = Derived(2, ("_TR",), _wilder_input("_TR"))
    d["_IN_WUP"] = Derived(2, ("_UP",), _wilder_input("_UP"))
    d["_IN_WDOWN"] = Derived(2, ("_DOWN",), _wilder_input("_DOWN"))
    d["ADX_PLUS"] = Derived(
        3, ("_WUP", "_WTR", "_SERIES_ROWS"), lambda r: _when_wilder(c("_WUP") / nz(c("_WTR")) * 100)
    )
    d["ADX_MINUS"] = Derived(
        3,
        ("_WDOWN", "_WTR", "_SERIES_ROWS"),
        lambda r: _when_wilder(c("_WDOWN") / nz(c("_WTR")) * 100),
    )
    d["_DX"] = Derived(
        3,
        ("ADX_PLUS", "ADX_MINUS"),
        lambda r: F.abs(c("ADX_PLUS") - c("ADX_MINUS"))
        / nz(F.abs(c("ADX_PLUS")) + F.abs(c("ADX_MINUS")))
        * 100,
    )
    d["_IN_ADX"] = Derived(4, ("_DX",), _adx_input)
    return d


@lru_cache(maxsize=1)
def _definitions(context: SparkContext) -> dict[str, Derived]:
    """Column objects belong to a Spark context, so the table is made once per context."""
    return _derived()


def lookup(name: str) -> Derived | None:
    """Definition of a column; moving averages and ranges exist for every window length."""
    fixed = _definitions(SparkContext.getOrCreate())
    if name in fixed:
        return fixed[name]
    if m := _ROLLING_NAME.match(name):
        return _rolling_column(m.group(1), int(m.group(2) or 0), m.group(3))
    if m := _RUNNING_NAME.match(name):
        return _running_column(m.group(1), m.group(2), int(m.group(3)), m.group(4))
    if m := _EXPONENTIAL_INPUT.match(name):
        return Derived(1, (), _ema_input("CLOSE", int(m.group(1))))
    if m := _WINDOWED_NAME.match(name):
        n = int(m.group(2))
        return {
            "MA": lambda: _mean(n, "CLOSE"),
            "VMA": lambda: _mean(n, "VOLUME"),
            "HH": lambda: _rolled("TOP", n, "HIGH"),
            "LL": lambda: _rolled("BOTTOM", n, "LOW"),
        }[m.group(1)]()
    return None


def is_technical(name: str) -> bool:
    return not name.startswith("_") and (
        name in TECHNICAL_COLUMNS or _WINDOWED_NAME.match(name) is not None or _EXPONENTIAL_NAME.match(name) is not None
    )


def longest_window(names: Iterable[str]) -> int:
    """Rows that the windows of some columns look back over. Recurrences need none."""
    names = list(names)
    lengths = [int(m.group(2)) for m in map(_WINDOWED_NAME.match, names) if m]
    lengths += [int(m.group(1)) + 1 for m in map(_RETURN_NAME.match, names) if m]
    return max([SHORTEST_LOOKBACK, *lengths])


def _closure(wanted: Iterable[str]) -> set[str]:
    """The wanted columns and everything they are computed from."""
    extra = {"ADX14": ("_ADX", "_DX")}
    seen: set[str] = set()
    todo = list(wanted)
    while todo:
        name = todo.pop()
        if name in seen or name in RAW_COLUMNS:
            continue
        seen.add(name)
        if name in extra:
            todo.extend(extra[name])
        elif spec := averaged(name):
            todo.append(spec[0])
        else:
            known = lookup(name)
            if known is None:
                raise ValueError(f"unknown indicator column: {name}")
            todo.extend(known.needs)
    return seen


def _after(name: str) -> int:
    """Stage behind which a recurrence is run."""
    return _AVERAGES_2_AFTER if name in _AVERAGES_2 else _AVERAGES_1_AFTER


def _passes(need: set[str]) -> dict[int, list[list[str]]]:
    """Per stage, groups of columns to add one after the other so that inputs come first."""
    computed = {n for n in need if averaged(n)} | {"ADX14"}
    waiting = {n for n in need if n not in computed}
    ready = set(RAW_COLUMNS) | computed
    plan: dict[int, list[list[str]]] = {}
    stage = 0
    while waiting:
        group = sorted(
            n
            for n in waiting
            if lookup(n).stage <= stage and all(x in ready for x in lookup(n).needs)
        )
        if group:
            plan.setdefault(stage, []).append(group)
            ready.update(group)
            waiting.difference_update(group)
        else:
            stage += 1
    return plan


def _raw(bars: DataFrame, layout: Layout) -> DataFrame:
    numbered = layout.prepare(bars.select("symbol", "date", "open", "high", "low", "close", "volume"))
    keep = layout.helpers
    prices = [c(n.lower()).cast("double").alias(n) for n in RAW_COLUMNS if n != "PRICE"]
    return numbered.select("symbol", "date", *keep, *(["_more"] if layout.blocked else []), *prices)


def _adx(df: DataFrame, roll: Rolling, layout: Layout) -> DataFrame:
    """ADX from row 27 on. A missing DX later on makes every following value missing."""
    broken = layout.settled() & (
        ((c("_rn") == FIRST_FULL_DX) & c("_IN_ADX").isNull())
        | ((c("_rn") > FIRST_FULL_DX) & c("_DX").isNull())
    )
    df = df.withColumn("_BROKEN", F.max(flag(broken)).over(roll.so_far))
    valid = (c("_rn") >= FIRST_FULL_DX) & (c("_SERIES_ROWS") >= 2 * WILDER_ROWS)
    return df.withColumn("ADX14", F.when(valid & (c("_BROKEN") == 0), c("_ADX")))


def _fill_block_edges(df: DataFrame, layout: Layout, at: dict[str, Column]) -> DataFrame:
    """Last known values from earlier blocks, for the rows a block cannot fill by itself.

    One row per block is aggregated and joined back on the key the blocks are partitioned by.
    """
    has_adx = "ADX14" in at
    aggs = [
        F.max_by(v, F.when(v.isNotNull(), c("_rn"))).alias(f"_e_{n}") for n, v in at.items()
    ]
    if has_adx:
        aggs.append(F.max("_BROKEN").alias("_e_broken"))
    edges = df.where(c("_own")).groupBy("symbol", "_block").agg(*aggs)
    earlier = (
        Window.partitionBy("symbol")
        .orderBy("_block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    if has_adx:
        edges = edges.withColumn(
            "_broken_before", F.coalesce(F.max("_e_broken").over(earlier), F.lit(0))
        ).withColumn("_e_ADX14", F.when(c("_broken_before") == 0, c("_e_ADX14")))
    carried = edges.select(
        "symbol",
        "_block",
        *(["_broken_before"] if has_adx else []),
        *[F.last(c(f"_e_{n}"), ignorenulls=True).over(earlier).alias(f"_c_{n}") for n in at],
    )
    joined = df.join(carried, ["symbol", "_block"], "left")
    if has_adx:
        joined = joined.withColumn(
            "ADX14", F.when(F.coalesce(c("_broken_before"), F.lit(0)) == 0, c("ADX14"))
        )
    return joined


def _fill(
    df: DataFrame, roll: Rolling, layout: Layout, at: dict[str, Column], warmup: str, complete: bool
) -> DataFrame:
    """Carry the last known value forward; what is still missing is warm-up and becomes 0."""
    values = [n for n in at if n not in CANDLE_FLAGS]
    carried = [n for n in values if n in MAY_LAPSE or not complete]
    if layout.blocked and carried:
        df = _fill_block_edges(df, layout, {n: at[n] for n in carried})
    filled = {}
    if warmup == "zero":
        filled = {n: F.coalesce(at[n], F.lit(0.0)) for n in values if n not in carried}
    for n in carried:
        known = roll.last_known(F.when(layout.settled(), at[n]) if layout.blocked else at[n])
        if layout.blocked:
            known = F.coalesce(known, c(f"_c_{n}"))
        filled[n] = F.coalesce(known, F.lit(0.0)) if warmup == "zero" else known
    keep = ["symbol", "date", *layout.helpers]
    ordered = [filled.get(n, at[n]).alias(n) for n in at]
    return df.select(*keep, *ordered)


def add_technical(
    bars: DataFrame,
    layout: Layout,
    wanted: Iterable[str] | None = None,
    *,
    fill: bool = True,
    warmup: str = "zero",
    complete: bool = False,
    decimals: int | None = None,
    shift: float = 0.0,
    latest: bool = False,
) -> DataFrame:
    """Bars with indicator columns, rounded to ``decimals`` if given, after ``shift`` is added.

    The result keeps symbol, date and the row number ``_rn`` (and, in a block layout, the
    neighbour rows marked by ``_own``; ``result_rows`` drops them). ``warmup='null'`` leaves
    rows without enough history null, so that rules on them are not met; ``fill=False`` also
    skips carrying values forward. ``complete=True`` promises bars without nulls (bars made
    from ticks, or the usable part of ``split_rejects``): only columns that can lapse on such
    bars are then carried. ``latest=True`` says that only the last bar of each series is read; others may be left out.
    """
    if warmup not in ("zero", "null"):
        raise ValueError("warmup must be 'zero' or 'null'")
    names = list(dict.fromkeys([*RAW_COLUMNS, *(wanted if wanted is not None else TECHNICAL_COLUMNS)]))
    need = _closure(names)
    if layout.blocked and longest_window(names) > layout.lookback:
        raise ValueError(f"the layout's lookback must be at least {longest_window(names)}")
    roll = Rolling(layout.keys)
    df = _raw(bars, layout)
    if fill and complete and _in_arrays(names, layout):
        return _by_arrays(df, layout, names, need, warmup, decimals, shift, latest)
    keep = ["symbol", "date", *layout.helpers]
    plan = _passes(need)
    packed: dict[str, str] = {"PRICE": "CLOSE"}
    for stage in range(_LAST_STAGE + 1):
        for names_at_once in plan.get(stage, []):
            df = df.withColumns({n: lookup(n).build(roll) for n in names_at_once})
        specs = {o: averaged(o) for o in sorted(need) if averaged(o) and _after(o) == stage}
        if specs:
            df = decayed_sums(df, layout, specs)
        later = {x for t, groups in plan.items() if t > stage for g in groups for x in g}
        df = _pack(df, f"_done{stage}", names, _read_by(later, need, stage), packed)
    if "ADX14" in need:
        df = _adx(df, roll, layout)
    # Columns stay in their structs until the last select.
    at = {n: c(packed.get(n, n)) for n in names}
    done = _fill(df, roll, layout, at, warmup, complete) if fill else df.select(*keep, *[at[n].alias(n) for n in names])
    if decimals is None:
        return done
    return done.withColumns({n: F.round(c(n) + shift if shift else c(n), decimals) for n, kind in done.dtypes if kind == "double"})


def _in_arrays(names: Sequence[str], layout: Layout) -> bool:
    """Long series, and many columns; windows beyond the parted ones and forced segments stay windows of the engine."""
    short = all(bar_arrays.known(n) for n in names) and longest_window(names) <= LONGEST_PARTED
    return short and layout.segment_rows is None and (layout.blocked or len(names) >= ARRAY_COLUMNS)


def _by_arrays(
    df: DataFrame, layout: Layout, names: list[str], need: set[str], warmup: str, decimals: int | None, shift: float, latest: bool
) -> DataFrame:
    """The columns made in arrays (``bar_arrays``), and in a block layout ``_ends``: the last row of its group.

    A block layout is read by a pass for what each block leaves to the next, another for averages of averages, and one
    for the columns. The first two need no block without a successor, and the second only the rows of the blocks themselves.
    """
    keys = list(layout.keys)
    work = bar_arrays.Pass(
        keys=tuple(keys),
        kept=("symbol", "date", *layout.helpers),
        names=tuple(names),
        recurrences=tuple(sorted(n for n in need if averaged(n))),
        carried=tuple(n for n in names if n in MAY_LAPSE),
        zero=warmup == "zero",
        block_rows=layout.block_rows if layout.blocked else None,
        digits=decimals,
        shift=shift,
        latest=latest and layout.blocked,
    )
    kinds = {n: "double" for n in names} | {n: "int" for n in names if n in CANDLE_FLAGS}
    if not layout.blocked:
        df = df.withColumn("_at", c("_rn"))
        return df.mapInArrow(work.columns, _schema(df, work.kept, {**kinds, "_ends": "boolean"})).drop("_ends")
    # The window that numbers the rows of a group also sees to it that groups lie together and in order.
    in_group = F.row_number().over(Window.partitionBy(*keys).orderBy("_rn")) - 1
    before = None
    ended = df.where("_more").select(*keys, "_rn", "HIGH", "LOW", "CLOSE", "VOLUME")
    first = [n for n in work.recurrences if n not in bar_arrays.SECOND]
    left = [*first, *[f"known_{n}" for n in work.carried if not n.startswith("ADX")]]
    if left:
        work = replace(work, left=tuple(left))
        before = computed_once(_carried(ended.withColumn("_at", in_group), work, work.ends))
    second = [n for n in work.recurrences if n in bar_arrays.SECOND]
    late = [*second, *[f"known_{n}" for n in work.carried if n in ("ADX_PLUS", "ADX_MINUS")]]
    late += ["broken", "known_ADX14", "shown"] if "_ADX" in second else []
    if late:
        # True ranges and moves read one row back.
        begin = c("_block") * F.lit(layout.block_rows)
        inside = ended.where(c("_rn").between(begin - 1, begin + layout.block_rows - 1)).drop("VOLUME")
        work = replace(work, before=tuple(left), left=tuple(late))
        more = _carried(_joined(inside.withColumn("_at", in_group), before, keys), work, work.second_ends)
        both = F.concat(c("a._before"), c("b._before")).alias("_before")
        before = computed_once(before.alias("a").join(more.alias("b"), keys).select(*keys, both))
    work = replace(work, before=(*left, *[n for n in late if n != "shown"]))
    df = (df.where("NOT _more") if latest else df).drop("_more").withColumn("_at", in_group)
    if before is not None:
        df = _joined(df, before, keys)
    return df.mapInArrow(work.columns, _schema(df, work.kept, {**kinds, "_ends": "boolean"}))


def _joined(df: DataFrame, before: DataFrame, keys: list[str]) -> DataFrame:
    """What is left to a block, on its first row."""
    return df.join(before, keys, "left").withColumn("_before", F.when(c("_at") == 0, c("_before")))


def _schema(df: DataFrame, kept: Iterable[str], kinds: dict[str, str]) -> str:
    types = dict(df.dtypes)
    return ", ".join(f"`{n}` {kind}" for n, kind in {**{n: types[n] for n in kept}, **kinds}.items())


def _carried(df: DataFrame, work: bar_arrays.Pass, ends: Callable) -> DataFrame:
    """One row per block after the first: what the blocks before leave to it, of what a pass finds at the end of each."""
    blocks = df.mapInArrow(ends, _schema(df, work.keys, {f"_e_{n}": "double" for n in work.left}))
    blocks = blocks.withColumn("_at", F.row_number().over(Window.partitionBy("symbol").orderBy("_block")) - 1)
    return blocks.mapInArrow(work.carry, _schema(df, work.keys, {"_before": "binary"}))


def _read_by(later: set[str], need: set[str], stage: int) -> set[str]:
    """Columns that stages after this one still read."""
    read = set(RAW_COLUMNS)
    for n in later:
        read.update(lookup(n).needs)
    read.update(averaged(o)[0] for o in need if averaged(o) and stage < _after(o))
    if "ADX14" in need:
        read.update(("_ADX", "_DX", "_IN_ADX", "_SERIES_ROWS"))
    return read


def _pack(
    df: DataFrame, into: str, names: list[str], read_later: set[str], packed: dict[str, str]
) -> DataFrame:
    """Set finished columns aside in one struct, and drop helpers nothing reads any more.

    The windows that follow then copy one field instead of dozens, and the code generated for
    them stays small enough to be compiled to machine code.
    """
    present = [n for n in df.columns if n not in read_later]
    done = [n for n in present if n in names]
    helpers = [n for n in present if n not in names and lookup(n) is not None]
    helpers += [n for n in present if n not in names and averaged(n)]
    if len(done) > 3:
        df = df.withColumn(into, F.struct(*done)).drop(*done)
        packed.update({n: f"{into}.{n}" for n in done})
    return df.drop(*helpers)


def result_rows(df: DataFrame, layout: Layout) -> DataFrame:
    """Each bar once: drops the neighbour rows of a block layout and the helper columns."""
    out = df.where(layout.own()) if layout.blocked else df
    return out.drop(*layout.helpers, "_ends")
