"""Historical trades: signal bars turned into non-overlapping positions per (strategy, symbol).

Strategies whose position does not change while open are done with window frames only:

1. signal, target, stop and size are columns of the bar;
2. each signal bar looks at the next max_hold bars for its first exit: in a forward frame, for longer holds
   by crossing indexes over the series (``crossing``), or in chunks if stop rules are more than arithmetic;
3. of overlapping candidates only those starting after the last kept exit remain.

Step 3 goes through the candidates of a short series in order. In a block layout every candidate points
to the first one at or after its exit; pointers are doubled inside a block until they leave it. So a block
answers at once, for each row f from which the series may be free again, when it is free after this
block. Chaining these answers gives the state at the start of every block, and the blocks
follow their pointers from there in parallel.

Strategies with averaging or partial exits are in ``position_fold``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from barquarry.functions.rolling import Rolling
from barquarry.functions.scalars import days_held, display_symbol, iso_date, range_days, share_count
from barquarry.operators import bar_arrays
from barquarry.operators.layout import Layout
from barquarry.operators.crossing import NONE, first_exits
from barquarry.operators.rules import ENTRY_PRICE, all_met, arithmetic, columns_used, per_bar, value
from barquarry.operators.scan import with_compliance
from barquarry.operators.strategy import Strategy
from barquarry.session import computed_once

NEVER = 9_000_000_000_000_000_000  # row number after every series
CHUNK = 256
# Exits of positions held up to so many bars are read from one forward frame.
FRAME_BARS = 32
CHUNK_BARS = 64
c = F.col

TRADE_COLUMNS = [
    "strategy",
    "symbol",
    "entry_date",
    "close_date",
    "entry_price",
    "exit_price",
    "pnl",
    "roi_pct",
    "hold_period",
    "exit_reason",
    "stop_loss",
    "take_profit",
]


def in_range(
    frame: DataFrame,
    layout: Layout,
    *,
    period: str | None = None,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """Mark the bars of the backtest range (both ends inclusive) in ``_in``.

    A period counts back from each symbol's own last bar. Bars before the range keep feeding
    the indicators; they only stop being entries.
    """
    day = F.to_date("date")
    if period is not None:
        if not layout.blocked:  # a block layout already knows the end of each series
            frame = frame.withColumn("_last", F.max("date").over(Rolling(layout.keys).whole))
        inside = day >= F.date_sub(F.to_date("_last"), range_days(period))
        return frame.withColumn("_in", inside).drop("_last")
    inside = F.lit(True)
    if start is not None:
        inside = inside & (day >= F.lit(start).cast("date"))
    if end is not None:
        inside = inside & (day <= F.lit(end).cast("date"))
    return frame.withColumn("_in", inside)


def size_column(s: Strategy, amount: float) -> Column:
    """Shares bought at the close: by the sizing expression, or by the fixed amount if that fails."""
    fixed = share_count(F.lit(float(amount)), c("CLOSE"))
    if not s.amount:
        return fixed
    money = value(s.amount, amount=amount)
    usable = money.isNotNull() & ~F.isnan(money) & (F.abs(money) < F.lit(float("inf")))
    return F.when(usable, share_count(money, c("CLOSE"))).otherwise(fixed)


def entry_columns(strategies: Sequence[Strategy], amount: float) -> dict[str, Column]:
    """Per strategy: size (null where there is no entry), target and recorded stop."""
    cols: dict[str, Column] = {}
    for i, s in enumerate(strategies):
        size = size_column(s, amount)
        cols[f"_qty{i}"] = F.when(all_met(s.entry) & c("_in") & (size > 0), size)
        cols[f"_target{i}"] = value(s.target)
        cols[f"_stop{i}"] = value(s.stop)
    return cols


def _stop_rules(s: Strategy) -> dict[str, str]:
    """Stop rules that are evaluated anew on each bar."""
    return {f"s{n}": rule for n, rule in enumerate(s.sl)} if not s.fixed_stop else {}


def _bar(strategies: Sequence[Strategy]) -> Column:
    """What an exit may depend on at a bar: range, close, and the columns stop rules name."""
    names = columns_used(rule for s in strategies for rule in _stop_rules(s).values())
    return F.struct(
        c("_rn").alias("rn"),
        "date",
        c("_in").alias("usable"),
        *[c(n).alias(n) for n in dict.fromkeys(["HIGH", "LOW", "CLOSE", *names])],
    )


def _first_exit(s: Strategy, i: int, tests: Column, peaks: Callable[[Column], Column], held: Callable[[Column], Column]) -> Column:
    """First of the ``tests`` (bars with the stop rules' values) that ends the position.

    ``peaks(k)`` is the highest price from the entry to test k, ``held(bar)`` the bars since the entry.
    """

    def judge(test: Column, k: Column) -> Column:
        bar = test["bar"]
        reason, price = F.when(F.lit(False), ""), F.when(F.lit(False), F.lit(0.0))
        if s.trailing is not None:
            level = peaks(k) * (1.0 - s.trailing)
            hit = bar["LOW"] <= level
            reason, price = reason.when(hit, "Trailing Stop Hit"), price.when(hit, level)
        levels = [c(f"_stop{i}")] if s.fixed_stop else [test[n] for n in _stop_rules(s)]
        for n, level in enumerate(levels):
            hit = bar["LOW"] <= level
            reason, price = reason.when(hit, f"SL Hit (Level {n + 1})"), price.when(hit, level)
        hit = bar["HIGH"] >= c(f"_target{i}")
        reason, price = reason.when(hit, "TP Hit"), price.when(hit, c(f"_target{i}"))
        late = held(bar) >= s.max_hold
        reason, price = reason.when(late, "MaxHold Exit"), price.when(late, bar["CLOSE"])
        return F.struct(
            bar["rn"].alias("rn"),
            bar["date"].alias("date"),
            price.alias("price"),
            reason.alias("reason"),
            bar["usable"].alias("usable"),
        )

    exits = F.transform(tests, judge)
    return F.get(F.filter(exits, lambda e: e["reason"].isNotNull() & e["usable"]), F.lit(0))


def _candidate(s: Strategy, i: int, exit_: Column) -> Column:
    return F.struct(
        F.lit(s.name).alias("strategy"),
        c("_rn").alias("entry_rn"),
        c("date").alias("entry_date"),
        c("CLOSE").alias("entry_price"),
        c(f"_qty{i}").alias("qty"),
        c(f"_stop{i}").alias("stop_loss"),
        c(f"_target{i}").alias("take_profit"),
        exit_.alias("exit"),
    )


def exit_candidates(
    frame: DataFrame, strategies: Sequence[Strategy], amount: float, layout: Layout, marks: bool = False
) -> DataFrame:
    """One row per signal bar with its exit (null if the data ends first).

    ``marks`` adds for the last bar of each symbol a row without strategy and exit.

    Where the frame comes in order (``_ends`` marks the last bar of each group), all strategies whose stop rules are plain
    arithmetic are searched in one pass over it. Otherwise up to ``FRAME_BARS`` bars are read from a forward frame, without a shuffle, and longer holds are
    found by crossing indexes over the bars of a group, on the partitioning that the windows left. Where stop
    rules are not plain arithmetic, signal bars are joined with the bars they may be held through; with a
    trailing stop besides, those are packed into chunks.
    """
    ordered = "_ends" in frame.columns
    keep = [*layout.keys, "date", "_rn", "CLOSE"] + (["_own"] if layout.blocked else []) + (["_ends"] if ordered else [])
    narrow = frame.withColumns(entry_columns(strategies, amount)).withColumn("_bar", _bar(strategies))
    columns = [f"_{x}{i}" for i in range(len(strategies)) for x in ("qty", "target", "stop")]
    narrow = narrow.select(*keep, "_bar", *columns)
    stops_of = {i: _array_stops(s) for i, s in enumerate(strategies)}
    at_once = [(i, s, stops_of[i]) for i, s in enumerate(strategies) if ordered and stops_of[i] is not None]
    left = [(i, s) for i, s in enumerate(strategies) if not ordered or stops_of[i] is None]
    short = [(i, s) for i, s in left if s.max_hold <= FRAME_BARS]
    parts = [_in_order(narrow, at_once, layout, marks)] if at_once or (marks and ordered) else []
    if short or (marks and not ordered):
        parts.append(_in_frames(narrow, short, layout, marks and not ordered))
    for i, s in left:
        if s.max_hold > FRAME_BARS:
            stops = stops_of[i]
            if stops is not None:
                parts.append(_by_crossing(narrow, i, s, stops, layout))
            else:
                parts.append(_by_pairs(narrow, i, s, layout) if s.trailing is None else _in_chunks(narrow, i, s, layout))
    return reduce(DataFrame.unionByName, parts)


def _in_frames(narrow: DataFrame, numbered: Sequence[tuple[int, Strategy]], layout: Layout, marks: bool = False) -> DataFrame:
    roll = Rolling(layout.keys)
    holds = sorted({max(1, s.max_hold) for _, s in numbered})
    narrow = narrow.withColumns({f"_next{k}": F.collect_list("_bar").over(roll.ordered.rowsBetween(1, k)) for k in holds})
    candidates = []
    for i, s in numbered:
        bars = f"_next{max(1, s.max_hold)}"
        highs = c(bars).getField("HIGH")
        found = _first_exit(
            s,
            i,
            per_bar(_stop_rules(s), bars),
            lambda k, highs=highs: F.greatest(c("CLOSE"), F.array_max(F.slice(highs, F.lit(1), k + 1))),
            lambda bar: bar["rn"] - c("_rn"),
        )
        candidates.append(F.when(c(f"_qty{i}").isNotNull(), _candidate(s, i, found)))
    if marks:
        ends = F.lead("_rn").over(roll.ordered).isNull()
        narrow = narrow.withColumn("_ends", ends)
        kind = candidates[0] if candidates else _candidate_of_none(narrow)
        candidates.append(F.when(c("_ends"), _mark(narrow.select(kind.alias("k")).schema["k"].dataType)))
    own = narrow.where(layout.own()) if layout.blocked else narrow
    return own.select(*layout.keys, F.explode(F.array_compact(F.array(*candidates))).alias("_cand")).select(
        *layout.keys, "_cand.*"
    )


def _candidate_of_none(narrow: DataFrame) -> Column:
    """A candidate's type where no strategy is there to give one."""
    none = F.lit(None)
    exit_ = F.struct(
        c("_rn").alias("rn"), c("date").alias("date"), none.cast("double").alias("price"), none.cast("string").alias("reason"), F.lit(True).alias("usable")
    )
    numbers = [none.cast("double").alias(n) for n in ("qty", "stop_loss", "take_profit")]
    fields = [c("_rn").alias("entry_rn"), c("date").alias("entry_date"), c("CLOSE").alias("entry_price")]
    return F.struct(none.cast("string").alias("strategy"), *fields, *numbers, exit_.alias("exit"))


def _mark(kind: StructType) -> Column:
    """A candidate that stands for its symbol only."""
    known = {"entry_rn": c("_rn"), "entry_date": c("date"), "entry_price": c("CLOSE")}
    return F.struct(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kind])


def _array_stops(s: Strategy) -> list | None:
    """Stop rules as functions of arrays, with whether they name the entry price only; None if one is not plain arithmetic."""
    found = [arithmetic(rule) for rule in _stop_rules(s).values()]
    return None if any(f is None for f in found) else [(f, names <= {ENTRY_PRICE}) for f, names in found]


def _exits(table: pa.Table | pa.RecordBatch, keys: Sequence[str], i: int, columns: Sequence[str], stops: list, how: tuple, last: np.ndarray | None = None) -> list[pa.Array]:
    """Columns of the candidates of strategy ``i`` among the bars of a table: keys, entry, size and levels, exit.

    ``how`` is the longest hold, the trailing stop, and whether the stop is fixed. ``last`` has the last bar of each bar's group.
    """
    hold, trailing, fixed = how
    qty, stop, target = (bar_arrays.floats(table[f"_{x}{i}"]) for x in ("qty", "stop", "target"))
    entries = np.flatnonzero(~np.isnan(qty) & bar_arrays.booleans(table["_mine"]))
    bars = {name: bar_arrays.floats(table[name]) for name in columns}
    stop, target = stop[entries], target[entries]
    rules = [(lambda _: stop, True)] if fixed else stops
    end = None if last is None else last[entries]
    at, price, reason = first_exits(bars, bar_arrays.booleans(table["usable"]), entries, target, rules, trailing, hold, end)
    none = at == NONE
    exit_at = pa.array(np.where(none, 0, at), mask=none)
    entry = pa.array(entries)
    null_of = lambda x: pa.array(x, mask=np.isnan(x))
    made = [table[k].take(entry) for k in keys]
    made += [table["rn"].take(entry), table["date"].take(entry), table["CLOSE"].take(entry).cast(pa.float64())]
    made += [pa.array(qty[entries]), null_of(stop), null_of(target), table["rn"].take(exit_at), table["date"].take(exit_at)]
    return [*made, pa.array(price, mask=none), pa.array(reason, pa.string(), mask=none)]


def _search(narrow: DataFrame, numbered: Sequence[tuple[int, Strategy]], layout: Layout) -> tuple[DataFrame, list[str], dict[str, str]]:
    """What a search for exits reads, the columns it tests, and the names and types of what ``_exits`` returns."""
    keys = list(layout.keys)
    levels = [c(f"_{x}{i}").cast("double").alias(f"_{x}{i}") for i, _ in numbered for x in ("qty", "target", "stop")]
    data = narrow.select(*keys, "_bar.*", layout.own().alias("_mine"), *[n for n in narrow.columns if n == "_ends"], *levels)
    columns = columns_used(rule for _, s in numbered for rule in _stop_rules(s).values())
    kinds = dict(data.dtypes)
    fields = {k: kinds[k] for k in keys}
    fields |= {"entry_rn": kinds["rn"], "entry_date": kinds["date"], "entry_price": "double", "qty": "double", "stop_loss": "double", "take_profit": "double"}
    fields |= {"exit_rn": kinds["rn"], "exit_date": kinds["date"], "exit_price": "double", "exit_reason": "string"}
    return data, list(dict.fromkeys(["HIGH", "LOW", "CLOSE", *columns])), fields


def _as_candidates(found: DataFrame, strategy: Column) -> DataFrame:
    exit_ = F.struct(c("exit_rn").alias("rn"), c("exit_date").alias("date"), c("exit_price").alias("price"), c("exit_reason").alias("reason"), F.lit(True).alias("usable"))
    kept = [n for n in found.columns if not n.startswith("exit_") and n != "strategy"]
    return found.select(*kept, strategy.alias("strategy"), F.when(c("exit_rn").isNotNull(), exit_).alias("exit"))


def _how(s: Strategy) -> tuple[int, float | None, bool]:
    return max(1, s.max_hold), s.trailing, s.fixed_stop


def _by_crossing(narrow: DataFrame, i: int, s: Strategy, stops: list, layout: Layout) -> DataFrame:
    keys, how = list(layout.keys), _how(s)
    data, columns, fields = _search(narrow, [(i, s)], layout)
    names = list(fields)

    def find(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table["rn"]))
        return pa.table(_exits(table.combine_chunks(), keys, i, columns, stops, how), names=names)

    found = data.groupBy(*keys).applyInArrow(find, ", ".join(f"`{k}` {v}" for k, v in fields.items()))
    return _as_candidates(found, F.lit(s.name))


def _in_order(narrow: DataFrame, numbered: Sequence[tuple[int, Strategy, list]], layout: Layout, marks: bool) -> DataFrame:
    """The candidates of several strategies in one pass over bars that lie in order, many groups at a time."""
    keys = list(layout.keys)
    data, columns, fields = _search(narrow, [(i, s) for i, s, _ in numbered], layout)
    fields = {**fields, "strategy": "string"}
    searches = [(i, s.name, stops, _how(s)) for i, s, stops in numbered]

    def find(batches):
        for batch in bar_arrays.whole_groups(batches):
            starts, ends = bar_arrays.groups_in_order(batch, keys)
            last = np.repeat(ends, ends - starts + 1)
            with np.errstate(all="ignore"):
                for i, name, stops, how in searches:
                    made = _exits(batch, keys, i, columns, stops, how, last)
                    yield pa.RecordBatch.from_arrays([*made, pa.array([name] * len(made[0]), pa.string())], names=list(fields))
            if marks:
                at = pa.array(ends[bar_arrays.booleans(batch["_mine"])[ends]])
                made = [batch[k].take(at) for k in keys] + [batch["rn"].take(at), batch["date"].take(at), batch["CLOSE"].take(at).cast(pa.float64())]
                kinds = [pa.float64()] * 3 + [batch["rn"].type, batch["date"].type, pa.float64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([*made, *[pa.nulls(len(at), kind) for kind in kinds]], names=list(fields))

    return _as_candidates(data.mapInArrow(find, ", ".join(f"`{k}` {v}" for k, v in fields.items())), c("strategy"))


def _by_pairs(narrow: DataFrame, i: int, s: Strategy, layout: Layout) -> DataFrame:
    """Signals joined with the bars they may be held through; of each signal the first bar that ends it is kept.

    Pairs are neither kept nor moved: they meet in chunks of bars and are aggregated there by fixed-width values.
    """
    keys = list(layout.keys)
    # As long as a hold, so that a signal meets at most two.
    size = max(CHUNK_BARS, s.max_hold)
    chunk = lambda row: F.floor(row / F.lit(size))
    names = [f"_qty{i}", f"_target{i}", f"_stop{i}"]
    signal = [*keys, "_rn", "_date", "_price", *names]
    signals = narrow.where(c(f"_qty{i}").isNotNull() & layout.own())
    signals = signals.select(*keys, "_rn", c("date").alias("_date"), c("CLOSE").alias("_price"), *names)
    late = c("rn") - c("_rn") >= s.max_hold
    stops = [c(f"_stop{i}")] if s.fixed_stop else [value(rule, entry_price="_price") for rule in _stop_rules(s).values()]
    tests = [(c("LOW") <= level, level, f"SL Hit (Level {n + 1})") for n, level in enumerate(stops)]
    tests += [(c("HIGH") >= c(f"_target{i}"), c(f"_target{i}"), "TP Hit"), (late, c("CLOSE"), "MaxHold Exit")]
    ends = reduce(lambda a, b: a | b, [F.coalesce(hit, F.lit(False)) for hit, _, _ in tests])
    reach = F.sequence(chunk(c("_rn") + 1), chunk(c("_rn") + s.max_hold))
    spread = signals.withColumn("_chunk", F.explode(reach)).alias("s")
    bars = narrow.select(*keys, "_bar.*").where("usable").withColumn("_chunk", chunk(c("rn"))).alias("b")
    meet = [c(f"s.{k}") == c(f"b.{k}") for k in (*keys, "_chunk")]
    meet += [c("rn") > c("_rn"), c("rn") <= c("_rn") + s.max_hold, ends]
    pairs = spread.join(bars, reduce(lambda a, b: a & b, meet), "left")
    code, price = F.when(F.lit(False), 0), F.when(F.lit(False), F.lit(0.0))
    for n, (hit, level, _) in enumerate(tests):
        code, price = code.when(hit, n), price.when(hit, level)
    found = pairs.select(*[c(f"s.{n}") for n in signal], "rn", "date", price.alias("_paid"), code.alias("_code"))
    # Chunks in which nothing ends a signal leave a row without ``rn``.
    firsts = [F.min_by(n, "rn").alias(n) for n in ("date", "_paid", "_code")]
    first = found.groupBy(*signal).agg(F.min("rn").alias("rn"), *firsts)
    reasons = F.array(*[F.lit(why) for _, _, why in tests])
    exit_ = F.struct("rn", "date", c("_paid").alias("price"), F.get(reasons, c("_code")).alias("reason"), F.lit(True).alias("usable"))
    first = first.select(*signal, F.when(c("rn").isNotNull(), exit_).alias("_exit"))
    first = first.withColumnsRenamed({"_date": "date", "_price": "CLOSE"})
    return first.select(*keys, _candidate(s, i, c("_exit")).alias("_cand")).select(*keys, "_cand.*")


def _in_chunks(narrow: DataFrame, i: int, s: Strategy, layout: Layout) -> DataFrame:
    keys = list(layout.keys)
    chunk = lambda row: F.floor(row / F.lit(CHUNK_BARS))
    packed = narrow.groupBy(*keys, chunk(c("_rn")).alias("_chunk")).agg(F.array_sort(F.collect_list("_bar")).alias("_bars"))
    signals = narrow.where(c(f"_qty{i}").isNotNull() & layout.own())
    signals = signals.select(*keys, "date", "_rn", "CLOSE", f"_qty{i}", f"_target{i}", f"_stop{i}")
    reach = F.sequence(chunk(c("_rn") + 1), chunk(c("_rn") + s.max_hold))
    parts = signals.withColumn("_chunk", F.explode(reach)).join(packed, [*keys, "_chunk"], "left")
    ahead = F.filter("_bars", lambda b: (b["rn"] > c("_rn")) & (b["rn"] <= c("_rn") + s.max_hold))
    parts = parts.withColumn("_ahead", ahead).drop("_bars")
    # The highest price of the chunks between the entry and this one: a few rows per signal.
    earlier = Window.partitionBy(*keys, "_rn").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    highs = c("_ahead").getField("HIGH")
    if s.trailing is not None:
        parts = parts.withColumn("_peak", F.greatest(c("CLOSE"), F.max(F.array_max(highs)).over(earlier)))
    found = _first_exit(
        s,
        i,
        per_bar(_stop_rules(s), "_ahead"),
        lambda k: F.greatest(c("_peak"), F.array_max(F.slice(highs, F.lit(1), k + 1))),
        lambda bar: bar["rn"] - c("_rn"),
    )
    one = parts.withColumn("_exit", found)
    first = one.groupBy(*keys, "date", "_rn", "CLOSE", f"_qty{i}", f"_target{i}", f"_stop{i}").agg(
        F.min_by("_exit", c("_exit.rn")).alias("_exit")
    )
    return first.select(*keys, _candidate(s, i, c("_exit")).alias("_cand")).select(*keys, "_cand.*")


def _free_after(candidate: Column) -> Column:
    """First row at which the next position may start if this candidate is taken."""
    return F.coalesce(candidate["exit"]["rn"] + 1, F.lit(NEVER))


def _kept(candidates: Column, free_from: Column, candidate_type: str) -> Column:
    """Candidates of a sorted array that do not start before the last kept exit.

    The array is walked in chunks: kept rows are appended to a short list per chunk, and whole
    chunks to the result, so no long list is copied for every row.
    """
    none = F.array().cast(f"array<{candidate_type}>")

    def step(acc: Column, cand: Column) -> Column:
        return F.when(
            cand["entry_rn"] >= acc["free"],
            F.struct(
                _free_after(cand).alias("free"), F.concat(acc["kept"], F.array(cand)).alias("kept")
            ),
        ).otherwise(acc)

    def walk(acc: Column, chunk: Column) -> Column:
        start = F.struct(acc["free"].alias("free"), none.alias("kept"))
        done = F.aggregate(chunk, start, step)
        # Bound once through a one-element array: used twice, it would be evaluated twice.
        merged = F.transform(
            F.array(done),
            lambda d: F.struct(
                d["free"].alias("free"),
                F.concat(acc["kept"], F.array(d["kept"])).alias("kept"),
            ),
        )
        return F.get(merged, F.lit(0))

    chunks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(candidates) - 1) / F.lit(CHUNK)).cast("int")),
        lambda i: F.slice(candidates, i * CHUNK + 1, F.lit(CHUNK)),
    )
    first = F.struct(
        free_from.cast("bigint").alias("free"),
        F.array().cast(f"array<array<{candidate_type}>>").alias("kept"),
    )
    return F.flatten(F.aggregate(chunks, first, walk)["kept"])


def non_overlapping(
    candidates: DataFrame, layout: Layout, max_hold: int
) -> DataFrame:
    """Candidates that become trades, in order, per (strategy, symbol)."""
    if layout.blocked:
        candidates = computed_once(candidates)  # read several times
        marks = candidates.where(c("strategy").isNull()).drop("_block")
        return _by_pointers(candidates.where(c("strategy").isNotNull()), layout, max_hold).unionByName(marks)
    keys = ["strategy", *layout.keys]
    fields = [n for n in candidates.columns if n not in keys and n != "entry_rn"]
    packed = F.struct("entry_rn", *fields)
    grouped = candidates.groupBy(*keys).agg(F.array_sort(F.collect_list(packed)).alias("cands"))
    kind = grouped.schema["cands"].dataType.elementType.simpleString()
    return grouped.select(*keys, F.inline(_kept(c("cands"), F.lit(0), kind)))


def first_at(entry: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The first candidate of a block that starts at or after a row, or the block's end. Entry rows ascend in each block."""
    low, high = starts[block], ends[block]
    while (open_ := low < high).any():
        middle = (low + high) // 2
        before = open_ & (entry[np.minimum(middle, len(entry) - 1)] < row)
        low, high = np.where(before, middle + 1, low), np.where(open_ & ~before, middle, high)
    return low


def _pointers(entry: np.ndarray, free: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each candidate the number of the first one of its block at or after its exit; that of none is the number of all."""
    block = np.repeat(np.arange(len(starts)), ends - starts)
    to = first_at(entry, starts, ends, block, free)
    return np.where(to < ends[block], to, len(entry))


def free_after(entry: np.ndarray, free: np.ndarray, starts: np.ndarray | None = None, ends: np.ndarray | None = None) -> np.ndarray:
    """For each candidate, where the series is free when a chain that takes it has left the block (one block, if none are given).

    Pointer doubling: each round lets every candidate jump as far again, so a block of n takes log n rounds.
    """
    n = len(entry)
    if starts is None:
        starts, ends = np.array([0]), np.array([n])
    to = np.append(_pointers(entry, free, starts, ends), n)
    out = np.append(free, NEVER)
    while (to[:n] < n).any():
        out = np.where(to < n, out[to], out)
        to = np.where(to < n, to[to], n)
    return out[:n]


def chains_from(entry: np.ndarray, free: np.ndarray, starts: np.ndarray, ends: np.ndarray, free_from: np.ndarray) -> np.ndarray:
    """Numbers of the candidates taken when the series of each block is free from its row ``free_from`` on, in order."""
    to, taken = _pointers(entry, free, starts, ends), []
    at = first_at(entry, starts, ends, np.arange(len(starts)), free_from)
    at = at[at < ends]
    while len(at):
        taken.append(at)
        at = to[at]
        at = at[at < len(entry)]
    return np.sort(np.concatenate(taken)) if taken else np.zeros(0, dtype=np.int64)


def chain_from(entry: np.ndarray, free: np.ndarray, start: int) -> list[int]:
    """Numbers of the candidates of one block taken when the series is free from row ``start`` on."""
    return chains_from(entry, free, np.array([0]), np.array([len(entry)]), np.array([start])).tolist()


def _by_pointers(candidates: DataFrame, layout: Layout, max_hold: int) -> DataFrame:
    """Non-overlapping candidates of long series; a task works the candidates of many blocks at a time."""
    keys, size, reach = ["strategy", "symbol", "_block"], layout.block_rows, max(1, max_hold)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("entry_rn")) - 1
    narrow = candidates.select(*keys, "entry_rn", _free_after(F.struct("exit")).alias("free")).withColumn("_at", place)

    def answer(batches):
        for batch in bar_arrays.whole_groups(batches):
            starts, ends, entry, free = _blocks_of(batch, "free")
            begin = batch["_block"].to_numpy()[starts] * size
            asked = begin[:, None] + np.arange(reach + 1)
            at = first_at(entry, starts, ends, np.repeat(np.arange(len(starts)), reach + 1), asked.ravel()).reshape(asked.shape)
            out = np.append(free_after(entry, free, starts, ends), 0)
            after = np.where(at < ends[:, None], out[np.minimum(at, len(entry))], asked)
            offsets = pa.array(np.arange(len(starts) + 1, dtype=np.int32) * (reach + 1))
            made = [*[batch[k].take(pa.array(starts)) for k in keys], pa.array(begin), pa.ListArray.from_arrays(offsets, pa.array(after.ravel()))]
            yield pa.RecordBatch.from_arrays(made, names=[*keys, "begin", "after"])

    answers = narrow.mapInArrow(answer, "strategy string, symbol string, _block bigint, begin bigint, after array<bigint>")
    starts_of = computed_once(_block_starts(answers))
    names = candidates.columns
    schema = candidates.schema

    def take(batches):
        for batch in bar_arrays.whole_groups(batches):
            starts, ends, entry, free = _blocks_of(batch, "_free")
            taken = chains_from(entry, free, starts, ends, batch["_free_from"].to_numpy()[starts])
            yield batch.select(names).take(pa.array(taken))

    ready = candidates.withColumn("_free", _free_after(F.struct("exit"))).join(starts_of, keys).withColumn("_at", place)
    return ready.mapInArrow(take, schema).drop("_block")


def _blocks_of(batch: pa.RecordBatch, free: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First row of each block and the one after its last, and of each candidate the row it starts and the one it leaves free."""
    starts = np.flatnonzero(batch["_at"].to_numpy() == 0)
    return starts, np.append(starts[1:], batch.num_rows), batch["entry_rn"].to_numpy().astype(np.int64), batch[free].to_numpy()


def _block_starts(answers: DataFrame) -> DataFrame:
    """Row from which each block of each series is free, given everything before it: one row per block is folded."""

    def chain(acc: Column, answer: Column) -> Column:
        ahead = F.greatest(acc["free"] - answer["begin"], F.lit(0))
        following = F.when(acc["free"] >= NEVER, F.lit(NEVER)).otherwise(
            F.get(answer["after"], ahead.cast("int"))
        )
        start = F.struct(answer["_block"].alias("_block"), acc["free"].alias("_free_from"))
        return F.struct(
            following.cast("bigint").alias("free"),
            F.concat(acc["starts"], F.array(start)).alias("starts"),
        )

    first = F.struct(
        F.lit(0).cast("bigint").alias("free"),
        F.array().cast("array<struct<_block:bigint,_free_from:bigint>>").alias("starts"),
    )
    return (
        answers.groupBy("strategy", "symbol")
        .agg(F.array_sort(F.collect_list(F.struct("_block", "begin", "after"))).alias("answers"))
        .select("strategy", "symbol", F.inline(F.aggregate("answers", first, chain)["starts"]))
    )


def finished_trades(kept: DataFrame) -> DataFrame:
    """Profit, return and holding time; positions still open at the end give no row."""
    return (
        kept.where(c("exit").isNotNull() | c("strategy").isNull())
        .withColumns(
            {
                "close_date": c("exit.date"),
                "exit_price": c("exit.price"),
                "exit_reason": c("exit.reason"),
                "pnl": (c("exit.price") - c("entry_price")) * c("qty"),
                "roi_pct": (F.try_divide(c("exit.price"), c("entry_price")) - 1) * 100,
                "hold_period": days_held(c("entry_date"), c("exit.date")),
            }
        )
        .select(*TRADE_COLUMNS)
    )


def marked_symbols(frame: DataFrame, layout: Layout) -> DataFrame:
    """A row without strategy for each symbol of ``frame``, in the shape of trades."""
    return finished_trades(exit_candidates(frame, [], 0.0, layout, marks=True))


def frame_trades(
    frame: DataFrame, strategies: Sequence[Strategy], amount: float, layout: Layout, marks: bool = False
) -> DataFrame:
    """Trades of strategies that need no fold. ``frame`` has indicator columns and ``_in``."""
    bad = [s.name for s in strategies if s.needs_fold]
    if bad:
        raise ValueError(f"strategies need the position fold: {bad}")
    hold = max(1, *(s.max_hold for s in strategies))
    if layout.blocked and layout.lookahead < hold:
        raise ValueError(f"layout lookahead must be at least {hold}")
    candidates = exit_candidates(frame, strategies, amount, layout, marks)
    return finished_trades(non_overlapping(candidates, layout, hold))


def trade_rows(trades: DataFrame, compliance: DataFrame) -> DataFrame:
    """The 11 columns of a trade result, preceded by the strategy."""
    out = with_compliance(trades, compliance)
    return out.select(
        "strategy",
        display_symbol(c("symbol"), c("compliant")).alias("ticker"),
        iso_date(c("entry_date")).alias("entry_date"),
        iso_date(c("close_date")).alias("close_date"),
        "entry_price",
        "exit_price",
        "pnl",
        "roi_pct",
        "hold_period",
        "exit_reason",
        "stop_loss",
        "take_profit",
    )
