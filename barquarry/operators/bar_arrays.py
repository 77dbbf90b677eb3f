"""The technical columns of many series at once, in arrays.

A window reads the rows before a row, whatever series they belong to, so it is an addition of shifted arrays; what
reaches over the start of a series is then taken out. One operation of a few nanoseconds a row serves all series of
a chunk, where a frame of the engine is a buffer and an expression for each row. Sums are added in the order of
``rolling.sum_parts``, as the windows of ``indicators`` do. Not a number stands for null.

Recurrences follow the series in order, one step of all series together; series longer than ``SEGMENT`` are cut,
and each segment is given what the one before left. A chunk holds whole groups, so its size is that of the longest
group or ``CHUNK_ROWS``, if that is more.

In a block layout three passes read the dealt blocks: ``ends`` and ``second_ends`` leave one row per block, whose
values are carried from block to block by ``carry``; the last pass, ``columns``, starts from them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import numpy as np
import pyarrow as pa

from barquarry.functions.rolling import sum_parts

CHUNK_ROWS = 32_768
SEGMENT = 1_024
WILDER_ROWS = 14
WILDER_DECAY = 13.0 / 14.0
FIRST_FULL_DX = 2 * WILDER_ROWS - 1
SIGNAL_SPAN = 9
#: Recurrences that read other recurrences.
SECOND = ("MACD_SIGNAL", "_ADX")
WILDER = {"_WTR": "_TR", "_WUP": "_UP", "_WDOWN": "_DOWN"}
_WINDOWED = re.compile(r"^(VMA|MA|HH|LL)([1-9]\d*)$")
_EXPONENTIAL = re.compile(r"^_?EMA([1-9]\d*)$")
_RETURN = re.compile(r"^PRICE_RETURN_(\d+)D_PCT$")


def ema_step(span: int) -> float:
    return 2.0 / (span + 1)


def _span(name: str) -> int:
    m = _EXPONENTIAL.match(name)
    return int(m.group(1)) if m else SIGNAL_SPAN


def decay_of(name: str) -> float:
    return WILDER_DECAY if name in WILDER or name == "_ADX" else 1 - ema_step(_span(name))


def nz(x: np.ndarray) -> np.ndarray:
    return np.where(x == 0, np.nan, x)


def half_up(x: np.ndarray, digits: int, shift: float = 0.0) -> np.ndarray:
    """x + shift, rounded as Spark rounds doubles: by their shortest decimal form, halves away from zero."""
    scale = float(10**digits)
    x = x + shift
    scaled = x * scale
    whole = np.floor(scaled + 0.5)
    out = whole / scale
    # Farther from a half than sums and products of this size can err; others, and numbers too large for whole ones, need decimals.
    unsure = ~(np.abs(scaled - whole) + np.abs(scaled) * 2.0**-50 < 0.5 - 1e-9)
    for i in np.flatnonzero(unsure):
        v = float(x[i])
        out[i] = float(Decimal(repr(v)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) if abs(v) < 1e15 else v
    return out


class Groups:
    """Where the series (or blocks) of a chunk lie. ``first`` is a group's first row that counts: earlier rows only feed windows."""

    def __init__(self, starts: np.ndarray, rows: int, first: np.ndarray | None = None) -> None:
        self.starts, self.rows = starts, rows
        self.ends = np.append(starts[1:], rows)
        self.of = np.repeat(np.arange(len(starts)), self.ends - starts)
        self.at = np.arange(rows)
        self.pos = self.at - starts[self.of]
        self.first = starts if first is None else first
        self.settled = self.at >= self.first[self.of]

    def lag(self, x: np.ndarray, n: int = 1) -> np.ndarray:
        if n == 0:
            return x
        out = np.full(self.rows, np.nan)
        out[n:] = x[: max(0, self.rows - n)]
        out[self.pos < n] = np.nan
        return out

    def last_known(self, x: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """The last value of the group up to each row; ``before`` has, by group, what is known before it."""
        known = np.where(self.settled & ~np.isnan(x), self.at, -1)
        np.maximum.accumulate(known, out=known)
        here = known >= self.starts[self.of]
        return np.where(here, x[known], np.nan if before is None else before[self.of])

    def follow(self, inputs: np.ndarray, decays: np.ndarray, start: np.ndarray) -> np.ndarray:
        """y = decay * y + input, down the counted rows of each group, from ``start`` (by group); one column per recurrence."""
        out = np.full(inputs.shape, np.nan)
        lengths = self.ends - self.first
        counts = -(-lengths // SEGMENT)
        group = np.repeat(np.arange(len(lengths)), counts)
        part = np.arange(len(group)) - np.repeat(np.cumsum(counts) - counts, counts)
        begin = self.first[group] + part * SEGMENT
        size = np.minimum(SEGMENT, self.ends[group] - begin)
        order = np.argsort(-size, kind="stable")
        begin, size, group, part = begin[order], size[order], group[order], part[order]
        y = np.where((part == 0)[:, None], start[group], 0.0)
        open_ = np.searchsorted(-size, -np.arange(size.max(initial=0)), side="left")
        for t, k in enumerate(open_):
            row = begin[:k] + t
            y = y[:k] * decays + inputs[row]
            out[row] = y
        if counts.max(initial=0) > 1:
            powers = decays ** np.arange(1, SEGMENT + 1)[:, None]
            for i in np.lexsort((part, group)):
                if part[i]:
                    rows = slice(begin[i], begin[i] + size[i])
                    out[rows] += powers[: size[i]] * out[begin[i] - 1]
        return out


@dataclass
class Chunk:
    """Bars of whole groups, and columns made of them; each is made once, when it is first asked for."""

    groups: Groups
    rn: np.ndarray
    raw: dict[str, np.ndarray]
    recurrences: Sequence[str]
    #: By group, what the blocks before leave: recurrences, and values last known.
    before: dict[str, np.ndarray]

    def __post_init__(self) -> None:
        self.made: dict[str, np.ndarray] = {**self.raw, "PRICE": self.raw["CLOSE"]}

    def __getitem__(self, name: str) -> np.ndarray:
        if name not in self.made:
            self.made[name] = self._make(name)
        return self.made[name]

    def _make(self, name: str) -> np.ndarray:
        if m := _WINDOWED.match(name):
            kind, n = m.group(1), int(m.group(2))
            if kind in ("MA", "VMA"):
                return self.mean(n, "CLOSE" if kind == "MA" else "VOLUME")
            return self.extreme(n, "HIGH", np.maximum) if kind == "HH" else self.extreme(n, "LOW", np.minimum)
        if m := _RETURN.match(name):
            return (self["CLOSE"] / nz(self.groups.lag(self["CLOSE"], int(m.group(1)))) - 1) * 100
        if name in self.recurrences:
            self._average([n for n in self.recurrences if (n in SECOND) == (name in SECOND)])
            return self.made[name]
        return _COLUMNS[name](self)

    def lag(self, name: str, n: int = 1) -> np.ndarray:
        return self.groups.lag(self[name], n)

    def _part(self, n: int, name: str) -> np.ndarray:
        """Sum of the last n rows, added from the oldest to the newest."""
        key, x = f"_SUM{n}_{name}", self[name]
        if key not in self.made:
            out = self.groups.lag(x, n - 1)
            for k in range(min(n - 2, len(x)), -1, -1):
                np.add(out[k:], x[: len(x) - k], out=out[k:])
            self.made[key] = out
        return self.made[key]

    def total(self, n: int, name: str) -> np.ndarray:
        """Sum of the last n rows, null unless all are present."""
        return reduce(np.add, [self.groups.lag(self._part(size, name), at) for size, at in sum_parts(n)])

    def mean(self, n: int, name: str) -> np.ndarray:
        return self.total(n, name) / float(n)

    def extreme(self, n: int, name: str, fold: Callable) -> np.ndarray:
        """Greatest or least of the last n rows, from frames of 1, 2, 4, ... rows."""
        held, x = 1, self[name]
        while held < n:
            step = min(held, n - held)
            key = f"_{fold.__name__}{held + step}_{name}"
            if key not in self.made:
                self.made[key] = fold(x, self.groups.lag(x, step))
            x, held = self.made[key], held + step
        return x

    def count(self, n: int, hit: np.ndarray) -> np.ndarray:
        """Rows that hit among the last n (or as many as the group has), from row n - 1 of the series on."""
        so_far = np.concatenate(([0.0], np.cumsum(hit)))
        g = self.groups
        since = np.maximum(g.at + 1 - n, g.starts[g.of])
        return np.where(self.rn >= n - 1, so_far[g.at + 1] - so_far[since], np.nan)

    def _average(self, names: Sequence[str]) -> None:
        inputs = np.column_stack([np.nan_to_num(self.input_of(n), nan=0.0, posinf=np.inf, neginf=-np.inf) for n in names])
        nothing = np.zeros(len(self.groups.starts))
        start = np.column_stack([np.nan_to_num(self.before.get(n, nothing)) for n in names])
        found = self.groups.follow(inputs, np.array([decay_of(n) for n in names]), start)
        self.made |= {n: np.ascontiguousarray(found[:, i]) for i, n in enumerate(names)}

    def input_of(self, name: str) -> np.ndarray:
        rn = self.rn
        if name in WILDER:
            x = self[WILDER[name]]
            out = np.where(rn < WILDER_ROWS - 1, 0.0, x)
            # The first 14 values enter as their sum at row 13.
            for i in np.flatnonzero(rn == WILDER_ROWS - 1):
                values = x[self.groups.starts[self.groups.of[i]] : i + 1]
                out[i] = reduce(lambda a, b: a + b, values[~np.isnan(values)].tolist(), 0.0)
            return out
        if name == "_ADX":
            dx = self["_DX"]
            out = np.where(rn < FIRST_FULL_DX, 0.0, dx / float(WILDER_ROWS))
            for i in np.flatnonzero(rn == FIRST_FULL_DX):
                seed = dx[max(self.groups.starts[self.groups.of[i]], i - FIRST_FULL_DX + WILDER_ROWS) : i + 1]
                seed = seed[~np.isnan(seed)].tolist()
                out[i] = reduce(lambda a, b: a + b, seed, 0.0) / len(seed) if seed else np.nan
            return out
        x = self["MACD_LINE" if name == "MACD_SIGNAL" else "CLOSE"]
        if name != "MACD_SIGNAL" and np.isnan(x).any():
            raise ValueError("CLOSE is missing on a bar: reject such bars before averaging")
        return np.where(rn == 0, x, ema_step(_span(name)) * x)

    def enough(self, row: int) -> np.ndarray:
        """Rows from ``row`` on of groups with the 28 rows that directional movement asks for."""
        g = self.groups
        return (self.rn >= row) & ((g.ends - g.starts)[g.of] >= 2 * WILDER_ROWS)

    def missing_dx(self) -> np.ndarray:
        """Rows that lack a DX which the index needs: it is missing from there on."""
        rn, settled = self.rn, self.groups.settled
        seed = np.isnan(self.input_of("_ADX")) & (rn == FIRST_FULL_DX)
        return settled & (seed | ((rn > FIRST_FULL_DX) & np.isnan(self["_DX"])))


def _flag(hit: np.ndarray) -> np.ndarray:
    return hit.astype(np.int32)


def _clipped(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0.0)


def _one_sided(this: str, other: str) -> Callable[[Chunk], np.ndarray]:
    return lambda b: np.where((b[this] > b[other]) & (b[this] > 0), b[this], 0.0)


def _three(hit: Callable[[Chunk], np.ndarray]) -> Callable[[Chunk], np.ndarray]:
    def build(b: Chunk) -> np.ndarray:
        x = hit(b).astype(float)
        return _flag((x == 1) & (b.groups.lag(x, 1) == 1) & (b.groups.lag(x, 2) == 1) & (b.rn >= 2))

    return build


def _true_range(b: Chunk) -> np.ndarray:
    before = b["PREVIOUS_PRICE"]
    return np.fmax(np.fmax(np.abs(b["HIGH"] - b["LOW"]), np.abs(b["HIGH"] - before)), np.abs(b["LOW"] - before))


def _squares(b: Chunk) -> np.ndarray:
    """Squared deviations of 10 rows from their mean, added row by row (Welford)."""
    mean = m2 = np.zeros(b.groups.rows)
    for k in range(1, 11):
        delta = b.groups.lag(b["CLOSE"], 10 - k) - mean
        part = delta / float(k)
        mean, m2 = mean + part, m2 + delta * (delta - part)
    return m2 / 10.0 * 10.0


def _deviation(b: Chunk) -> np.ndarray:
    total = b.total(10, "CLOSE")
    apart = (total - b.groups.lag(total, 10)) / 10.0
    return np.sqrt((b["_SQ10"] + b.lag("_SQ10", 10) + apart * apart * 5.0) / 19.0)


def _upper(b: Chunk) -> np.ndarray:
    return b["HIGH"] - np.fmax(b["CLOSE"], b["OPEN"])


def _lower(b: Chunk) -> np.ndarray:
    return np.fmin(b["CLOSE"], b["OPEN"]) - b["LOW"]


def _shadow(long_side: Callable, short_side: Callable) -> Callable[[Chunk], np.ndarray]:
    def build(b: Chunk) -> np.ndarray:
        body = b["_BODY"]
        return _flag((long_side(b) >= body * 2) & (short_side(b) <= body * 0.5) & (body < (b["HIGH"] - b["LOW"]) * 0.2))

    return build


def _star(first: Callable, now: Callable) -> Callable[[Chunk], np.ndarray]:
    def build(b: Chunk) -> np.ndarray:
        small_before = b.lag("_BODY") < b.lag("_BODY10") * 0.3
        return _flag(first(b.lag("CLOSE", 2), b.lag("OPEN", 2)) & small_before & now(b["CLOSE"], b["OPEN"]))

    return build


def _level(part: float) -> Callable[[Chunk], np.ndarray]:
    return lambda b: b["HH50"] - (b["HH50"] - b["LL50"]) * part


def _directional(name: str) -> Callable[[Chunk], np.ndarray]:
    return lambda b: np.where(b.enough(WILDER_ROWS - 1), b[name] / nz(b["_WTR"]) * 100, np.nan)


def _dx(b: Chunk) -> np.ndarray:
    plus, minus = b["ADX_PLUS"], b["ADX_MINUS"]
    return np.abs(plus - minus) / nz(np.abs(plus) + np.abs(minus)) * 100


def _adx(b: Chunk) -> np.ndarray:
    g = b.groups
    bad = np.concatenate(([0], np.cumsum(b.missing_dx())))
    broken = bad[g.at + 1] > bad[g.starts[g.of]]
    if "broken" in b.before:
        broken |= b.before["broken"][g.of] > 0
    return np.where(b.enough(FIRST_FULL_DX) & ~broken, b["_ADX"], np.nan)


_COLUMNS: dict[str, Callable[[Chunk], np.ndarray]] = {
    "_BODY": lambda b: np.abs(b["CLOSE"] - b["OPEN"]),
    "_BODY10": lambda b: b.mean(10, "_BODY"),
    "_MONEY": lambda b: (b["HIGH"] + b["LOW"] + b["CLOSE"]) / 3 * b["VOLUME"],
    "PREVIOUS_PRICE": lambda b: b.lag("CLOSE"),
    "_TR": _true_range,
    "_GAIN": lambda b: _clipped(b["CLOSE"] - b["PREVIOUS_PRICE"]),
    "_LOSS": lambda b: _clipped(b["PREVIOUS_PRICE"] - b["CLOSE"]),
    "_RISE": lambda b: b["HIGH"] - b.lag("HIGH"),
    "_FALL": lambda b: b.lag("LOW") - b["LOW"],
    "_UP": _one_sided("_RISE", "_FALL"),
    "_DOWN": _one_sided("_FALL", "_RISE"),
    "THREE_RED_CANDLES": _three(lambda b: b["CLOSE"] < b["OPEN"]),
    "THREE_GREEN_CANDLES": _three(lambda b: b["CLOSE"] > b["OPEN"]),
    "VOLUME_SPIKE": lambda b: b["VOLUME"] / nz(b["VMA30"]),
    "RVOL": lambda b: b["VOLUME"] / nz(b["VMA10"]),
    "VWMA": lambda b: b.total(20, "_MONEY") / nz(b.total(20, "VOLUME")),
    "VWAP": lambda b: b["VWMA"],
    "TRADE_FREQUENCY": lambda b: b["VOLUME"] / nz(b["VMA20"]) * 100,
    "HIGH_VOL_DAYS": lambda b: b.count(30, b["VOLUME"] > b["VMA20"] * 1.5),
    "PERCENT_SPIKE": lambda b: b.count(30, b["PRICE_RETURN_1D_PCT"] >= 1),
    "ATR14": lambda b: b.mean(14, "_TR"),
    "_SQ10": _squares,
    "_SD20": _deviation,
    "BB_MIDDLE": lambda b: b["MA20"],
    "BB_UPPER": lambda b: b["BB_MIDDLE"] + b["_SD20"] * 2,
    "BB_LOWER": lambda b: b["BB_MIDDLE"] - b["_SD20"] * 2,
    "BB_WIDTH": lambda b: b["BB_UPPER"] - b["BB_LOWER"],
    "BB_PERCENT_B": lambda b: (b["CLOSE"] - b["BB_LOWER"]) / nz(b["BB_WIDTH"]),
    "SUPPORT": lambda b: b["MA20"] - b["ATR14"] * 1.5,
    "RESISTANCE": lambda b: b["MA20"] + b["ATR14"] * 1.5,
    "RSI14": lambda b: 100 - 100 / (1 + b.mean(14, "_GAIN") / nz(b.mean(14, "_LOSS"))),
    "STOCH_K": lambda b: (b["CLOSE"] - b["LL14"]) / nz(b["HH14"] - b["LL14"]) * 100,
    "STOCH_D": lambda b: b.mean(3, "STOCH_K"),
    "MACD_LINE": lambda b: b["_EMA12"] - b["_EMA26"],
    "MACD_HISTOGRAM": lambda b: b["MACD_LINE"] - b["MACD_SIGNAL"],
    "FIB_236": _level(0.236),
    "FIB_382": _level(0.382),
    "FIB_50": _level(0.5),
    "FIB_618": _level(0.618),
    "DOJI": lambda b: _flag(b["_BODY"] < b["_BODY10"] * 0.1),
    "HAMMER": _shadow(_lower, _upper),
    "HANGING_MAN": lambda b: b["HAMMER"],
    "SHOOTING_STAR": _shadow(_upper, _lower),
    "MORNING_STAR": _star(lambda close, open_: close < open_, lambda close, open_: close > open_),
    "EVENING_STAR": _star(lambda close, open_: close > open_, lambda close, open_: close < open_),
    "ADX_PLUS": _directional("_WUP"),
    "ADX_MINUS": _directional("_WDOWN"),
    "_DX": _dx,
    "ADX14": _adx,
}


def known(name: str) -> bool:
    return name in _COLUMNS or name in ("OPEN", "HIGH", "LOW", "CLOSE", "PRICE", "VOLUME", "MACD_SIGNAL") or any(p.match(name) for p in (_WINDOWED, _EXPONENTIAL, _RETURN))


# --- batches ------------------------------------------------------------------------------------


def whole_groups(batches: Iterator[pa.RecordBatch], rows: int = CHUNK_ROWS) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about ``rows``, none of which ends inside a group.

    ``_at`` is 0 on a group's first row, or ``_ends`` is true on its last one.
    """
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if count >= rows:
            if "_at" in batch.schema.names:
                heads = np.flatnonzero(batch["_at"].to_numpy() == 0)
            else:
                heads = np.flatnonzero(booleans(batch["_ends"])) + 1
            if len(heads):
                yield pa.concat_batches([*held, batch.slice(0, heads[0])])
                held, count, batch = [], 0, batch.slice(heads[0])
        if batch.num_rows:
            held.append(batch)
            count += batch.num_rows
    if held:
        yield pa.concat_batches(held)


def booleans(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(bool)


def floats(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)


@dataclass(frozen=True)
class Pass:
    """What a pass over bars is to make; sent to the tasks."""

    keys: tuple[str, ...]
    kept: tuple[str, ...]
    names: tuple[str, ...]
    recurrences: tuple[str, ...]
    carried: tuple[str, ...] = ()
    zero: bool = True
    block_rows: int | None = None
    digits: int | None = None
    shift: float = 0.0
    latest: bool = False
    #: What ``_before`` has on a block's first row, and what this pass leaves to the blocks after.
    before: tuple[str, ...] = ()
    left: tuple[str, ...] = ()

    def chunk(self, batch: pa.RecordBatch) -> Chunk:
        rn = batch["_rn"].to_numpy().astype(np.int64)
        starts = np.flatnonzero(batch["_at"].to_numpy() == 0)
        first = None
        if self.block_rows:
            begin = batch["_block"].to_numpy()[starts].astype(np.int64) * self.block_rows
            # A block after the end of a series has no row of its own.
            first = np.minimum(starts + np.maximum(0, begin - rn[starts]), np.append(starts[1:], batch.num_rows))
        groups = Groups(starts, batch.num_rows, first)
        raw = {n: floats(batch[n]) for n in ("OPEN", "HIGH", "LOW", "CLOSE", "VOLUME") if n in batch.schema.names}
        before = np.full((len(starts), len(self.before)), np.nan)
        if "_before" in batch.schema.names:
            given = batch["_before"].take(pa.array(starts))
            values = np.frombuffer(b"".join(given.drop_null().to_pylist()), dtype=np.float64)
            before[given.is_valid().to_numpy(zero_copy_only=False)] = values.reshape(-1, len(self.before))
        return Chunk(groups, rn, raw, self.recurrences, {n: np.ascontiguousarray(before[:, i]) for i, n in enumerate(self.before)})

    def last_own(self, chunk: Chunk) -> np.ndarray:
        g = chunk.groups
        return np.minimum(g.ends, g.first + self.block_rows) - 1

    def columns(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bars with the asked columns, filled; ``_ends`` marks the last row of a group."""
        for batch in whole_groups(batches):
            with np.errstate(all="ignore"):
                chunk = self.chunk(batch)
                made = {n: self._filled(chunk, n) for n in self.names}
            ends = np.zeros(batch.num_rows, dtype=bool)
            ends[chunk.groups.ends - 1] = True
            arrays = [batch[n] for n in self.kept]
            arrays += [pa.array(x, from_pandas=not self.zero) for x in made.values()]
            out = pa.RecordBatch.from_arrays([*arrays, pa.array(ends)], names=[*self.kept, *self.names, "_ends"])
            # Rows before a block have fed its windows.
            wanted = chunk.groups.settled & ends if self.latest else chunk.groups.settled
            yield out.filter(pa.array(wanted)) if self.block_rows else out

    def _filled(self, chunk: Chunk, name: str) -> np.ndarray:
        x = chunk[name]
        if x.dtype != np.float64:
            return x
        if name in self.carried:
            x = chunk.groups.last_known(x, chunk.before.get(f"known_{name}"))
        if self.zero:
            x = np.where(np.isnan(x), 0.0, x)
        return x if self.digits is None else half_up(x, self.digits, self.shift)

    def ends(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per block: where the first recurrences stand at its end when they begin with nothing, and what is last known."""
        first = [n for n in self.recurrences if n not in SECOND]
        for batch in whole_groups(batches):
            with np.errstate(all="ignore"):
                chunk = self.chunk(batch)
                at = self.last_own(chunk)
                made = {f"_e_{n}": chunk[n][at] for n in first}
                local = [n for n in self.carried if not n.startswith("ADX")]
                made |= {f"_e_known_{n}": chunk.groups.last_known(chunk[n])[at] for n in local}
            yield self._of_blocks(batch, at, made)

    def second_ends(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per block: the same for what reads the first recurrences, which are known now."""
        second = [n for n in self.recurrences if n in SECOND]
        for batch in whole_groups(batches):
            with np.errstate(all="ignore"):
                chunk = self.chunk(batch)
                at = self.last_own(chunk)
                made = {f"_e_{n}": chunk[n][at] for n in second}
                local = [n for n in self.carried if n in ("ADX_PLUS", "ADX_MINUS")]
                made |= {f"_e_known_{n}": chunk.groups.last_known(chunk[n])[at] for n in local}
                if "_ADX" in second:
                    made |= self._index(chunk, at)
            yield self._of_blocks(batch, at, made)

    def _index(self, chunk: Chunk, at: np.ndarray) -> dict[str, np.ndarray]:
        """The last row of each block that has the index, as if the blocks before left nothing, and how many rows it is in."""
        g = chunk.groups
        bad = np.concatenate(([0], np.cumsum(chunk.missing_dx())))
        broken = bad[at + 1] > bad[g.starts]
        index = _adx(chunk)
        shown = np.where(np.isnan(index) | (g.at > at[g.of]), -1, g.at)
        np.maximum.accumulate(shown, out=shown)
        row = shown[at]
        has = row >= g.starts
        return {
            "_e_broken": broken.astype(float),
            "_e_known_ADX14": np.where(has, chunk["_ADX"][row], np.nan),
            "_e_shown": np.where(has, row - g.first + 1, np.nan).astype(float),
        }

    def _of_blocks(self, batch: pa.RecordBatch, at: np.ndarray, made: dict[str, np.ndarray]) -> pa.RecordBatch:
        keys = batch.select(list(self.keys)).take(pa.array(at))
        return pa.RecordBatch.from_arrays([*keys.columns, *[pa.array(x.astype(float), from_pandas=True) for x in made.values()]], names=[*self.keys, *made])

    def carry(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From rows of blocks, in order: what all blocks up to one leave to the next."""
        for batch in whole_groups(batches):
            groups = Groups(np.flatnonzero(batch["_at"].to_numpy() == 0), batch.num_rows)
            ends = {n: floats(batch[f"_e_{n}"]) for n in self.left}
            found = {}
            averages = [n for n in self.recurrences if n in ends]
            if averages:
                inputs = np.nan_to_num(np.column_stack([ends[n] for n in averages]))
                decays = np.array([decay_of(n) ** self.block_rows for n in averages])
                stand = groups.follow(inputs, decays, np.zeros((len(groups.starts), len(averages))))
                found = {n: np.ascontiguousarray(stand[:, i]) for i, n in enumerate(averages)}
            if "broken" in ends:
                bad = np.concatenate(([0.0], np.cumsum(ends["broken"])))
                none = bad[groups.starts[groups.of]]
                found["broken"] = (bad[groups.at + 1] > none).astype(float)
                index = ends["known_ADX14"] + WILDER_DECAY ** ends["shown"] * np.nan_to_num(groups.lag(found["_ADX"]))
                ends["known_ADX14"] = np.where(bad[groups.at] > none, np.nan, index)
            found |= {n: groups.last_known(x) for n, x in ends.items() if n.startswith("known_")}
            values = np.column_stack([found[n] for n in self.left if n in found])
            # Bytes: rows with lists of numbers are written to Arrow many times more slowly.
            before = pa.array([row.tobytes() for row in values], pa.binary())
            keys = [pa.array(batch[n].to_numpy() + 1) if n == "_block" else batch[n] for n in self.keys]
            yield pa.RecordBatch.from_arrays([*keys, before], names=[*self.keys, "_before"])


def groups_in_order(batch: pa.RecordBatch, keys: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """First and last row of each group, by ``_ends``; an error unless the rows of each key lie together and in order."""
    ends = np.flatnonzero(booleans(batch["_ends"]))
    starts = np.append(0, ends[:-1] + 1)
    changes = np.zeros(batch.num_rows, dtype=bool)
    changes[0] = True
    for k in keys:
        codes = batch[k].dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        changes[1:] |= codes[1:] != codes[:-1]
    forward = np.diff(batch["rn"].to_numpy()) > 0
    together = len(ends) > 0 and ends[-1] == batch.num_rows - 1 and np.array_equal(np.flatnonzero(changes), starts)
    if not (together and (forward | changes[1:]).all()):
        raise ValueError("the bars of a group must lie together and in order: drop _ends from frames whose rows were moved or left out")
    return starts, ends
