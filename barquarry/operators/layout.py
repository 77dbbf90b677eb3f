"""How a bar series is split over tasks.

Nearly every operator is a window over one symbol's bars in date order. Daily bars are bounded
by the calendar, so a symbol is a small group whatever the number of ticks behind it. A symbol
with a very long series (fine-grained bars) would be one huge task, so there are two layouts
with the same results:

* ``SymbolLayout`` - one group per symbol; used when the longest series is proven short.
* ``BlockLayout`` - a series is cut into blocks of consecutive rows. A block also receives
  the rows just before it (``lookback``, which may span several blocks) and after it
  (``lookahead``), which feed windows and are dropped from the results. No group exceeds
  block + lookback + lookahead rows. Indicators refuse windows longer than the lookback; recurrences
  need none, as blocks hand their value on (``recurrence``). Blocks are written once, dealt out and in order, and
  read by every pass.

``choose_layout`` decides from a bound given by the caller or from one counted by Spark.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barquarry.session import dealt_once

if TYPE_CHECKING:
    from barquarry.operators.strategy import Strategy

ROWS_PER_GROUP_LIMIT = 200_000
BLOCK_ROWS = 131_072
# The longest window of a named column is 200 rows.
LOOKBACK_ROWS = 256
# Rows that one task sorts for its windows.
ROWS_PER_TASK = 250_000
DAY_SECONDS = 86_400
# Window lengths of named columns are at most this; longer ones say so in their names.
SHORTEST_LOOKBACK = 64
# The first directional index averages rows 14 to 27 of a series, which must lie in its first block.
SHORTEST_BLOCK = 32


@dataclass(frozen=True)
class SymbolLayout:
    """One window group per symbol. ``max_rows`` is the proven length of the longest series.

    ``tasks`` is the number of tasks that the symbols are dealt out to; Spark chooses it if there is none.
    """

    max_rows: int | None = None
    keys: tuple[str, ...] = ("symbol",)
    helpers: tuple[str, ...] = ("_rn",)
    blocked: bool = False
    segment_rows: int | None = None
    tasks: int | None = None

    def prepare(self, bars: DataFrame) -> DataFrame:
        if self.tasks is not None:
            bars = bars.repartition(self.tasks, "symbol")
        w = Window.partitionBy("symbol").orderBy("date")
        return bars.withColumn("_rn", F.row_number().over(w) - 1)

    def own(self) -> Column:
        return F.lit(True)

    def settled(self) -> Column:
        return F.lit(True)


@dataclass(frozen=True)
class BlockLayout:
    """Blocks of ``block_rows`` consecutive bars with neighbouring rows attached.

    Rows are numbered per symbol and day and the days' counts are added up, so numbering needs
    no group longer than the bars of one day, whatever the distance between bars.
    Series that are known to be short enough for one group (``whole``) are numbered in one.
    ``_more`` marks the rows of blocks that have a block after them. Blocks are dealt out to ``tasks`` tasks (as many as a shuffle has partitions if none are given) and put in
    order once; what is written keeps the deal, so passes over it move nothing.
    """

    block_rows: int = BLOCK_ROWS
    lookback: int = LOOKBACK_ROWS
    lookahead: int = 1
    segment_rows: int | None = None
    keys: tuple[str, ...] = ("symbol", "_block")
    helpers: tuple[str, ...] = ("_rn", "_block", "_own", "_last")
    blocked: bool = True
    tasks: int | None = None
    whole: bool = False

    def __post_init__(self) -> None:
        if self.lookahead > self.block_rows:
            raise ValueError("lookahead must not exceed block_rows")
        if self.block_rows < SHORTEST_BLOCK:
            raise ValueError(f"block_rows must be at least {SHORTEST_BLOCK}")
        if self.lookback < SHORTEST_LOOKBACK:
            raise ValueError(f"lookback must be at least {SHORTEST_LOOKBACK}")
        if self.lookahead < 1:
            raise ValueError("lookahead must be at least 1: it tells the last bar of a series")

    @property
    def max_rows(self) -> int:
        return self.block_rows + self.lookback + self.lookahead

    def prepare(self, bars: DataFrame) -> DataFrame:
        size = self.block_rows
        numbered = self._numbered_whole(bars) if self.whole else self._numbered_by_day(bars)
        home = F.floor(F.col("_rn") / F.lit(size))
        offset_in_block = F.col("_rn") % F.lit(size)
        onward = F.sequence(home, F.floor((F.col("_rn") + self.lookback) / F.lit(size)))
        back = F.when((offset_in_block < self.lookahead) & (home > 0), F.array(home - 1))
        copies = F.concat(onward, F.coalesce(back, F.array().cast("array<bigint>")))
        blocks = (
            numbered.withColumn("_home", home)
            .withColumn("_block", F.explode(copies))
            .withColumn("_own", F.col("_block") == F.col("_home"))
            .withColumn("_more", (F.col("_block") + 1) * F.lit(size) < F.col("_rows"))
            .drop("_home", "_rows")
        )
        tasks = self.tasks or int(bars.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return dealt_once(blocks, self.keys, "date", tasks)

    def _numbered_by_day(self, bars: DataFrame) -> DataFrame:
        sliced = bars.withColumn("_slice", F.to_date("date"))
        # One row per (symbol, day): the rows before each day, and the end of the series.
        series = Window.partitionBy("symbol").orderBy("_slice")
        earlier = series.rowsBetween(Window.unboundedPreceding, -1)
        whole = series.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        offsets = (
            sliced.groupBy("symbol", "_slice")
            .agg(F.count("*").alias("_n"), F.max("date").alias("_end"))
            .select(
                "symbol",
                "_slice",
                F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"),
                F.max("_end").over(whole).alias("_last"),
                F.sum("_n").over(whole).alias("_rows"),
            )
        )
        in_slice = Window.partitionBy("symbol", "_slice").orderBy("date")
        return (
            sliced.withColumn("_pos", F.row_number().over(in_slice) - 1)
            .join(offsets, ["symbol", "_slice"])
            .withColumn("_rn", F.col("_offset") + F.col("_pos"))
            .drop("_slice", "_pos", "_offset")
        )

    def _numbered_whole(self, bars: DataFrame) -> DataFrame:
        series = Window.partitionBy("symbol").orderBy("date")
        whole = series.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        known = bars.where(F.col("symbol").isNotNull() & F.col("date").isNotNull())
        place = (F.row_number().over(series) - 1).cast("bigint")
        return known.withColumns({"_rn": place, "_last": F.max("date").over(whole), "_rows": F.count(F.lit(1)).over(whole)})

    def own(self) -> Column:
        """The row belongs to this block and is part of its result."""
        return F.col("_own")

    def settled(self) -> Column:
        """The row has its full lookback in this block (own rows and rows after them)."""
        return F.col("_rn") >= F.col("_block") * F.lit(self.block_rows)


Layout = SymbolLayout | BlockLayout


def longest_series(bars: DataFrame) -> int:
    """Rows of the longest series. Reads only the symbol column; one number reaches the driver."""
    row = bars.groupBy("symbol").count().agg(F.max("count")).first()
    return int(row[0] or 0)


def grid_cells(ticks: DataFrame, ts: str, bar_seconds: int = DAY_SECONDS) -> int:
    """Bound on bars per symbol when ticks are put on a time grid: the cells of the grid."""
    row = ticks.agg(
        F.unix_timestamp(F.min(ts).cast("timestamp")), F.unix_timestamp(F.max(ts).cast("timestamp"))
    ).first()
    if row[0] is None:
        return 0
    return int(row[1] // bar_seconds - row[0] // bar_seconds + 1)


def tasks_of(rows: int) -> int:
    """Tasks of about ``ROWS_PER_TASK`` rows each."""
    return max(1, -(-rows // ROWS_PER_TASK))


def with_tasks(layout: Layout, bars: DataFrame, rows: int, longest: int | None = None) -> Layout:
    """A layout with tasks for ``rows`` rows (a bound will do); few rows in a layout by symbols are left to Spark.

    ``longest`` is the proven length of the longest series, if there is one.
    """
    least = bars.sparkSession.sparkContext.defaultParallelism
    if layout.blocked:
        whole = longest is not None and longest <= ROWS_PER_GROUP_LIMIT
        return replace(layout, tasks=max(least, tasks_of(rows * layout.max_rows // layout.block_rows)), whole=whole)
    tasks = tasks_of(rows)
    return layout if tasks <= least else replace(layout, tasks=tasks)


def choose_layout(
    bars: DataFrame,
    *,
    max_rows: int | None = None,
    lookahead: int = 1,
    lookback: int = LOOKBACK_ROWS,
    limit: int = ROWS_PER_GROUP_LIMIT,
    strategies: Sequence[Strategy] = (),
) -> Layout:
    """``lookback`` must cover the longest window asked (``indicators.longest_window``), ``lookahead`` the longest hold.

    Both are taken from ``strategies`` where these ask for more.
    """
    if strategies:
        from barquarry.operators.indicators import longest_window

        lookback = max(lookback, longest_window(n for s in strategies for n in s.columns))
        lookahead = max(lookahead, *(s.max_hold for s in strategies))
    bound = longest_series(bars) if max_rows is None else max_rows
    if bound <= limit:
        return SymbolLayout(max_rows=bound)
    return BlockLayout(lookahead=max(1, lookahead), lookback=max(LOOKBACK_ROWS, lookback))
