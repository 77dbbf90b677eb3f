"""Row-count windows over one bar series.

Every frame is a ROWS frame: windows count bars, not calendar days. Spark adds up
a sliding frame anew for each row, so a 200-row frame costs 200 additions per row. Long frames
are therefore put together from sums of 10 and 50 rows fetched with ``lag``: MA200 is four
50-row sums. Beyond 250 rows the rows are cut into stretches of n: a frame of n rows is the end of one
stretch and the head of the next, and both are running values (``head`` and ``tail``), so the work per row and the
plan do not grow with n. Sums are only ever added, never subtracted, so no digits are lost to cancellation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

SMALL_ROWS = 10
LARGE_ROWS = 50
# Longer frames are put together from running values of stretches.
LONGEST_PARTED = 250


class Rolling:
    """Frames sharing one partitioning and one order, so Spark plans them on a single sort."""

    def __init__(self, keys: Sequence[str], order: str = "date") -> None:
        self.keys, self.order = tuple(keys), order
        self.ordered = Window.partitionBy(*keys).orderBy(order)
        self.so_far = self.ordered.rowsBetween(Window.unboundedPreceding, 0)
        self.before = self.ordered.rowsBetween(Window.unboundedPreceding, -1)
        self.whole = self.ordered.rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing
        )

    def trailing(self, n: int):
        return self.ordered.rowsBetween(-(n - 1), 0)

    def head(self, n: int):
        """From the start of the row's stretch of n rows to the row."""
        stretch = Window.partitionBy(*self.keys, F.floor(F.col("_rn") / n)).orderBy(self.order)
        return stretch.rowsBetween(Window.unboundedPreceding, 0)

    def tail(self, n: int):
        """From the row to the end of its stretch; read backwards, so that it is a running frame too."""
        stretch = Window.partitionBy(*self.keys, F.floor(F.col("_rn") / n)).orderBy(F.desc(self.order))
        return stretch.rowsBetween(Window.unboundedPreceding, 0)

    def lag(self, c: Column, n: int = 1) -> Column:
        return c if n == 0 else F.lag(c, n).over(self.ordered)

    def run_length(self, c: Column) -> Column:
        """How many rows in a row, up to this one, have a value."""
        last_null = F.max(F.when(c.isNull(), F.col("_rn"))).over(self.so_far)
        return F.col("_rn") - F.coalesce(last_null, F.lit(-1))

    def total(self, c: Column) -> Column:
        return F.sum(c).over(self.so_far)

    def last_known(self, c: Column) -> Column:
        return F.last(c, ignorenulls=True).over(self.so_far)


def sum_parts(n: int) -> list[tuple[int, int]]:
    """(rows, offset) of the partial sums that tile a frame of n rows."""
    parts: list[tuple[int, int]] = []
    at = 0
    for size in (LARGE_ROWS, SMALL_ROWS) if n >= 2 * LARGE_ROWS else (SMALL_ROWS,):
        while n - at >= size:
            parts.append((size, at))
            at += size
    if n > at:
        parts.append((n - at, at))
    return parts


def extreme_parts(n: int) -> list[tuple[int, int]]:
    """(rows, offset) of equal, possibly overlapping frames that cover a frame of n rows."""
    size = LARGE_ROWS if n >= 2 * LARGE_ROWS else SMALL_ROWS
    if n <= size:
        return [(n, 0)]
    offsets = list(range(0, n - size, size)) + [n - size]
    return [(size, at) for at in offsets]
