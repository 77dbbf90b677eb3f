"""First-order recurrences y[t] = q * y[t-1] + u[t] as window sums.

Exponential and Wilder averages have this form. Unrolled, y[t] = q^t * sum(u[k] * q^-k), one
cumulative sum per recurrence. q^-k leaves the range of a double on long series, so these are
cut into segments; the value at the end of a segment then needs only the few earlier segments
whose weight a double can still hold.

In a block layout every block is an affine map of the value before it: y -> end + q^rows * y, where
``end`` is the block's own sum. The maps of a series are composed over one row per block, which is
a recurrence again, and what is carried into a block is added to its own sums. So no
rows before a block are needed, whatever the decay.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barquarry.functions.rolling import Rolling
from barquarry.operators.layout import Layout
from barquarry.session import computed_once

_SAFE_EXPONENT = 280  # q^-k is kept below 1e280
_VANISHED_EXPONENT = 330  # weights below 1e-330 are zero as doubles


def _decades(q: float) -> float:
    return -math.log10(q)


def decayed_sums(df: DataFrame, layout: Layout, specs: dict[str, tuple[str, float]]) -> DataFrame:
    """Add one column per spec ``{output: (input column, q)}``. Null inputs add nothing.

    In a block layout the columns are null on the rows before the block.
    """
    if not layout.blocked:
        return _own_sums(df, layout.keys, specs, layout.max_rows, layout.segment_rows)
    begin = F.col("_block") * F.lit(layout.block_rows)
    # The inputs are those of the recurrences alone, so they are masked in place.
    masked = {u: F.when(layout.settled(), F.col(u)) for u, _ in specs.values()}
    rows = layout.block_rows + layout.lookahead
    df = _own_sums(df.withColumns(masked), layout.keys, specs, rows, layout.segment_rows, begin)
    df = df.join(_carried(df, layout, {out: q for out, (_, q) in specs.items()}), ["symbol", "_block"], "left")
    whole = {
        out: F.when(
            layout.settled(),
            F.col(out) + F.pow(F.lit(q), F.col("_rn") - begin + 1) * F.coalesce(F.col(f"_c_{out}"), F.lit(0.0)),
        )
        for out, (_, q) in specs.items()
    }
    return df.withColumns(whole).drop(*[f"_c_{out}" for out in specs])


def _carried(df: DataFrame, layout: Layout, decays: dict[str, float]) -> DataFrame:
    """symbol, _block and, for each output, its value on the last row before the block."""
    ends = df.where(layout.own()).groupBy("symbol", "_block").agg(*[F.max_by(out, "_rn").alias(out) for out in decays])
    # Numbered from 0 in each series; all blocks but the last are full, so each step decays by q^block_rows.
    ends = computed_once(ends.withColumns({"_rn": F.col("_block"), "date": F.col("_block")}))
    steps = {out: q**layout.block_rows for out, q in decays.items()}
    slow = {out: (out, step) for out, step in steps.items() if step > 1e-100}
    if slow:
        sums = _own_sums(ends, ["symbol"], {f"_y_{out}": s for out, s in slow.items()}, None)
    else:
        sums = ends
    roll = Rolling(["symbol"])
    # Where two blocks leave less than 1e-100, what comes before them is below the last digit of any double.
    fast = {f"_y_{out}": F.col(out) + step * F.coalesce(roll.lag(F.col(out)), F.lit(0.0)) for out, step in steps.items() if out not in slow}
    sums = sums.withColumns(fast)
    return computed_once(sums.select("symbol", "_block", *[roll.lag(F.col(f"_y_{out}")).alias(f"_c_{out}") for out in decays]))


def _own_sums(
    df: DataFrame,
    keys: Sequence[str],
    specs: dict[str, tuple[str, float]],
    max_rows: int | None,
    segment_rows: int | None = None,
    begin: Column | None = None,
) -> DataFrame:
    """The recurrences over the rows of each group from row ``begin`` on, started with 0."""
    roll = Rolling(keys)
    place = F.col("_rn") if begin is None else F.col("_rn") - begin
    span = min(int(_SAFE_EXPONENT / _decades(q)) for _, q in specs.values())
    if segment_rows is None and max_rows is not None and max_rows <= span:
        return df.withColumn("_j", place).withColumns(
            {
                out: F.sum(F.coalesce(F.col(u), F.lit(0.0)) * F.pow(F.lit(q), -F.col("_j"))).over(
                    roll.so_far
                )
                * F.pow(F.lit(q), F.col("_j"))
                for out, (u, q) in specs.items()
            }
        ).drop("_j")

    seg = segment_rows or 2 ** int(math.log2(span))
    in_segment = (
        Window.partitionBy(*keys, "_seg")
        .orderBy("date")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    df = df.withColumns({"_seg": F.floor(place / F.lit(seg)), "_j": F.pmod(place, F.lit(seg))})
    df = df.withColumns(
        {
            f"_local_{out}": F.sum(
                F.coalesce(F.col(u), F.lit(0.0)) * F.pow(F.lit(q), -F.col("_j"))
            ).over(in_segment)
            * F.pow(F.lit(q), F.col("_j"))
            for out, (u, q) in specs.items()
        }
    )
    # Sums over 2, 4, 8, ... segments, each of two sums over half as many, until the earlier ones have vanished.
    reach = {out: int(_VANISHED_EXPONENT / (_decades(q) * seg)) for out, (_, q) in specs.items()}
    df = df.withColumns({f"_end_{out}": F.col(f"_local_{out}") for out in specs})
    held = 1
    while held <= max(reach.values()):
        wider = {}
        for out, (_, q) in specs.items():
            if held <= reach[out]:
                total = F.col(f"_end_{out}")
                wider[f"_end_{out}"] = total + F.lit(q ** (seg * held)) * F.coalesce(roll.lag(total, seg * held), F.lit(0.0))
        df = df.withColumns(wider)
        held *= 2
    df = df.withColumns({f"_end_{out}": F.when(F.col("_j") == seg - 1, F.col(f"_end_{out}")) for out in specs})
    df = df.withColumns(
        {
            out: F.col(f"_local_{out}")
            + F.pow(F.lit(q), F.col("_j") + 1)
            * F.coalesce(
                F.last(F.col(f"_end_{out}"), ignorenulls=True).over(roll.before), F.lit(0.0)
            )
            for out, (_, q) in specs.items()
        }
    )
    helpers = [f"_local_{o}" for o in specs] + [f"_end_{o}" for o in specs]
    return df.drop("_seg", "_j", *helpers)
