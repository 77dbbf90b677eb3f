"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time

from barquarry.operators.indicators import add_technical
from barquarry.operators.layout import BlockLayout
from barquarry.operators.strategy import Strategy
from barquarry.plans.catalog import QUERIES, compliance, day_bars, inputs
from barquarry.plans.presets import example, shipped
from barquarry.plans.requests import backtest_request, scan_request
from barquarry.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def _indicators(*names: str):
    """Indicator columns as computed, without the rounding the side-by-side check needs."""

    def run(spark, sf_dir):
        bars, layout = inputs(spark, sf_dir)
        return add_technical(bars, layout, names or None, complete=True)

    return run


def _scan(spark, sf_dir):
    bars, layout = inputs(spark, sf_dir)
    return scan_request(bars, shipped(), compliance(spark, sf_dir), layout, complete=True)


def _backtest(strategies, part):
    def run(spark, sf_dir):
        bars, layout = inputs(spark, sf_dir, hold=max(s.max_hold for s in strategies))
        return backtest_request(bars, strategies, layout, complete=True)[part]

    return run


def _blocks(spark, sf_dir):
    """The layout of long series, forced on day bars."""
    strategies = shipped()
    layout = BlockLayout(block_rows=512, lookback=512, lookahead=max(s.max_hold for s in strategies))
    return backtest_request(day_bars(spark, sf_dir), strategies, layout, complete=True)[0]


LONG = Strategy.from_mapping(
    {"name": "LONG", "entry": ["CLOSE < MA50"], "tp": ["CLOSE * 1.9"], "sl": ["ENTRY_PRICE * 0.05"], "max_hold_days": 200}
)

HEADLINE = {
    "size_check": lambda spark, sf_dir: day_bars(spark, sf_dir).groupBy("symbol").count(),
    "bars": day_bars,
    "all_61_columns": _indicators(),
    "moving_averages": _indicators("MA5", "MA10", "MA20", "MA50", "MA100", "MA200"),
    "macd": _indicators("MACD_LINE", "MACD_SIGNAL", "MACD_HISTOGRAM"),
    "adx": _indicators("ADX14", "ADX_PLUS", "ADX_MINUS"),
    "signal_rows": QUERIES["p05_p06_t02_t03_x2_signal_rows"],
    "scan": _scan,
    "trades_3_strategies": _backtest(shipped(), 0),
    "trades_block_layout": _blocks,
    "trades_hold_200": _backtest([LONG], 0),
    "trades_averaging": _backtest([example("MULTI_AVG_STRATEGY")], 0),
    "symbol_summary": _backtest(shipped(), 1),
    "fundamentals": QUERIES["j1_bars_with_fundamentals"],
}


def main() -> None:
    spark = local_session(CPUS, int(CPUS) if CPUS.isdigit() else 8)
    # One small run starts the JVM's class loading and the Python workers.
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name, query in HEADLINE.items():
        began = time.perf_counter()
        query(spark, SF_DIR).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    scale = re.search(r"sf([\d.]+)", SF_DIR)
    print(
        json.dumps(
            {
                "metric": "headline queries, total seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(scale.group(1)) if scale else SF_DIR,
            }
        )
    )


if __name__ == "__main__":
    main()
