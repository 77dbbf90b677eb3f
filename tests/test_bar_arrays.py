"""Columns made in arrays are those of the windows, in short series and in blocks, and exits found in order are those of frames."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barquarry.operators import bar_arrays
from barquarry.operators.indicators import TECHNICAL_COLUMNS, add_technical, result_rows
from barquarry.operators.layout import BlockLayout, SymbolLayout
from barquarry.operators.scan import scan
from barquarry.operators.strategy import Strategy
from barquarry.operators.trades import in_range
from barquarry.plans import catalog
from barquarry.plans.requests import extract_trades
from tests.test_layout import compare, wavy_bars

SF_DIR = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("layout", [SymbolLayout(), BlockLayout(block_rows=256, lookback=200), BlockLayout(block_rows=300, lookback=256, whole=True)], ids=["series", "blocks", "whole"])
def test_arrays_give_the_columns_of_windows(spark, layout, monkeypatch):
    # Prices stand still over whole blocks, so that quotients lapse and the index breaks; one series is shorter than 28 bars.
    short = wavy_bars(spark, 20).withColumn("symbol", F.lit("SHORT"))
    bars = wavy_bars(spark, 2_500, flat=(900, 1_700), symbols=("HOT", "COLD")).unionByName(short)
    names = [*TECHNICAL_COLUMNS, "MA37", "LL120", "EMA50"]
    monkeypatch.setattr(bar_arrays, "CHUNK_ROWS", 1_000)
    a = result_rows(add_technical(bars, SymbolLayout(), names), SymbolLayout()).toPandas()
    made = add_technical(bars, layout, names, complete=True)
    assert "MapInArrow" in plan_of(made) and "var_pop" not in plan_of(made)
    b = result_rows(made, layout)
    assert b.columns == ["symbol", "date", *names]
    compare(a, b.toPandas(), names)


@pytest.mark.parametrize("name", ["w28_w29_all_61_columns", "block_all_61_columns", "block_scan", "block_trades"])
def test_large_queries_work_in_arrays(spark, name):
    plan = plan_of(catalog.QUERIES[name](spark, SF_DIR))
    assert "var_pop" not in plan and "collect_list(_bar" not in plan


def test_a_missing_close_is_an_error_of_averages(spark):
    bars = wavy_bars(spark, 100).withColumn("close", F.when(F.pmod(F.hour("date"), F.lit(7)) > 0, F.col("close")))
    blocks = BlockLayout(block_rows=64, lookback=64)
    # Windows go on without it.
    assert result_rows(add_technical(bars, blocks, ["RSI14"], complete=True), blocks).count() == 100
    with pytest.raises(Exception, match="missing on a bar"):
        add_technical(bars, blocks, ["MACD_LINE"], complete=True).collect()


@pytest.mark.parametrize("marks", [False, True])
def test_exits_in_order_are_those_of_frames(spark, marks):
    bars = wavy_bars(spark, 1_500, symbols=("HOT", "COLD"))
    strategies = [
        Strategy.from_mapping({"name": "A", "entry": ["CLOSE > MA20"], "tp": ["CLOSE + ATR14"], "sl": ["CLOSE - ATR14"], "max_hold_days": 6}),
        Strategy.from_mapping({"name": "B", "entry": ["CLOSE < MA5"], "ts": "1%", "sl": ["ENTRY_PRICE * 0.98", "LL20"], "max_hold_days": 9}),
        Strategy.from_mapping({"name": "C", "entry": ["RSI14 > 50"], "tp": ["CLOSE * 1.2"], "stop": "fixed", "sl": ["CLOSE * 0.9"], "max_hold_days": 60}),
        Strategy.from_mapping({"name": "D", "entry": ["CLOSE > MA5"], "sl": ["CASE WHEN CLOSE > 100 THEN MA5 ELSE 1 END"], "max_hold_days": 4}),
    ]
    columns = list(dict.fromkeys(n for s in strategies for n in s.columns))
    found = []
    for layout, complete in ((SymbolLayout(), False), (BlockLayout(block_rows=256, lookback=128, lookahead=60), True)):
        frame = in_range(add_technical(bars, layout, columns, complete=complete, decimals=8), layout, start="2017-07-20")
        assert ("_ends" in frame.columns) == complete
        found.append(sorted((tuple(map(str, r)) for r in extract_trades(frame, strategies, 1e6, layout, marks).collect())))
    assert found[0] == found[1]
    assert {r[0] for r in found[0]} == {"A", "B", "C", "D"} | ({"None"} if marks else set())


def test_a_scan_reads_last_blocks_only(spark):
    bars = wavy_bars(spark, 1_024 + 40, symbols=("HOT", "COLD"))
    s = [Strategy.from_mapping({"name": "ANY", "entry": ["CLOSE > 0", "ADX14 >= 0", "RSI14 > 0"], "tp": ["CLOSE + ATR14 + MACD_SIGNAL"]})]
    names, found = s[0].columns, []
    for layout, latest in ((SymbolLayout(), False), (BlockLayout(block_rows=512, lookback=128), True)):
        frame = add_technical(bars, layout, names, complete=True, decimals=8, latest=latest)
        found.append(sorted(map(str, scan(frame, s, layout).collect())))
        rows = frame.count()
    assert found[0] == found[1] and len(found[0]) == 2 and rows == 2


def test_rows_that_were_moved_are_refused():
    def batch(symbols, rn, ends):
        return pa.RecordBatch.from_pydict({"symbol": symbols, "rn": rn, "_ends": ends})

    starts, ends = bar_arrays.groups_in_order(batch(["A", "A", "B"], [0, 1, 0], [False, True, True]), ["symbol"])
    assert starts.tolist() == [0, 2] and ends.tolist() == [1, 2]
    for odd in ((["A", "B", "A"], [0, 0, 1], [False, True, True]), (["A", "A", "B"], [1, 0, 0], [False, True, True]), (["A", "A"], [0, 1], [False, False])):
        with pytest.raises(ValueError, match="in order"):
            bar_arrays.groups_in_order(batch(*odd), ["symbol"])


def test_rounding_is_that_of_spark(spark):
    values = [0.00005, -0.00005, 1.00015, 2.5e-9, 0.0, 1e15 + 0.3, -1e300, float("inf"), 123456.78905, -1e-9, 1.005, 99999.999999995, -7.000000005]
    values += (np.random.default_rng(3).normal(0, 1e5, 500)).round(9).tolist()
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    for digits, shift in ((8, 0.0), (4, 1.37e-7), (2, 0.0)):
        expected = [r[0] for r in df.orderBy("i").select(F.round(F.col("v") + shift, digits)).collect()]
        assert bar_arrays.half_up(np.array(values), digits, shift).tolist() == expected


def test_segments_follow_each_other(monkeypatch):
    x = np.random.default_rng(1).normal(size=700)
    groups = bar_arrays.Groups(np.array([0, 500]), 700)
    whole = groups.follow(x[:, None], np.array([0.9]), np.array([[2.0], [0.0]]))
    monkeypatch.setattr(bar_arrays, "SEGMENT", 64)
    assert np.allclose(whole, groups.follow(x[:, None], np.array([0.9]), np.array([[2.0], [0.0]])), rtol=1e-12)
    y = 2.0
    for i in range(500):
        y = 0.9 * y + x[i]
    assert whole[499, 0] == pytest.approx(y, rel=1e-12)
