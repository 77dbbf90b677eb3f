"""Cutting a long series into blocks must not change any result."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from barquarry.operators.indicators import CANDLE_FLAGS, TECHNICAL_COLUMNS, add_technical, result_rows
from barquarry.operators.layout import BlockLayout, SymbolLayout, choose_layout, longest_series
from barquarry.operators.strategy import Strategy
from barquarry.operators.trades import in_range
from barquarry.plans.presets import example
from barquarry.plans.requests import extract_trades


def wavy_bars(spark, rows, flat=(0, 0), symbols=("HOT",)):
    """Deterministic pseudo-random hourly bars; prices stand still on the flat rows."""
    i = F.col("id")
    noise = (F.pmod(F.xxhash64(i, F.lit(1)), F.lit(1000)) / 1000.0).cast("double")
    other = (F.pmod(F.xxhash64(i, F.lit(2)), F.lit(1000)) / 1000.0).cast("double")
    still = i.between(*flat)
    close = F.when(still, 100.0).otherwise(100 + 20 * F.sin(i / 17.0) + 5 * noise)
    open_ = F.when(still, 100.0).otherwise(100 + 20 * F.sin(i / 17.0) + 5 * other)
    out = spark.range(rows).select(
        F.explode(F.array(*[F.lit(s) for s in symbols])).alias("symbol"),
        F.timestamp_seconds(i * 3600 + 1_500_000_000).alias("date"),
        open_.alias("open"),
        (F.greatest(open_, close) + F.when(still, 0.0).otherwise(noise)).alias("high"),
        (F.least(open_, close) - F.when(still, 0.0).otherwise(other)).alias("low"),
        close.alias("close"),
        F.when(i.between(200, 400), 0.0).otherwise(50 + 100 * noise).alias("volume"),
    )
    return out.where((F.col("symbol") == symbols[0]) | (i < 700))


@pytest.fixture(scope="module")
def long_bars(spark):
    # The flat stretch is longer than a block boundary on both sides.
    return wavy_bars(spark, 40_000, flat=(14_000, 19_000), symbols=("HOT", "COLD")).cache()


def compare(a, b, names):
    a = a.sort_values(["symbol", "date"], ignore_index=True)
    b = b.sort_values(["symbol", "date"], ignore_index=True)
    assert len(a) == len(b)
    for n in names:
        x, y = a[n].to_numpy(dtype=float), b[n].to_numpy(dtype=float)
        same = np.isclose(x, y, rtol=1e-9, atol=1e-9, equal_nan=True)
        assert same.all(), (n, np.flatnonzero(~same)[:5], x[~same][:5], y[~same][:5])


def test_blocks_give_the_same_indicators(long_bars):
    whole, blocks = SymbolLayout(), BlockLayout(block_rows=16_384)
    a = result_rows(add_technical(long_bars, whole), whole).toPandas()
    b = result_rows(add_technical(long_bars, blocks), blocks).toPandas()
    compare(a, b, TECHNICAL_COLUMNS)


def test_last_value_before_a_block_is_carried_into_it(spark):
    # RSI is undefined while nothing falls: more than two whole blocks of rising prices.
    bars = wavy_bars(spark, 6_000).withColumn(
        "close",
        F.when(F.unix_timestamp("date") > 1_500_000_000 + 3600 * 1_500, 200 + F.unix_timestamp("date") / 1e6).otherwise(
            F.col("close")
        ),
    )
    whole = SymbolLayout()
    blocks = BlockLayout(block_rows=1_024, lookback=256)
    names = ["RSI14", "STOCH_K", "BB_PERCENT_B", "VOLUME_SPIKE", *CANDLE_FLAGS]
    a = result_rows(add_technical(bars, whole, names), whole).toPandas()
    b = result_rows(add_technical(bars, blocks, names), blocks).toPandas()
    assert a["RSI14"].tail(3000).nunique() == 1 and a["RSI14"].iloc[-1] != 0
    compare(a, b, names)


STRATEGIES = [
    {"name": "EVERY_BAR", "entry": ["CLOSE > 0"], "tp": ["CLOSE + ATR14"], "sl": ["CLOSE - ATR14"], "max_hold_days": 6},
    {"name": "TRAIL", "entry": ["CLOSE > MA20"], "ts": "1%", "sl": ["ENTRY_PRICE * 0.98"], "max_hold_days": 9},
    {"name": "AVERAGE", "entry": ["CLOSE < MA20"], "tp": ["CLOSE * 1.5"], "avg_down": ["ENTRY_PRICE * 0.99"],
     "avg_up": ["ENTRY_PRICE * 1.03", "ENTRY_PRICE * 1.05"], "max_hold_days": 12},
    {"name": "PARTIAL", "entry": ["CLOSE < MA20"], "tp": ["ENTRY_PRICE * 1.002", "ENTRY_PRICE * 1.01"]},
]


@pytest.mark.parametrize("when", [{"start": "2017-07-20"}, {"period": "3m"}], ids=["start", "period"])
@pytest.mark.parametrize("config", STRATEGIES, ids=lambda s: s["name"])
def test_blocks_give_the_same_trades(spark, config, when):
    bars = wavy_bars(spark, 3_000, symbols=("HOT", "COLD"))
    s = Strategy.from_mapping(config)
    found = []
    for layout in (SymbolLayout(), BlockLayout(block_rows=256, lookback=128, lookahead=12)):
        frame = in_range(add_technical(bars, layout, s.columns), layout, **when)
        found.append(sorted(map(tuple, extract_trades(frame, [s], 1e6, layout).collect())))
    assert len(found[0]) > 30
    assert [r[:4] + (r[9],) for r in found[0]] == [r[:4] + (r[9],) for r in found[1]]
    for a, b in zip(*found):
        assert a[4:8] == pytest.approx(b[4:8], rel=1e-9)


def test_windows_longer_than_a_block_and_than_the_lookback(spark):
    bars = wavy_bars(spark, 900)
    names = ["MA300", "HH300", "LL250"]
    whole, blocks = SymbolLayout(), BlockLayout(block_rows=128, lookback=320)
    a = result_rows(add_technical(bars, whole, names), whole).toPandas()
    b = result_rows(add_technical(bars, blocks, names), blocks).toPandas()
    compare(a, b, names)
    with pytest.raises(ValueError, match="lookback"):
        add_technical(bars, BlockLayout(block_rows=128, lookback=128), names)


def test_layout_follows_the_longest_series(long_bars):
    assert longest_series(long_bars) == 40_000
    assert not choose_layout(long_bars).blocked
    assert choose_layout(long_bars, limit=10_000).blocked
    assert not choose_layout(long_bars, max_rows=500, limit=10_000).blocked


def test_no_group_of_a_block_layout_is_long(long_bars):
    layout = BlockLayout(block_rows=4_096, lookback=512)
    prepared = layout.prepare(long_bars)
    assert prepared.groupBy(*layout.keys).count().agg(F.max("count")).first()[0] <= layout.max_rows
    assert prepared.where("_own").count() == long_bars.count()


def test_endless_position_needs_the_streaming_fold():
    assert example("PARTIAL_TP_STRATEGY").needs_fold


def test_recurrences_read_no_rows_before_their_block(spark):
    bars = wavy_bars(spark, 5_000, symbols=("HOT", "COLD"))
    names = ["EMA500", "EMA3", "MACD_LINE", "MACD_SIGNAL", "MACD_HISTOGRAM", "ADX14", "ADX_PLUS", "ADX_MINUS"]
    whole = SymbolLayout()
    a = result_rows(add_technical(bars, whole, names), whole).toPandas()
    close = a[a["symbol"] == "HOT"].sort_values("date")["CLOSE"].to_numpy()
    expected = [close[0]]
    for x in close[1:]:
        expected.append(expected[-1] + (x - expected[-1]) * 2 / 501)
    assert np.allclose(a[a["symbol"] == "HOT"].sort_values("date")["EMA500"], expected, rtol=1e-12)
    # Blocks far shorter than the averages remember, and blocks of several segments.
    for blocks in (BlockLayout(block_rows=64, lookback=64), BlockLayout(block_rows=1_000, lookback=64, segment_rows=256)):
        b = result_rows(add_technical(bars, blocks, names), blocks).toPandas()
        compare(a, b, names)


@pytest.mark.parametrize("n", [251, 700, 1_500])
def test_long_windows_at_constant_work(spark, n):
    bars = wavy_bars(spark, 2_000, symbols=("HOT",)).withColumn("volume", F.when(F.col("date") > "2017-07-20", F.col("volume")))
    names = [f"MA{n}", f"HH{n}", f"LL{n}", f"VMA{n}"]
    raw = bars.orderBy("date").toPandas()
    expected = {
        f"MA{n}": raw["close"].rolling(n).mean(),
        f"HH{n}": raw["high"].rolling(n).max(),
        f"LL{n}": raw["low"].rolling(n).min(),
        f"VMA{n}": raw["volume"].rolling(n).mean(),
    }
    for layout in (SymbolLayout(), BlockLayout(block_rows=500, lookback=n)):
        got = result_rows(add_technical(bars, layout, names, fill=False), layout).toPandas().sort_values("date")
        for name in names:
            assert np.allclose(got[name], expected[name], rtol=1e-10, equal_nan=True), name


def test_the_plan_does_not_grow_with_the_window(spark):
    bars = wavy_bars(spark, 300)
    size = lambda n: len(add_technical(bars, SymbolLayout(), [f"MA{n}", f"HH{n}"])._jdf.queryExecution().optimizedPlan().toString())
    assert size(90_000) < size(300) * 1.1


def test_returns_look_back_over_their_lag(spark):
    bars = wavy_bars(spark, 400)
    with pytest.raises(ValueError, match="lookback"):
        add_technical(bars, BlockLayout(block_rows=128, lookback=64), ["PRICE_RETURN_100D_PCT"])


def test_passes_over_blocks_move_no_rows(spark):
    blocks = BlockLayout(block_rows=512, lookback=64, tasks=3)
    frame = add_technical(wavy_bars(spark, 2_000), blocks, ["MA20", "RSI14"], warmup="null", fill=False)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "Exchange" not in plan and "SelectedBucketsCount: 3 out of 3" in plan


def test_blocks_leave_no_table_behind(spark):
    before = {t.name for t in spark.catalog.listTables()}
    blocks = BlockLayout(block_rows=512, lookback=64)
    assert result_rows(add_technical(wavy_bars(spark, 2_000), blocks, ["MA20"]), blocks).count() == 2_000
    assert {t.name for t in spark.catalog.listTables()} == before
