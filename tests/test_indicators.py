"""Hand-made series with known answers, and properties that hold on any series."""

import pytest
from pyspark.sql import functions as F

from barquarry.operators.indicators import TECHNICAL_COLUMNS, add_technical, result_rows
from barquarry.operators.layout import SymbolLayout
from barquarry.plans.catalog import day_bars, rounded
from barquarry.sources.bars import split_rejects

LAYOUT = SymbolLayout()


def last(bars, names, **options):
    rows = result_rows(add_technical(bars, LAYOUT, names, **options), LAYOUT).orderBy("date").collect()
    return rows[-1]


def column(bars, name, **options):
    rows = result_rows(add_technical(bars, LAYOUT, [name], **options), LAYOUT).orderBy("date").collect()
    return [r[name] for r in rows]


def flat(price, volume=100.0):
    return (price, price, price, price, volume)


def test_61_columns_exist_once():
    assert len(TECHNICAL_COLUMNS) == 61 == len(set(TECHNICAL_COLUMNS))


def test_constant_price(make_bars):
    row = last(make_bars([flat(50)] * 60), TECHNICAL_COLUMNS)
    for n in ("RSI14", "BB_PERCENT_B", "STOCH_K", "STOCH_D", "ATR14", "BB_WIDTH", "MACD_LINE", "ADX14", "PRICE_RETURN_50D_PCT"):
        assert row[n] == 0, n
    assert row["MA50"] == row["VWMA"] == row["HH20"] == row["FIB_618"] == 50
    assert row["MA200"] == 0  # not enough history: warm-up is zero


def test_no_losses_leave_rsi_undefined(make_bars):
    assert column(make_bars([flat(10 + i) for i in range(60)]), "RSI14") == [0.0] * 60


def test_rsi_is_carried_while_undefined(make_bars):
    mixed = [flat(10 + (i % 3)) for i in range(20)]
    values = column(make_bars(mixed + [flat(20 + i) for i in range(20)]), "RSI14")
    assert values[19] > 0 and len(set(values[33:])) == 1 and values[-1] > 0


def test_adx_needs_28_rows(make_bars):
    rows = [(10 + i % 5, 12 + i % 7, 8 + i % 3, 10 + i % 4) for i in range(28)]
    assert last(make_bars(rows), ["ADX14"])["ADX14"] > 0
    short = last(make_bars(rows[:27]), ["ADX14", "ADX_PLUS"])
    assert short["ADX14"] == 0 and short["ADX_PLUS"] == 0


def test_gap_in_close(make_bars):
    rows = [flat(10 + i) for i in range(12)]
    rows[6] = (16, 16, 16, None)
    ma = column(make_bars(rows), "MA3")
    close = column(make_bars(rows), "CLOSE")
    assert close[6] == 15  # raw values are carried too
    assert ma[5] == 14 and ma[6] == ma[7] == ma[8] == 14 and ma[9] == 18


def test_zero_volume(make_bars):
    row = last(make_bars([flat(10, 0)] * 40), TECHNICAL_COLUMNS)
    for n in ("VOLUME_SPIKE", "RVOL", "VWMA", "VWAP", "TRADE_FREQUENCY", "HIGH_VOL_DAYS"):
        assert row[n] == 0, n


def test_warmup_null_keeps_missing_history_null(make_bars):
    bars = make_bars([flat(10 + i) for i in range(10)])
    assert column(bars, "MA5", warmup="null")[:5] == [None] * 4 + [12.0]
    assert column(bars, "MA5")[:5] == [0.0] * 4 + [12.0]


PLAIN = [(10, 15, 5, 14)] * 11
CANDLES = {
    "THREE_RED_CANDLES": [(10, 11, 8, 9)] * 3,
    "THREE_GREEN_CANDLES": [(9, 11, 8, 10)] * 3,
    "DOJI": PLAIN + [(10, 15, 5, 10.01)],
    "HAMMER": [(10, 10.14, 5, 10.1)],
    "HANGING_MAN": [(10, 10.14, 5, 10.1)],
    "SHOOTING_STAR": [(10, 15, 9.99, 10.1)],
    "MORNING_STAR": PLAIN + [(14, 15, 5, 10), (10, 12, 8, 10.1), (10, 14, 9, 13)],
    "EVENING_STAR": PLAIN + [(10, 15, 5, 14), (14, 15, 13, 14.1), (14, 14.5, 9, 10)],
}


@pytest.mark.parametrize("name", CANDLES)
def test_candle_patterns(make_bars, name):
    assert column(make_bars(CANDLES[name]), name)[-1] == 1
    assert column(make_bars(CANDLES[name] + [(10, 10.5, 9.5, 10.4), (10.4, 10.5, 9, 9.5)]), name)[-1] == 0


def test_order_of_input_and_partitions_do_not_matter(spark):
    bars, _ = split_rejects(day_bars(spark, "/root/testdata/sf0.001"))
    names = ["MA20", "RSI14", "MACD_SIGNAL", "ADX14", "HH20", "LL20", "BB_UPPER", "BB_MIDDLE", "BB_LOWER"]
    a = result_rows(add_technical(bars, LAYOUT, names), LAYOUT)
    b = result_rows(add_technical(bars.repartition(5).orderBy(F.rand(3)), LAYOUT, names), LAYOUT)
    assert a.exceptAll(b).count() == 0
    assert a.where("HH20 > 0 AND (LL20 > LOW OR HH20 < HIGH)").count() == 0
    assert a.where("BB_UPPER < BB_MIDDLE OR BB_MIDDLE < BB_LOWER").count() == 0


def test_only_asked_columns_are_planned(spark):
    bars = day_bars(spark, "/root/testdata/sf0.001")
    plan = add_technical(bars, LAYOUT, ["MA5"])._jdf.queryExecution().optimizedPlan().toString()
    assert "var_pop" not in plan and "lag(" not in plan


def test_unknown_column_is_an_error(make_bars):
    with pytest.raises(ValueError, match="EMA20"):
        add_technical(make_bars([flat(1)]), LAYOUT, ["EMA20"])


def test_many_columns_are_rounded_as_few_are(spark):
    values = [0.00005, -0.00005, 1.00015, -2.5, 0.0, 1e15 + 0.3, -1e300, float("nan"), float("inf"), None, 123456.78905, -1e-9]
    names = [f"c{i}" for i in range(40)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(*[F.col("v").alias(n) for n in names])
    many = rounded(rows, names)
    assert "transform(" in many._jdf.queryExecution().analyzed().toString()
    few = rows.select(*[F.round(F.col(n) + F.lit(1.37e-7), 4).alias(n) for n in names])
    assert [str(r) for r in many.collect()] == [str(r) for r in few.collect()]
