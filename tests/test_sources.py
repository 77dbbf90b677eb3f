"""Readers, validation, symbol lists, strategy files and sinks."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from barquarry.functions.scalars import fixed2, grouped_id, parse_symbols, percent_fraction
from barquarry.operators.fundamentals import FUNDAMENTAL_COLUMNS, fundamental_columns
from barquarry.operators.indicators import add_technical
from barquarry.operators.layout import SymbolLayout
from barquarry.operators.strategy import Strategy
from barquarry.plans.presets import EXAMPLES, SHIPPED, shipped
from barquarry.plans.requests import indicator_frame, lookback_months, recent_bars, requested_bars, scan_request
from barquarry.sources.bars import (
    bars_from_ticks,
    missing_columns,
    normalise_headers,
    read_bars,
    require_columns,
    split_rejects,
    unusable_ticks,
    without_failing_symbols,
)
from barquarry.sources.lists import read_symbol_list, requested_symbols
from barquarry.sources.sinks import SCAN_ORDER, page, page_after, scan_display, trade_display, write_backtest, write_rows
from barquarry.sources.strategies import load_strategies, pick_strategy


@pytest.mark.parametrize("format", ["parquet", "json", "csv"])
def test_read_bars(spark, make_bars, tmp_path, format):
    bars = make_bars([(1, 2, 1, 2)] * 5, "A").union(make_bars([(3, 4, 3, 4)] * 5, "B"))
    bars.write.format(format).save(f"{tmp_path}/bars")
    got = read_bars(spark, f"{tmp_path}/bars", format=format, symbols=["B"], start="2020-01-02", end="2020-01-04")
    assert got.count() == 3 and {r.symbol for r in got.collect()} == {"B"}
    asked = spark.createDataFrame([("A",), ("A",)], "symbol string")
    assert read_bars(spark, f"{tmp_path}/bars", format=format, symbols=asked).count() == 5


def test_filters_reach_the_files(spark, make_bars, tmp_path):
    make_bars([(1, 2, 1, 2)] * 5).write.parquet(f"{tmp_path}/bars")
    bars = recent_bars(read_bars(spark, f"{tmp_path}/bars", symbols=["A"]), shipped(), "2020-01-05")
    plan = bars._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters:")[1].split("]")[0]
    assert "GreaterThanOrEqual(date" in pushed and "symbol" in pushed


def test_headers_and_required_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int").toDF("Open", "CLOSE", "close")
    assert normalise_headers(df).columns == ["open", "close"]
    assert normalise_headers(df).first().close == 2
    assert require_columns(df, ["open", "close"]).count() == 1
    assert require_columns(df).count() == 0  # no high and low


def test_rejects(make_bars):
    bars = make_bars([(1, 1, 1, 1), (1, 1, 1, None), (0, 1, 1, 1)], "A").union(make_bars([(1, 1, 1, 1)], "B"))
    good, bad = split_rejects(bars)
    assert good.count() == 2 and sorted(r.reason for r in bad.collect()) == ["missing price", "price not positive"]
    kept, rejects = without_failing_symbols(bars)
    assert [r.symbol for r in kept.collect()] == ["B"] and rejects.count() == 1


def test_bars_from_ticks_skip_incomplete_ticks(spark):
    ticks = spark.sql(
        "SELECT * FROM VALUES ('A', TIMESTAMP '2020-01-01 00:00:10', 5D, 2D), ('A', TIMESTAMP '2020-01-01 00:00:50', 3D, null),"
        " ('A', TIMESTAMP '2020-01-01 00:01:05', 4D, 1D), ('A', TIMESTAMP '2020-01-01 00:01:06', null, 1D) AS t(s, ts, p, v)"
    )
    bars = bars_from_ticks(ticks, symbol=F.col("s"), ts=F.col("ts"), price=F.col("p"), volume=F.col("v"), bucket=60)
    rows = bars.orderBy("date").collect()
    assert [(r.open, r.high, r.low, r.close, r.volume) for r in rows] == [(5, 5, 3, 3, 2), (4, 4, 4, 4, 1)]


def test_symbol_lists(spark, tmp_path):
    (tmp_path / "list.json").write_text(json.dumps(["bbri", "ANTM"]))
    universe = read_symbol_list(spark, f"{tmp_path}/list.json")
    assert sorted(r.name for r in universe.collect()) == ["ANTM", "bbri"]
    assert read_symbol_list(spark, f"{tmp_path}/none.json").count() == 0
    got = lambda raw: sorted(r.symbol for r in requested_symbols(spark, raw, universe).collect())
    assert got(" antm , ,bbca ") == ["ANTM.JK", "BBCA.JK"]
    assert got("") == got(None) == ["ANTM.JK", "BBRI.JK"]


def test_scalar_helpers(spark):
    row = spark.range(1).select(
        percent_fraction(F.lit("2%")).alias("a"),
        percent_fraction(F.lit("0.02")).alias("b"),
        percent_fraction(F.lit("x%")).alias("c"),
        grouped_id(F.lit(1234567.5)).alias("d"),
        grouped_id(F.lit(-1000000.0)).alias("e"),
        grouped_id(F.lit(None).cast("double")).alias("f"),
        fixed2(F.lit(2.345678)).alias("g"),
        parse_symbols(F.lit("a,,b ")).alias("h"),
    ).first()
    assert (row.a, row.b, row.c) == (0.02, 0.02, None)
    assert (row.d, row.e, row.f, row.g) == ("1.234.567,5", "-1.000.000", "", "2.35")
    assert row.h == ["A.JK", "B.JK"]


def test_strategy_folder(spark, tmp_path):
    for i, s in enumerate([*SHIPPED, *EXAMPLES]):
        (tmp_path / f"{i}.json").write_text(json.dumps(s, indent=1))
    (tmp_path / "empty.json").write_text(" \n")
    (tmp_path / "broken.JSON").write_text('{"name": "X", "entry": [')
    (tmp_path / "notes.txt").write_text("{}")
    (tmp_path / "unnamed.json").write_text('{"entry": "CLOSE > 1", "sl": "CLOSE * 0.9", "ts": "3%"}')
    (tmp_path / "zz.json").write_text(json.dumps({**SHIPPED[0], "max_hold_days": 77}))
    got = load_strategies(spark, str(tmp_path))
    assert set(got) == {s["name"] for s in [*SHIPPED, *EXAMPLES]} | {"unnamed"}
    assert got["unnamed"].sl == ("CLOSE * 0.9",) and got["unnamed"].trailing == 0.03
    assert got["TRENDING"] == Strategy.from_mapping(SHIPPED[1])
    assert got["BEFORE_BREAKOUT"].max_hold == 77  # the later file wins
    assert got["PARTIAL_TP_STRATEGY"].partial_ratios == pytest.approx([1 / 3] * 3)
    with pytest.raises(KeyError):
        pick_strategy(got, "NOPE")


def test_lookback():
    of = lambda *rules: lookback_months([Strategy(name="S", entry=rules)])
    assert lookback_months(shipped()) == 12
    assert [of("CLOSE > 1"), of("RSI14 > 3"), of("CLOSE > MA50"), of("FIB_50 > 1"), of("CLOSE > MA201")] == [24, 3, 6, 6, 24]


def test_fundamentals_defaults(spark, make_bars):
    bars = make_bars([(10, 10, 10, 10)], "A")
    for s in "BCDEF":
        bars = bars.union(make_bars([(10, 10, 10, 10)], s))
    infos = [
        ("A", {"trailingPE": 7.0, "dividendYield": 0.05, "operatingCashflow": 50.0, "sharesOutstanding": 10.0}),
        ("B", {"trailingPE": None, "totalDebt": 4.0, "totalStockholderEquity": 0.0, "debtToEquity": 9.0}),
        ("C", {"debtToEquity": 3.0, "operatingCashflow": 0.0, "sharesOutstanding": 10.0}),
        ("D", {"totalDebt": 4.0, "totalStockholderEquity": 2.0}),
        ("E", {"operatingCashflow": 50.0, "sharesOutstanding": 0.0}),
    ]
    snaps = spark.createDataFrame(infos, "symbol string, info map<string,double>")
    got = {r.symbol: r for r in fundamental_columns(bars, snaps).collect()}
    assert (got["A"].TRAILING_PE, got["A"].DIVIDEND_YIELD, got["A"].PRICE_TO_CF) == (7.0, 5.0, 2.0)
    assert [got[s].DEBT_TO_EQUITY for s in "ABCD"] == [0.0, 0.0, 3.0, 2.0]
    assert [got[s].PRICE_TO_CF for s in "BCDE"] == [0.0] * 4
    assert all(got["F"][n] == 0.0 for n in FUNDAMENTAL_COLUMNS)


def test_sinks_and_display(spark, tmp_path):
    rows = spark.createDataFrame(
        [("S", f"T{i:02d}", 1.0, 1.0, 0.5, 2.0, 100.0, 1e6, -50.0, -5e5, None, "2020-01-01", None, None) for i in range(30)],
        "strategy string, ticker string, price double, entry_price double, stop_loss double, take_profit double, "
        "est_profit_pct double, est_profit_rp double, est_loss_pct double, est_loss_rp double, pnl double, "
        "entry_date string, close_date string, hold_period int",
    )
    write_rows(rows, f"{tmp_path}/scan")
    assert spark.read.json(f"{tmp_path}/scan").count() == 30
    shown = page(scan_display(rows), ["Ticker"], 1, 25).collect()
    assert [r.Ticker for r in shown] == [f"T{i}" for i in range(25, 30)]
    assert tuple(shown[0])[1:] == ("1.00", "1.00", "0.50", "2.00", "100.00 %", "1.000.000", "-50.00 %", "-500.000", "", "2020-01-01", "", "")
    trades = rows.withColumn("exit_price", F.lit(3.0)).withColumn("hold_period", F.lit(4)).withColumn("pnl", F.lit(12.5))
    assert tuple(trade_display(trades).first())[5:] == ("", "", "", "", "12,5", "2020-01-01", "", "4d")
    write_backtest(trades, rows, f"{tmp_path}/bt")
    assert spark.read.parquet(f"{tmp_path}/bt/trades").count() == spark.read.parquet(f"{tmp_path}/bt/summary").count() == 30
    with pytest.raises(ValueError):
        page(rows, ["ticker"], 0, 7)


def test_pages_by_key_are_the_pages_by_number(spark):
    rows = spark.createDataFrame([(f"T{i % 7}", f"S{i // 7}", float(i)) for i in range(63)], "ticker string, strategy string, price double")
    last = None
    for number in range(3):
        expected = page(rows, SCAN_ORDER, number, 25).collect()
        assert page_after(rows, SCAN_ORDER, last, 25).collect() == expected
        last = expected[-1]


def test_missing_columns_are_named(spark):
    df = spark.range(3).selectExpr("id AS Open", "id AS close")
    assert missing_columns(df) == ["high", "low"] and require_columns(df).count() == 0


def test_ticks_that_are_skipped_are_counted(spark):
    df = spark.sql("SELECT * FROM VALUES ('A', 1, 2.0D), ('A', 1, double('NaN')), (NULL, 1, 1.0D), ('A', NULL, 1.0D), ('A', 2, NULL) AS t(s, t, p)")
    at = F.timestamp_seconds("t")
    counts = unusable_ticks(df, symbol=F.col("s"), ts=at, price=F.col("p")).collect()
    assert {r.reason: r.n for r in counts} == {"missing price": 2, "missing symbol": 1, "missing time": 1}
    (bar,) = bars_from_ticks(df, symbol=F.col("s"), ts=at, price=F.col("p")).collect()
    assert (bar.high, bar.volume) == (2.0, 1.0)


def test_several_snapshots_multiply_no_bar(spark, make_bars):
    bars = make_bars([(10, 10, 10, 10)] * 3)
    stamp = lambda h: dt.datetime(2024, 1, 2) - dt.timedelta(hours=h)
    snaps = spark.createDataFrame(
        [("A", stamp(1), {"trailingPE": 5.0}), ("A", stamp(2), {"trailingPE": 6.0}), ("A", stamp(30), {"trailingPE": 7.0})],
        "symbol string, fetched_at timestamp, info map<string,double>",
    )
    for as_of, expected in ((None, 5.0), ("2024-01-01 22:30:00", 6.0), ("2024-01-05", 0.0)):
        frame = indicator_frame(bars, ["TRAILING_PE"], SymbolLayout(), snapshots=snaps, as_of=as_of)
        assert [r.TRAILING_PE for r in frame.collect()] == [expected] * 3


def test_a_request_leaves_unusable_bars_out(spark, make_bars):
    rows = [(100, 100, 100, 100)] * 60
    gap = make_bars([*rows[:30], (100, 100, 100, None), *rows[30:]])
    s = Strategy.from_mapping({"name": "S", "entry": ["MACD_LINE = 0"], "tp": ["CLOSE * 2"]})
    assert scan_request(gap, [s], gap.select("symbol"), SymbolLayout()).count() == 1
    with pytest.raises(Exception, match="missing on a bar"):
        add_technical(gap, SymbolLayout(), ["MACD_LINE"]).collect()


def test_a_request_takes_symbols_and_a_look_back_period(spark, make_bars):
    bars = make_bars([(10, 10, 10, 10)] * 400).unionByName(make_bars([(10, 10, 10, 10)] * 400, symbol="B"))
    s = Strategy.from_mapping({"name": "S", "entry": ["CLOSE > MA20"]})
    used = requested_bars(bars, [s], symbols=["B"], as_of="2021-01-15")
    assert {r.symbol for r in used.select("symbol").distinct().collect()} == {"B"}
    assert used.agg(F.min("date")).first()[0] == dt.date(2020, 10, 15)
