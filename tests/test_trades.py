"""One hand-made series per exit, and the fold against the window form."""

import pytest

from barquarry.operators import trades
from barquarry.operators.indicators import add_technical
from barquarry.operators.layout import SymbolLayout
from barquarry.operators.position_fold import bounded_fold_trades, fold_trades
from barquarry.operators.strategy import Strategy
from barquarry.operators.summary import exit_reason_totals, overall_summary, symbol_summary
from barquarry.operators.trades import frame_trades, in_range
from barquarry.plans.catalog import day_bars, inputs
from barquarry.plans.presets import shipped
from barquarry.plans.requests import backtest_request, extract_trades

LAYOUT = SymbolLayout()
SIGNAL = ["VOLUME > 500"]


def run(bars, config, amount=1000.0, **when):
    s = Strategy.from_mapping({"name": "S", "entry": SIGNAL, **config})
    frame = in_range(add_technical(bars, LAYOUT, s.columns), LAYOUT, **when)
    return extract_trades(frame, [s], amount, LAYOUT).orderBy("close_date", "exit_reason").collect()


def quiet(price):
    return (price, price, price, price)


ENTRY = (10, 10, 10, 10, 900)


@pytest.mark.parametrize(
    "config, bars, reason, price, days",
    [
        ({"tp": ["CLOSE + 2"], "sl": ["1"]}, [quiet(11), (11, 12.5, 11, 12)], "TP Hit", 12, 2),
        ({"tp": ["CLOSE * 9"], "sl": ["9.5", "8"]}, [(10, 10, 9.4, 9.6)], "SL Hit (Level 1)", 9.5, 1),
        ({"tp": ["CLOSE * 9"], "sl": ["ENTRY_PRICE - 6", "ENTRY_PRICE - 1"]}, [quiet(9)], "SL Hit (Level 2)", 9, 1),
        ({"tp": ["CLOSE * 9"], "ts": "10%"}, [(10, 20, 18.5, 19), (18, 19, 17, 18)], "Trailing Stop Hit", 18, 2),
        ({"tp": ["CLOSE * 9"], "sl": "1", "max_hold_days": 2}, [quiet(11), quiet(12)], "MaxHold Exit", 12, 2),
        ({"tp": ["CLOSE * 9"], "sl": "1", "max_hold_days": 0}, [quiet(11), quiet(12)], "MaxHold Exit", 11, 1),
    ],
)
def test_exits(make_bars, config, bars, reason, price, days):
    (trade,) = run(make_bars([ENTRY, *bars]), config)
    assert (trade.exit_reason, trade.hold_period) == (reason, days)
    assert trade.exit_price == pytest.approx(price)
    assert trade.pnl == pytest.approx((price - 10) * 100)
    assert trade.roi_pct == pytest.approx((price / 10 - 1) * 100)


def test_trailing_level_uses_the_high_of_the_same_bar(make_bars):
    (trade,) = run(make_bars([ENTRY, (10, 20, 17, 19)]), {"tp": ["CLOSE * 9"], "ts": 0.1})
    assert trade.exit_price == pytest.approx(18) and trade.exit_reason == "Trailing Stop Hit"


def test_open_position_at_the_end_gives_no_row(make_bars):
    assert run(make_bars([ENTRY, quiet(10)]), {"tp": ["CLOSE * 9"], "sl": "1"}) == []


def test_no_entry_while_in_position_nor_on_the_exit_bar(make_bars):
    found = run(make_bars([ENTRY] * 6 + [quiet(10)]), {"tp": ["CLOSE * 9"], "sl": "1", "max_hold_days": 2})
    assert [t.entry_date.day for t in found] == [1, 4]


def test_amount_below_one_share_is_no_entry(make_bars):
    assert run(make_bars([ENTRY, quiet(12)]), {"tp": ["CLOSE + 1"]}, amount=9.0) == []


def test_no_rules_means_no_trades(make_bars):
    assert run(make_bars([ENTRY, quiet(12)]), {"entry": [], "tp": ["CLOSE + 1"]}) == []


def test_dynamic_amount_and_its_fallback(make_bars):
    bars = make_bars([ENTRY, quiet(12)])
    (t,) = run(bars, {"tp": ["CLOSE + 1"], "amount": "FIXED_AMOUNT * 2"})
    assert t.pnl == pytest.approx(200)
    (t,) = run(bars, {"tp": ["CLOSE + 1"], "amount": "FIXED_AMOUNT / RSI14"})  # RSI is 0 here
    assert t.pnl == pytest.approx(100)


def test_partial_take_profit(make_bars):
    config = {"partial_tp": ["ENTRY_PRICE + 1", "ENTRY_PRICE + 2", "ENTRY_PRICE + 3"], "partial_tp_ratios": [0.3, 0.3, 0.4]}
    rows = run(make_bars([ENTRY, (10, 11, 10, 10), (10, 12, 10, 10), (10, 13, 10, 10)]), config)
    assert [(t.exit_reason, round(t.pnl, 6)) for t in rows] == [
        ("Partial TP 1", 30), ("Partial TP 2", 60), ("Partial TP 3", 120),
    ]
    rows = run(make_bars([ENTRY, (10, 12, 10, 10), (1, 1, 1, 1)]), config)  # no stop in this mode
    assert [t.close_date.day for t in rows] == [2, 2]


def test_several_targets_become_equal_parts_and_close_despite_rounding(make_bars):
    bars = make_bars([ENTRY, (10, 99, 10, 10), ENTRY, (10, 99, 10, 10)])
    rows = run(bars, {"tp": ["CLOSE + 1", "CLOSE + 2", "CLOSE + 3"]})
    assert len(rows) == 6 and {t.entry_date.day for t in rows} == {1, 3}


def test_full_partial_exit_then_averaging_stops_that_bar(make_bars):
    rows = run(make_bars([ENTRY, (10, 12, 9, 9)]), {"partial_tp": "ENTRY_PRICE + 1", "avg_down": "ENTRY_PRICE"})
    assert [t.exit_reason for t in rows] == ["Partial TP 1"]


def test_average_down_is_capped_and_moves_the_recorded_stop(make_bars):
    config = {"tp": ["CLOSE * 9"], "avg_down": ["ENTRY_PRICE - 1", "1"], "max_hold_days": 4, "sl": "0.5"}
    (t,) = run(make_bars([ENTRY, quiet(9), quiet(8), quiet(7), quiet(6)]), config)
    assert t.entry_price == pytest.approx((10 * 100 + 9 * 100 + 8 * 100) / 300)
    assert t.pnl == pytest.approx((6 - 9) * 300)
    assert t.stop_loss == pytest.approx(9.0)  # ATR14 is 0 on so few bars


def test_average_up(make_bars):
    config = {"tp": ["CLOSE * 9"], "avg_up": "ENTRY_PRICE * 1.1", "max_hold_days": 2, "sl": "0.5"}
    (t,) = run(make_bars([ENTRY, quiet(11), quiet(12)]), config)
    assert t.entry_price == pytest.approx(10.5) and t.pnl == pytest.approx(1.5 * 200)


def test_period_limits_entries_not_history(make_bars):
    bars = make_bars([ENTRY, quiet(11)] + [quiet(10)] * 58 + [ENTRY, quiet(11)])
    rows = run(bars, {"tp": ["CLOSE + 1"]}, period="1m")
    assert [t.entry_date.month for t in rows] == [3]
    assert len(run(bars, {"tp": ["CLOSE + 1"]}, start="2020-01-01", end="2020-01-31")) == 1


@pytest.mark.parametrize(
    "rule, level",
    [
        ("GREATEST(ENTRY_PRICE * 0.97, CLOSE * 0.9)", 9.7),
        ("LEAST(ENTRY_PRICE * 0.97, CLOSE * 0.9)", 9.8 * 0.9),
        ("CASE WHEN ENTRY_PRICE > 9 THEN CLOSE * 0.95 ELSE CLOSE * 0.8 END", 9.8 * 0.95),
        ("ENTRY_PRICE * ENTRY_PRICE / 10 - 0.5", 9.5),
    ],
)
def test_stop_rules_may_be_any_function_of_the_entry_price(make_bars, rule, level):
    bars = [ENTRY, (10, 10, level + 0.01, 9.8), (9.8, 9.9, level, 9.8)]
    (trade,) = run(make_bars(bars), {"tp": ["CLOSE * 9"], "sl": rule, "max_hold_days": 5})
    assert (trade.exit_reason, trade.hold_period) == ("SL Hit (Level 1)", 2)
    assert trade.exit_price == pytest.approx(level)


def test_functions_of_a_moving_entry_price_are_refused(make_bars):
    for rule in ("GREATEST(ENTRY_PRICE * 0.9, 1)", "ENTRY_PRICE * ENTRY_PRICE"):
        with pytest.raises(Exception, match="ENTRY_PRICE"):
            run(make_bars([ENTRY, quiet(12)]), {"sl": rule, "avg_up": "ENTRY_PRICE * 1.1"})


def test_fixed_stop_is_the_one_recorded_at_entry(make_bars):
    bars = make_bars([ENTRY, (10, 20, 9.5, 20), (20, 20, 12, 12), (9, 9, 8.9, 9)])
    config = {"tp": ["CLOSE * 9"], "sl": ["CLOSE * 0.9"], "max_hold_days": 9}
    (floating,) = run(bars, config)
    (fixed,) = run(bars, {**config, "stop": "fixed"})
    assert (floating.hold_period, fixed.hold_period) == (1, 3)
    assert (fixed.exit_reason, fixed.exit_price) == ("SL Hit (Level 1)", 9.0)
    with pytest.raises(ValueError):
        Strategy.from_mapping({"name": "S", "stop": "fixed", "avg_up": "ENTRY_PRICE * 1.1"})


@pytest.mark.parametrize("hold", [40, 200])
def test_long_holds_use_no_python(spark, monkeypatch, hold):
    bars, layout = inputs(spark, "/root/testdata/sf0.001", hold=hold)
    s = Strategy.from_mapping(
        {"name": "A", "entry": ["CLOSE < MA50"], "tp": ["CLOSE * 1.9"], "ts": 0.9, "max_hold_days": hold,
         "sl": ["ENTRY_PRICE * 0.05", "LEAST(CLOSE * 0.03, ENTRY_PRICE * 0.03)"]}
    )
    frame = in_range(add_technical(bars, layout, ["MA50"]), layout)
    by_chunk = frame_trades(frame, [s], 1e6, layout)
    plan = by_chunk._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
    monkeypatch.setattr(trades, "FRAME_BARS", 1000)
    by_frame = frame_trades(frame, [s], 1e6, layout)
    found = [sorted(map(tuple, t.collect())) for t in (by_chunk, by_frame)]
    assert len(found[0]) > 20 and found[0] == found[1]


def test_fold_agrees_with_frames(spark):
    bars, layout = inputs(spark, "/root/testdata/sf0.001")
    strategies = [
        Strategy.from_mapping(
            {"name": "A", "entry": ["CLOSE > MA5"], "tp": ["CLOSE * 1.2"], "sl": ["CLOSE * 0.9", "ENTRY_PRICE * 0.7"],
             "ts": "30%", "max_hold_days": 6}
        ),
        Strategy.from_mapping({"name": "B", "entry": ["CLOSE < MA5"], "max_hold_days": 2}),
    ]
    frame = in_range(add_technical(bars, layout, ["MA5", "ATR14"]), layout)
    key = ["strategy", "symbol", "entry_date"]
    by_form = [
        f(frame, strategies, 1e6, layout).toPandas().sort_values(key, ignore_index=True)
        for f in (frame_trades, fold_trades, bounded_fold_trades)
    ]
    assert len(by_form[0]) > 100
    for other in by_form[1:]:
        assert (by_form[0].drop(columns=["exit_price", "pnl", "roi_pct"]).round(6).equals(
            other.drop(columns=["exit_price", "pnl", "roi_pct"]).round(6)))
        assert by_form[0].pnl.to_numpy() == pytest.approx(other.pnl.to_numpy())


def test_trades_do_not_overlap_and_reasons_add_up(spark):
    bars, layout = inputs(spark, "/root/testdata/sf0.001", hold=5)
    made, summary = backtest_request(bars, shipped(), layout)
    rows = made.orderBy("strategy", "symbol", "entry_date").collect()
    for a, b in zip(rows, rows[1:]):
        if (a.strategy, a.symbol) == (b.strategy, b.symbol):
            assert b.entry_date > a.close_date
    got = summary.collect()
    assert len(got) == 3 * day_bars(spark, "/root/testdata/sf0.001").select("symbol").distinct().count()
    assert all(sum(r.exit_reason_count.values()) == r.total_trades for r in got)
    assert sum(r.total_trades for r in got) == len(rows)
    empty = next(r for r in got if r.total_trades == 0)
    assert (empty.winrate, empty.risk_reward, empty.final_equity) == (0.0, None, 1e6)


def test_summary_figures(spark):
    columns = "strategy string, symbol string, pnl double, roi_pct double, hold_period int, exit_reason string"
    made = spark.createDataFrame(
        [("S", "A", 10.0, 1.0, 2, "TP Hit"), ("S", "A", -5.0, -2.0, 4, "MaxHold Exit"), ("S", "A", 0.0, 0.0, 3, "TP Hit")],
        columns,
    )
    symbols = spark.createDataFrame([("A",), ("B",)], "symbol string")
    summary = symbol_summary(made, 100.0, symbols, ["S"])
    a = summary.where("symbol = 'A'").first()
    assert (a.total_trades, a.wins, a.losses, a.avg_holding_days, a.final_equity) == (3, 1, 2, 3.0, 105.0)
    assert (a.avg_win_pct, a.avg_loss_pct, a.risk_reward, a.best_roi_pct) == (1.0, -1.0, 1.0, 1.0)
    total = overall_summary(summary, 100.0).first()
    assert total.avg_winrate == pytest.approx(100 / 3 / 2)  # a symbol without trades counts
    assert {r.exit_reason: r.n for r in exit_reason_totals(summary).collect()} == {"TP Hit": 2, "MaxHold Exit": 1}
