"""Work and memory of one task must not grow with the whole input."""

import pytest

from barquarry.operators import layout as layouts
from barquarry.operators.indicators import add_technical
from barquarry.operators.layout import SymbolLayout
from barquarry.operators.strategy import Strategy
from barquarry.operators.trades import exit_candidates, in_range
from barquarry.plans import catalog
from barquarry.plans.requests import extract_trades
from barquarry.sources.sinks import read_page, write_pages


@pytest.mark.parametrize("hold", [40, 90])
def test_rules_with_a_case_are_tested_pair_by_pair(spark, make_bars, hold):
    bars = make_bars([(10 + i * 7 % 11, 13 + i * 7 % 11, 9 - i % 3 + i * 7 % 11, 11 + i * 7 % 11) for i in range(300)])

    def trades(rule):
        s = Strategy.from_mapping({"name": "A", "entry": ["CLOSE > MA5"], "tp": ["CLOSE * 1.6"], "sl": [rule], "max_hold_days": hold})
        frame = in_range(add_technical(bars, SymbolLayout(), ["MA5"]), SymbolLayout(), start="2020-02-01")
        found = exit_candidates(frame, [s], 1000.0, SymbolLayout())
        return extract_trades(frame, [s], 1000.0, SymbolLayout()), found._jdf.queryExecution().optimizedPlan().toString()

    cased, plan = trades("CASE WHEN CLOSE > 0 THEN ENTRY_PRICE * 0.52 END")
    assert "transform(" not in plan and "collect_list(" not in plan
    rows = [sorted(map(str, x.collect())) for x in (cased, trades("ENTRY_PRICE * 0.52")[0])]
    assert rows[0] == rows[1] and len(rows[0]) > 1
    # Signals that nothing ends stay open and give no trade.
    assert trades("CASE WHEN CLOSE < 0 THEN 1 END")[0].where("exit_reason LIKE 'SL%'").count() == 0


def test_pages_compute_their_rows_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.range(983).mapInArrow(counted, "id bigint")
    write_pages(rows, ["id"], f"{tmp_path}/pages", 100)
    assert seen.value == 983
    assert [r[0] for r in read_page(spark, f"{tmp_path}/pages", ["id"], 2, 10).collect()] == [*range(20, 30)]


def test_segments_need_few_lags(make_bars):
    bars = make_bars([(1, 2, 1, 1 + i % 5) for i in range(60)])
    frame = add_technical(bars, SymbolLayout(max_rows=4096, segment_rows=8), ["MACD_LINE", "ADX14"])
    assert frame._jdf.queryExecution().optimizedPlan().toString().count("lag(") < 150


def test_tasks_grow_with_the_rows(make_bars):
    bars = make_bars([(1, 2, 1, 2)] * 9)
    dealt = layouts.with_tasks(SymbolLayout(), bars, 10**9)
    assert dealt.tasks == 10**9 // layouts.ROWS_PER_TASK
    plan = add_technical(bars, dealt, ["MA5"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and f", {dealt.tasks})" in plan
    assert layouts.with_tasks(SymbolLayout(), bars, 1000).tasks is None


def test_buckets_grow_with_the_ticks(spark, monkeypatch):
    asked = []
    store = catalog.store_bars
    monkeypatch.setattr(layouts, "ROWS_PER_TASK", 400)
    monkeypatch.setattr(catalog, "store_bars", lambda bars, name, buckets, path: (asked.append(buckets), store(bars, name, buckets, path)))
    assert catalog.QUERIES["s01_scan_from_buckets"](spark, "/root/testdata/sf0.001").count() > 0
    assert asked == [15]
