"""Result tables, repeated bars, mergeable bar states, bucketed bars and pages."""

import pytest
from pyspark.sql import functions as F

from barquarry.operators.indicators import add_technical
from barquarry.operators.layout import BlockLayout, SymbolLayout, choose_layout
from barquarry.operators.strategy import Strategy
from barquarry.plans.presets import example, shipped
from barquarry.plans.requests import backtest_request, requested_bars
from barquarry.operators.summary import symbol_summary
from barquarry.sources.bars import bar_states, bars_of, merge_states, split_duplicates, store_bars, stored_bars, usable_frames
from barquarry.sources.sinks import read_page, write_pages, write_rows


def results(spark, path, format="json"):
    found = spark.read.schema("ticker string, price double, strategy string").format(format).load(path)
    return sorted((r.strategy, r.ticker, r.price) for r in found.collect())


def of(spark, *rows):
    return spark.createDataFrame(rows, "strategy string, ticker string, price double")


@pytest.mark.parametrize("format", ["json", "parquet"])
def test_other_strategies_keep_their_rows(spark, tmp_path, format):
    path = f"{tmp_path}/scan"
    write_rows(of(spark, ("S1", "A", 1.0), ("S1", "B", 2.0)), path, format)
    write_rows(of(spark, ("S2 50%/x", "A", 3.0)), path, format)
    assert results(spark, path, format) == [("S1", "A", 1.0), ("S1", "B", 2.0), ("S2 50%/x", "A", 3.0)]
    write_rows(of(spark, ("S1", "C", 4.0)), path, format, strategies=["S1"])
    assert results(spark, path, format) == [("S1", "C", 4.0), ("S2 50%/x", "A", 3.0)]
    # A strategy that finds nothing any more loses its rows, and only it.
    write_rows(of(spark, ("S1", "C", 5.0)), path, format, strategies=["S1", "S2 50%/x", "NEW"])
    assert results(spark, path, format) == [("S1", "C", 5.0)]
    write_rows(of(spark, ("S1", "x", 1.0)).where("false"), path, format, strategies=["NEW"])
    assert results(spark, path, format) == [("S1", "C", 5.0)]
    assert [p.name for p in (tmp_path / "scan").iterdir() if p.name.startswith("_staged")] == []


def test_a_failing_write_leaves_the_old_rows(spark, tmp_path):
    path = f"{tmp_path}/scan"
    write_rows(of(spark, ("S1", "A", 1.0), ("S2", "B", 2.0)), path)
    bad = of(spark, ("S1", "Z", 9.0)).unionByName(
        of(spark, ("S2", "Y", 9.0)).withColumn("price", F.raise_error(F.lit("broken")).cast("double"))
    )
    with pytest.raises(Exception, match="broken"):
        write_rows(bad, path)
    assert results(spark, path) == [("S1", "A", 1.0), ("S2", "B", 2.0)]
    assert sorted(p.name for p in (tmp_path / "scan").iterdir() if not p.name.startswith(".")) == ["strategy=S1", "strategy=S2"]


def test_repeated_bars(spark, make_bars):
    bars = make_bars([(1, 2, 1, 2), (3, 4, 3, 4), (5, 6, 5, 6), (7, 8, 7, 8)], "A").unionByName(make_bars([(1, 2, 1, 2)], "B"))
    nulls = bars.where("date = '2020-01-04'").withColumn("volume", F.lit(None).cast("double"))
    equal, other = bars.where("date = '2020-01-02'"), bars.where("symbol = 'A' AND date = '2020-01-03'").withColumn("close", F.lit(9.0))
    good, rejects = split_duplicates(bars.unionByName(equal).unionByName(equal).unionByName(other).unionByName(nulls))
    kept = sorted((r.symbol, r.date.day, r.close) for r in good.collect())
    assert kept == [("A", 1, 2.0), ("A", 2, 4.0), ("B", 1, 2.0)]
    # One with a volume and one without contradict each other too.
    assert sorted((r.date.day, r.reason) for r in rejects.collect()) == [(3, "contradicting bars"), (4, "contradicting bars")]
    assert split_duplicates(good)[0].count() == 3 and split_duplicates(good)[1].count() == 0
    assert requested_bars(bars.unionByName(equal).unionByName(other), shipped()).count() == 4
    assert split_duplicates(bars.limit(0))[0].count() == 0


def test_files_without_needed_columns_are_named(spark, make_bars):
    bars = make_bars([(1, 2, 1, 2)])
    kept, rejects = usable_frames(spark, {"good": bars, "bad": bars.drop("high", "low")})
    assert list(kept) == ["good"]
    assert [tuple(r) for r in rejects.collect()] == [("bad", "missing column high, low")]
    assert usable_frames(spark, {"good": bars})[1].count() == 0


def ticks(spark, n=3_000):
    at = F.timestamp_seconds(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(5 * 86_400)) + 1_600_000_000)
    price = (F.pmod(F.xxhash64("id", F.lit(2)), F.lit(1000)) / 10).cast("double")
    return spark.range(n).select("id", F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.concat(F.lit("S"), F.col("id") % 4)).alias("s"), at.alias("ts"), price.alias("p"))


def states(frame, bucket):
    return bar_states(frame, symbol=F.col("s"), ts=F.col("ts"), price=F.col("p"), order=F.struct("ts", "id"), bucket=bucket)


def rows_of(frame):
    return sorted(tuple(r) for r in bars_of(frame).select("symbol", "date", "open", "high", "low", "close", "volume").collect())


@pytest.mark.parametrize("fine", ["hour", 900])
def test_states_roll_up_and_merge(spark, fine):
    every = ticks(spark)
    assert rows_of(merge_states(states(every, fine), "day")) == rows_of(states(every, "day"))
    late = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(5)) == 0
    stored, more = states(every.where(~late), fine), states(every.where(late), fine)
    both = merge_states(stored.unionByName(more))
    assert rows_of(both) == rows_of(states(every, fine))
    # Merged states can be merged again.
    assert rows_of(merge_states(both, "day")) == rows_of(states(every, "day"))
    assert merge_states(stored.limit(0)).count() == 0


def test_bucketed_bars_need_no_exchange(spark, make_bars, tmp_path):
    bars = make_bars([(1, 2, 1, 2)] * 9, "A").unionByName(make_bars([(3, 4, 3, 4)] * 9, "B"))
    store_bars(bars, "bars_of_a_test", 4, f"{tmp_path}/bars")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        frame = add_technical(stored_bars(spark, "bars_of_a_test"), SymbolLayout(), ["MA5"])
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Window" in plan and "Exchange" not in plan
        # Two tables in the same buckets join without one as well.
        joined = stored_bars(spark, "bars_of_a_test").join(stored_bars(spark, "bars_of_a_test").select("symbol", F.col("close").alias("x")), "symbol")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert frame.count() == 18 and joined.count() == 162
        assert stored_bars(spark, "bars_of_a_test", symbols=["B"], start="2020-01-03").count() == 7
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.sql("DROP TABLE bars_of_a_test")


@pytest.mark.parametrize("rows_per_range", [7, 100, 10_000])
def test_pages_from_a_directory(spark, tmp_path, rows_per_range):
    rows = spark.range(983).select((F.col("id") * 37 % 983).alias("k"), (F.col("id") % 3).alias("j"))
    path = f"{tmp_path}/pages"
    write_pages(rows, ["j", "k"], path, rows_per_range)
    every = [tuple(r) for r in rows.orderBy("j", "k").select("j", "k").collect()]
    for number in (0, 1, 7, 39, 40):
        got = read_page(spark, path, ["j", "k"], number, 25)
        assert [tuple(r) for r in got.select("j", "k").collect()] == every[number * 25 : number * 25 + 25]
    if rows_per_range == 100:
        read = spark.read.parquet(f"{path}/rows").where(F.col("_range") == 3).count()
        assert 20 < read < 300
    with pytest.raises(ValueError):
        read_page(spark, path, ["j", "k"], 0, 26)
    write_pages(rows.limit(0), ["j", "k"], path)
    assert read_page(spark, path, ["j", "k"]).count() == 0


def test_a_backtest_reads_its_bars_once(spark, make_bars, tmp_path):
    make_bars([(10 + i % 7, 12 + i % 7, 9 + i % 7, 11 + i % 7) for i in range(120)], "A").unionByName(
        make_bars([(5, 6, 4, 5)] * 3, "QUIET")
    ).write.parquet(f"{tmp_path}/bars")
    bars = spark.read.parquet(f"{tmp_path}/bars")
    trades, summary = backtest_request(bars, shipped(), SymbolLayout(), complete=True)
    assert summary._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    names = [s.name for s in shipped()]
    apart = symbol_summary(trades, 1_000_000.0, bars.select("symbol"), names)
    assert sorted(map(str, summary.collect())) == sorted(map(str, apart.collect()))
    assert summary.count() == 2 * len(names) and trades.where("strategy IS NULL").count() == 0


@pytest.mark.parametrize(
    "strategies",
    [[example("PARTIAL_TP_STRATEGY")], [Strategy.from_mapping({"name": "LONG", "entry": ["CLOSE > 10"], "max_hold_days": 50})], [shipped()[0], example("PARTIAL_TP_STRATEGY")]],
    ids=["fold", "long", "both"],
)
@pytest.mark.parametrize("layout", [SymbolLayout(), BlockLayout(block_rows=64, lookback=256, lookahead=50)], ids=["whole", "blocks"])
def test_symbols_without_trades_are_in_every_summary(spark, make_bars, strategies, layout):
    bars = make_bars([(10 + i % 7, 12 + i % 7, 9 + i % 7, 11 + i % 7) for i in range(150)], "A").unionByName(make_bars([(5, 6, 4, 5)] * 3, "QUIET"))
    trades, summary = backtest_request(bars, strategies, layout, complete=True)
    assert summary.count() == 2 * len(strategies)
    assert {r.symbol for r in summary.collect()} == {"A", "QUIET"}
    assert summary.agg(F.sum("total_trades")).first()[0] == trades.count()


def test_layout_for_strategies(spark, make_bars):
    bars = make_bars([(1, 2, 1, 2)] * 90)
    long = Strategy.from_mapping({"name": "LONG", "entry": ["CLOSE > MA300"], "max_hold_days": 50})
    layout = choose_layout(bars, limit=50, strategies=[long, *shipped()])
    assert (layout.lookahead, layout.lookback) == (50, 300)
