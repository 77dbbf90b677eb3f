"""Registered queries over the given tables, each with the SQL that defines the same result."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barquarry.functions import scalars
from barquarry.operators import fundamentals as fund
from barquarry.operators import scan as scan_op
from barquarry.operators import summary as summ
from barquarry.operators import trades as trade_op
from barquarry.operators.indicators import (
    FIBONACCI,
    RAW_COLUMNS,
    RETURN_LAGS,
    TECHNICAL_COLUMNS,
    add_technical,
    result_rows,
)
from barquarry.operators.layout import BlockLayout, Layout, SymbolLayout, choose_layout, grid_cells, tasks_of, with_tasks
from barquarry.operators.rules import all_met, columns_used, value
from barquarry.operators.strategy import Strategy, columns_of
from barquarry.plans import oracle as o
from barquarry.plans import oracle_trades as ot
from barquarry.plans.presets import example, shipped
from barquarry.plans.requests import extract_trades, indicator_frame, recent_bars, scan_request
from barquarry.session import new_path
from barquarry.sources.bars import (
    bar_states,
    bars_from_ticks,
    bars_of,
    merge_states,
    normalise_headers,
    require_columns,
    restrict,
    split_duplicates,
    split_rejects,
    store_bars,
    stored_bars,
    without_failing_symbols,
)
from barquarry.sources.lists import parse_symbol_list, requested_symbols
from barquarry.sources.strategies import parse_strategies
from barquarry.sources.sinks import SCAN_ORDER, TRADE_ORDER, page, read_page, scan_display, trade_display, write_pages

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
AMOUNT = 1_000_000.0
# More doubles than these are rounded as one array.
_WIDE = 30
c = F.col


def register(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


# --- inputs -----------------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _line_order():
    """Order of line items within a day: order key, line number, price, quantity, as one number.

    38 digits: 19 for the order key, 3 for the line, 12 for the price in cents, 4 for the
    quantity. Unlike a struct, a decimal is fixed-width, so Spark aggregates by hashing
    instead of sorting all ticks.
    """
    cents = F.round(c("l_extendedprice") * 100).cast("bigint")
    low = c("l_linenumber").cast("bigint") * 10**16 + cents * 10**4 + c("l_quantity").cast("bigint")
    return c("l_orderkey").cast("decimal(19,0)") * F.lit(Decimal(10**19)) + low.cast(
        "decimal(19,0)"
    )


def day_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_from_ticks(
        table(spark, sf_dir, "lineitem"),
        symbol=c("l_suppkey"),
        ts=c("l_shipdate"),
        price=c("l_extendedprice") / c("l_quantity"),
        volume=c("l_quantity"),
        order=_line_order(),
    )


def hour_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_from_ticks(
        table(spark, sf_dir, "events"),
        symbol=c("event_type"),
        ts=c("ts"),
        price=c("value"),
        order=F.struct("ts", "event_id"),
        bucket="hour",
    )


def user_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_from_ticks(
        table(spark, sf_dir, "events"),
        symbol=c("user_id"),
        ts=c("ts"),
        price=c("value"),
        order=F.struct("ts", "event_id"),
    )


def line_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few symbols with long series: hour bars of return flags, a line's number being its hour."""
    return bars_from_ticks(
        table(spark, sf_dir, "lineitem"),
        symbol=c("l_returnflag"),
        ts=F.expr("timestampadd(HOUR, CAST(l_linenumber AS INT), CAST(l_shipdate AS TIMESTAMP_NTZ))"),
        price=c("l_extendedprice") / c("l_quantity"),
        volume=c("l_quantity"),
        order=_line_order(),
        bucket="hour",
    )


_BARS = {"day": day_bars, "hour": hour_bars, "user": user_bars, "line": line_bars}
_TICKS = {"day": ("lineitem", "l_shipdate", 86_400), "hour": ("events", "ts", 3_600), "user": ("events", "ts", 86_400), "line": ("lineitem", "l_shipdate", 3_600)}


def _cells(spark: SparkSession, sf_dir: str, base: str) -> int:
    """Cells of the time grid of a tick table."""
    name, ts, seconds = _TICKS[base]
    return grid_cells(table(spark, sf_dir, name), ts, seconds)


def _ticks(spark: SparkSession, sf_dir: str, base: str) -> int:
    """Ticks of a base, by the counts that its files hold: no fewer than its bars."""
    return table(spark, sf_dir, _TICKS[base][0]).count()


def inputs(
    spark: SparkSession, sf_dir: str, base: str = "day", hold: int = 1
) -> tuple[DataFrame, Layout]:
    """Bars and the layout for them. Ticks on a time grid give at most one bar per cell, which
    bounds the series length by two column statistics instead of by counting bars."""
    bars = _BARS[base](spark, sf_dir)
    layout = choose_layout(
        bars,
        max_rows=_cells(spark, sf_dir, base),
        lookahead=hold,
    )
    return bars, with_tasks(layout, bars, _ticks(spark, sf_dir, base))


def _tie_shift(digits: int) -> float:
    """What is added before rounding, here and on the SQL side, to keep off decimal ties."""
    return float(f"1.37e-{digits + 3}")


def rounded(df: DataFrame, names: Sequence[str], digits: int = 4) -> DataFrame:
    """Rounded for comparison, with the shift off decimal ties that the SQL side also adds."""
    keep = [n for n in df.columns if n not in names]
    kinds = dict(df.dtypes)
    shift = F.lit(_tie_shift(digits))
    doubles = [n for n in names if kinds[n] == "double"]
    if len(doubles) > _WIDE:
        # One array in place of dozens of columns: the code made for them would be too long to be compiled to machine code.
        place = {n: i for i, n in enumerate(doubles)}
        array = F.transform(F.array(*[c(n) + shift for n in doubles]), lambda x: _half_up(x, digits))
        packed = df.select(*keep, *[n for n in names if n not in place], array.alias("_rounded"))
        return packed.select(*keep, *[F.get("_rounded", F.lit(place[n])).alias(n) if n in place else c(n) for n in names])
    return df.select(
        *keep,
        *[F.round(c(n) + shift, digits).alias(n) if kinds[n] == "double" else c(n) for n in names],
    )


def _half_up(x: Column, digits: int) -> Column:
    """``F.round`` by whole numbers, which needs no decimal number; near ties and for large values, where doubles could err, as it is."""
    scale = float(10**digits)
    whole = F.floor(x * scale + 0.5)
    sure = (F.abs(x * scale - whole) < 0.49) & (F.abs(x) < 1e13 / scale)
    return F.when(sure, whole / scale).otherwise(F.round(x, digits))


def compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in for a compliance list: suppliers that owe nothing."""
    supplier = table(spark, sf_dir, "supplier").where(c("s_acctbal") >= 0)
    return supplier.select(c("s_suppkey").cast("string").alias("symbol"))


COMPLIANCE_SQL = "SELECT CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_acctbal >= 0"


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in for fundamental snapshots: every ratio derived from the supplier's balance."""
    balance, nation = c("s_acctbal"), c("s_nationkey").cast("double")
    entries = [
        F.struct(F.lit(key).alias("key"), (balance / (i + 1) + nation).alias("value"))
        for i, key in enumerate(fund.DIRECT.values())
    ]
    # One key is null for small nation keys, one is absent for them, and equity can be zero.
    entries += [
        F.struct(F.lit(key).alias("key"), number.alias("value"))
        for key, number in (
            ("totalDebt", balance * 2),
            ("totalStockholderEquity", nation),
            ("sharesOutstanding", F.when(nation > 3, nation * 100)),
            ("debtToEquity", nation / 7),
        )
    ]
    info = F.map_from_entries(F.array(*entries))
    info = F.map_filter(
        info, lambda k, v: ~((k == "totalDebt") & (nation < 5)) & ~((k == "forwardPE") & (nation < 8))
    )
    hours = F.make_interval(hours=c("s_nationkey") + 1)
    return table(spark, sf_dir, "supplier").select(
        c("s_suppkey").cast("string").alias("symbol"),
        (F.lit("2024-01-02 00:00:00").cast("timestamp") - hours).alias("fetched_at"),
        info.alias("info"),
    )


# --- bars and sources -------------------------------------------------------------------------

_BAR_SQL = "SELECT symbol, date, round(open + 1.37e-7, 4) AS open, round(high + 1.37e-7, 4) AS high, round(low + 1.37e-7, 4) AS low, round(close + 1.37e-7, 4) AS close, round(volume + 1.37e-7, 4) AS volume FROM bars"
_OHLCV = ["open", "high", "low", "close", "volume"]

for _base in ("day", "hour", "user"):

    @register(f"b1_bars_{_base}", f"WITH {o.BASES[_base]} {_BAR_SQL}")
    def _(spark, d, base=_base):
        return rounded(_BARS[base](spark, d), _OHLCV)


@register(
    "s01_j3_bars_of_symbols_since",
    f"WITH {o.DAY_BARS} {_BAR_SQL} WHERE date >= DATE '2000-01-01' AND symbol IN ({COMPLIANCE_SQL})",
)
def _(spark, d):
    bars = restrict(day_bars(spark, d), symbols=compliance(spark, d), start="2000-01-01")
    return rounded(bars, _OHLCV)


@register(
    "s02_s03_headers",
    "SELECT o_orderkey AS open, o_custkey AS close, CAST(o_orderdate AS DATE) AS date FROM orders",
)
def _(spark, d):
    raw = table(spark, d, "orders").select(
        c("o_orderkey").alias("Open"),
        c("o_custkey").alias("Close"),
        c("o_orderstatus").alias("open"),
        F.to_date("o_orderdate").alias("Date"),
    )
    return require_columns(normalise_headers(raw), ["open", "close", "date"])


@register(
    "s04_p01_universe_request",
    "SELECT DISTINCT upper(s_name) || '.JK' AS symbol FROM supplier",
)
def _(spark, d):
    universe = table(spark, d, "supplier").select(c("s_name").alias("symbol"))
    return requested_symbols(spark, "", universe)


@register(
    "p01_c08_parse_symbols",
    """SELECT doc_id, upper(trim(p)) || '.JK' AS symbol FROM (
         SELECT doc_id, unnest(string_split(lang || ', ' || source || ',, x', ',')) AS p FROM documents)
       WHERE trim(p) <> ''""",
)
def _(spark, d):
    raw = F.concat("lang", F.lit(", "), "source", F.lit(",, x"))
    return table(spark, d, "documents").select(
        "doc_id", F.explode(scalars.parse_symbols(raw)).alias("symbol")
    )


@register(
    "s07_fresh_snapshots",
    """SELECT CAST(s_suppkey AS VARCHAR) AS symbol,
              TIMESTAMP '2024-01-02 00:00:00' - to_hours(s_nationkey + 1) AS fetched_at
       FROM supplier WHERE s_nationkey + 1 < 24""",
)
def _(spark, d):
    as_of = F.lit("2024-01-02 00:00:00").cast("timestamp")
    return fund.fresh_snapshots(snapshots(spark, d), as_of).select("symbol", "fetched_at")


def _gappy_bars(spark: SparkSession, d: str) -> DataFrame:
    """Day bars of which every third symbol has no close where much was traded."""
    bars = day_bars(spark, d)
    gap = (c("volume") >= 75) & (c("symbol").cast("int") % 3 == 0)
    return bars.withColumn("close", F.when(~gap, c("close")))


_GAPPY_SQL = f"WITH {o.DAY_BARS}, g AS (SELECT *, {o.GAP} AS bad FROM bars)"


@register("s11_bar_rejects", f"{_GAPPY_SQL} SELECT symbol, date, 'missing price' AS reason FROM g WHERE bad")
def _(spark, d):
    return split_rejects(_gappy_bars(spark, d))[1]


@register(
    "s11_symbols_kept",
    f"""{_GAPPY_SQL} SELECT symbol, count(*) AS n FROM g
        WHERE symbol NOT IN (SELECT symbol FROM g WHERE bad) GROUP BY symbol""",
)
def _(spark, d):
    good, _bad = without_failing_symbols(_gappy_bars(spark, d))
    return good.groupBy("symbol").agg(F.count("*").alias("n"))


def _repeated_bars(spark: SparkSession, d: str) -> DataFrame:
    """Day bars, of some symbols twice or three times, of others also with another close on some days."""
    bars, key = day_bars(spark, d), c("symbol").cast("int")
    other = bars.where((key % 7 == 0) & (F.dayofmonth("date") % 3 == 0)).withColumn("close", c("close") + 1)
    return bars.unionByName(bars.where(key % 5 == 0)).unionByName(bars.where(key % 10 == 0)).unionByName(other)


@register(
    "s11_duplicate_bars",
    f"""WITH {o.DAY_BARS},
        m AS (SELECT *, CAST(symbol AS INTEGER) % 7 = 0 AND day(date) % 3 = 0 AS bad FROM bars)
        SELECT symbol, date, CASE WHEN NOT bad THEN round(close + 1.37e-7, 4) END AS close,
          CASE WHEN bad THEN 'contradicting bars' END AS reason, CASE WHEN NOT bad THEN row_number() OVER (PARTITION BY symbol, bad ORDER BY date) END AS rn FROM m""",
)
def _(spark, d):
    good, rejects = split_duplicates(_repeated_bars(spark, d))
    numbered = SymbolLayout().prepare(good).select("symbol", "date", "close", F.lit(None).cast("string").alias("reason"), (c("_rn") + 1).cast("bigint").alias("rn"))
    none = [F.lit(None).cast("double").alias("close"), "reason", F.lit(None).cast("bigint").alias("rn")]
    return rounded(numbered.unionByName(rejects.select("symbol", "date", *none)), ["close"])


def _event_states(spark, d, bucket, where="TRUE"):
    ticks = table(spark, d, "events").where(where)
    return bar_states(ticks, symbol=c("event_type"), ts=c("ts"), price=c("value"), order=F.struct("ts", "event_id"), bucket=bucket)


_EVENT_DAYS = o.HOUR_BARS.replace("date_trunc('hour', ts)", "CAST(ts AS DATE)")


@register("b1_rollup_hour_to_day", f"WITH {_EVENT_DAYS} {_BAR_SQL}")
def _(spark, d):
    days = merge_states(_event_states(spark, d, "hour"), "day")
    return rounded(bars_of(days), _OHLCV)


@register("b1_merge_late_ticks", f"WITH {o.HOUR_BARS} {_BAR_SQL}")
def _(spark, d):
    stored, late = (_event_states(spark, d, "hour", f"event_id % 10 {op} 0") for op in ("<>", "="))
    return rounded(bars_of(merge_states(stored.unionByName(late))), _OHLCV)


@register(
    "s12_lookback_bars",
    f"WITH {o.DAY_BARS} {_BAR_SQL} WHERE date >= DATE '2001-11-04' - INTERVAL 12 MONTH",
)
def _(spark, d):
    return rounded(recent_bars(day_bars(spark, d), shipped(), "2001-11-04"), _OHLCV)


# --- indicators -------------------------------------------------------------------------------


def indicators(spark, d, names, base="day", digits=4):
    bars, layout = inputs(spark, d, base)
    return _rounded_indicators(bars, layout, names, digits)


def _rounded_indicators(bars: DataFrame, layout: Layout, names: Sequence[str], digits: int = 4) -> DataFrame:
    """Indicators rounded as ``rounded`` does, where they are made: many columns are one pass over arrays."""
    frame = result_rows(add_technical(bars, layout, names, complete=True, decimals=digits, shift=_tie_shift(digits)), layout)
    return frame.select("symbol", "date", *names)


def register_indicators(key: str, names: Sequence[str], base: str = "day") -> None:
    names = list(names)
    QUERIES[key] = lambda spark, d: indicators(spark, d, names, base)
    ORACLES[key] = o.indicator_query(names, base)


_FAMILIES = {
    "w01_p03_raw_columns": RAW_COLUMNS,
    "w02_o01_previous_price": ["PREVIOUS_PRICE"],
    "w03_c06_returns": [f"PRICE_RETURN_{n}D_PCT" for n in RETURN_LAGS],
    "w04_percent_spike": ["PERCENT_SPIKE"],
    "w05_c03_volume_spike": ["VOLUME_SPIKE"],
    "w06_rvol": ["RVOL"],
    "w07_moving_averages": [f"MA{n}" for n in (5, 10, 20, 50, 100, 200)],
    "w08_volume_averages": ["VMA5", "VMA10", "VMA20"],
    "w09_a13_c01_atr": ["ATR14"],
    "w10_bollinger": ["BB_MIDDLE", "BB_UPPER", "BB_LOWER", "BB_WIDTH", "BB_PERCENT_B"],
    "w11_c02_rsi": ["RSI14"],
    "w12_r1_macd": ["MACD_LINE", "MACD_SIGNAL", "MACD_HISTOGRAM"],
    "w13_stochastic": ["STOCH_K", "STOCH_D"],
    "w14_high_low": ["HH3", "LL3", "HH20", "LL20"],
    "w15_fibonacci": list(FIBONACCI),
    "w16_support_resistance": ["SUPPORT", "RESISTANCE"],
    "w17_vwma": ["VWMA", "VWAP"],
    "w25_r2_c04_adx": ["ADX_PLUS", "ADX_MINUS", "ADX14"],
    "w26_trade_frequency": ["TRADE_FREQUENCY"],
    "w27_high_vol_days": ["HIGH_VOL_DAYS"],
    "x4_d19_custom_windows": ["MA37", "VMA33", "HH15", "LL120", "HH77", "MA250"],
}
for _key, _names in _FAMILIES.items():
    register_indicators(_key, _names)
_CANDLES = {
    "w18_three_red": ["THREE_RED_CANDLES"],
    "w19_three_green": ["THREE_GREEN_CANDLES"],
    "w20_doji": ["DOJI"],
    "w21_hammer": ["HAMMER", "HANGING_MAN"],
    "w22_shooting_star": ["SHOOTING_STAR"],
    "w23_morning_star": ["MORNING_STAR"],
    "w24_evening_star": ["EVENING_STAR"],
}
for _key, _names in _CANDLES.items():
    register_indicators(_key, _names, "hour")
register_indicators("w28_w29_all_61_columns", TECHNICAL_COLUMNS)
register_indicators("w_all_hour_bars", TECHNICAL_COLUMNS, "hour")
register_indicators("w_all_short_series", TECHNICAL_COLUMNS, "user")
register_indicators("x4_very_long_windows", ["MA5000", "VMA5000", "HH5000", "LL5000", "MA1111"], "line")
register_indicators("r1_exponential_averages", ["EMA9", "EMA50", "EMA500"])


# The longest window asked is 200 rows; exponential and Wilder averages read nothing before their block.
_BLOCKS = BlockLayout(block_rows=512, lookback=200, lookahead=5)
_BLOCKS_OF_HOLDS = BlockLayout(block_rows=1024, lookback=64, lookahead=6)
_EMA_BLOCKS = BlockLayout(block_rows=128, lookback=64)
_LONG_BLOCKS = BlockLayout(block_rows=1024, lookback=5000)
_EXPONENTIAL = ["EMA500", "EMA20", "MACD_HISTOGRAM", "ADX14"]
_VERY_LONG = ["MA5000", "VMA5000", "HH5000", "LL5000", "MA1111"]
_SMALL_BLOCKS = BlockLayout(block_rows=128, lookback=320)
_SEGMENTS = SymbolLayout(max_rows=4096, segment_rows=64)
_LONG_WINDOWS = ["MA250", "VMA150", "HH300", "LL200"]
_AVERAGED = ["MACD_LINE", "MACD_SIGNAL", "MACD_HISTOGRAM", "ADX14", "ADX_PLUS", "ADX_MINUS"]


def _in_layout(layout: Layout, names: Sequence[str], base: str = "day") -> Query:
    def run(spark, d):
        bars = _BARS[base](spark, d)
        dealt = with_tasks(layout, bars, _ticks(spark, d, base), _cells(spark, d, base))
        return _rounded_indicators(bars, dealt, names)

    return run


for _key, _layout, _names, _base in (
    ("block_all_61_columns", _BLOCKS, TECHNICAL_COLUMNS, "day"),
    ("block_long_window", _SMALL_BLOCKS, _LONG_WINDOWS, "day"),
    ("block_exponential_averages", _EMA_BLOCKS, _EXPONENTIAL, "day"),
    ("block_very_long_windows", _LONG_BLOCKS, _VERY_LONG, "line"),
    ("r1_r2_segmented_averages", _SEGMENTS, _AVERAGED, "day"),
):
    QUERIES[_key], ORACLES[_key] = _in_layout(_layout, _names, _base), o.indicator_query(_names, _base)


_KEPT = ["MACD_LINE", "RSI14", "MA20", "PREVIOUS_PRICE"]


@register("s11_d23_indicators_after_rejects", o.indicator_query(_KEPT, "kept"))
def _(spark, d):
    _, layout = inputs(spark, d)
    frame = add_technical(split_rejects(_gappy_bars(spark, d))[0], layout, _KEPT, complete=True)
    return rounded(result_rows(frame, layout).select("symbol", "date", *_KEPT), _KEPT)


@register(
    "d06_warmup_null",
    f"""{o.chain(["MA200", "RSI14"], fill=False)}
        SELECT symbol, date, round("MA200" + 1.37e-7, 4) AS "MA200",
               round(last_value("RSI14" IGNORE NULLS) {o.SO_FAR} + 1.37e-7, 4) AS "RSI14" FROM ind""",
)
def _(spark, d):
    bars, layout = inputs(spark, d)
    frame = add_technical(bars, layout, ["MA200", "RSI14"], warmup="null")
    return rounded(result_rows(frame, layout).select("symbol", "date", "MA200", "RSI14"), ["MA200", "RSI14"])


@register(
    "w30_o02_latest_bar",
    f"""{o.chain(["CLOSE", "MA20"])} SELECT symbol, date, {o.rounded(["CLOSE", "MA20"])} FROM ind
        QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1""",
)
def _(spark, d):
    bars, layout = inputs(spark, d)
    last = scan_op.latest_bars(add_technical(bars, layout, ["MA20"]), layout)
    return rounded(last.select("symbol", "date", "CLOSE", "MA20"), ["CLOSE", "MA20"])


@register(
    "a14_last_close",
    f"WITH {o.DAY_BARS} SELECT symbol, round(arg_max(close, date) + 1.37e-7, 4) AS last_close FROM bars GROUP BY symbol",
)
def _(spark, d):
    return rounded(fund.last_closes(day_bars(spark, d)), ["last_close"])


# --- fundamentals -----------------------------------------------------------------------------

_F_ENTRIES = [
    f"CASE WHEN true {'AND s_nationkey >= 8' if key == 'forwardPE' else ''} THEN "
    f"coalesce((s_acctbal / {i + 1} + s_nationkey){' * 100' if key == 'dividendYield' else ''}, 0)"
    f' ELSE 0 END AS "{name}"'
    for i, (name, key) in enumerate(fund.DIRECT.items())
]
_CF_INDEX = list(fund.DIRECT).index("OPERATING_CF") + 1
_F_SQL = f"""WITH {o.DAY_BARS},
last AS (SELECT symbol, arg_max(close, date) AS close FROM bars GROUP BY symbol),
info AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS symbol, {", ".join(_F_ENTRIES)},
    CASE WHEN s_nationkey >= 5 THEN s_acctbal * 2 / s_nationkey ELSE s_nationkey / 7.0 END
      AS "DEBT_TO_EQUITY",
    (s_acctbal / {_CF_INDEX} + s_nationkey)
      / CASE WHEN s_nationkey > 3 THEN s_nationkey * 100.0 END AS cf
  FROM supplier),
f AS (SELECT last.symbol, last.close, info.* EXCLUDE (symbol, cf),
        coalesce(last.close / nullif(cf, 0), 0) AS "PRICE_TO_CF"
      FROM last LEFT JOIN info USING (symbol))"""


def _fundamentals(names):
    def run(spark, d):
        frame = fund.fundamental_columns(day_bars(spark, d), snapshots(spark, d))
        return rounded(frame.select("symbol", *names), names)

    parts = ", ".join(f'round(coalesce("{n}", 0) + 1.37e-7, 4) AS "{n}"' for n in names)
    return run, f"{_F_SQL} SELECT symbol, {parts} FROM f"


for _i, _name in enumerate(fund.DIRECT, start=1):
    _run, _sql = _fundamentals([_name])
    QUERIES[f"f{_i:02d}_{_name.lower()}"] = _run
    ORACLES[f"f{_i:02d}_{_name.lower()}"] = _sql
for _key, _name in (("f22_c16_debt_to_equity", "DEBT_TO_EQUITY"), ("f23_price_to_cf", "PRICE_TO_CF")):
    QUERIES[_key], ORACLES[_key] = _fundamentals([_name])


def many_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshots, older ones with other figures, and for some symbols one from the future."""
    base = snapshots(spark, sf_dir)
    other = F.transform_values("info", lambda k, v: v * 3 + 1)
    older = base.withColumns({"fetched_at": c("fetched_at") - F.expr("INTERVAL 1 HOUR"), "info": other})
    later = base.where(c("symbol").cast("int") % 2 == 0)
    later = later.withColumns({"fetched_at": F.lit("2024-01-03 00:00:00").cast("timestamp"), "info": other})
    return base.unionByName(older).unionByName(later)


@register(
    "j1_s07_fresh_of_many_snapshots",
    f"""{_F_SQL}, fresh AS (SELECT CAST(s_suppkey AS VARCHAR) AS symbol FROM supplier WHERE s_nationkey + 1 < 24)
        SELECT bars.symbol, bars.date, round(bars.close + 1.37e-7, 4) AS "CLOSE",
        round(CASE WHEN fresh.symbol IS NULL THEN 0 ELSE coalesce("TRAILING_PE", 0) END + 1.37e-7, 4) AS "TRAILING_PE",
        round(CASE WHEN fresh.symbol IS NULL THEN 0 ELSE "PRICE_TO_CF" END + 1.37e-7, 4) AS "PRICE_TO_CF"
        FROM bars JOIN f USING (symbol) LEFT JOIN fresh USING (symbol)""",
)
def _(spark, d):
    bars, layout = inputs(spark, d)
    names = ["CLOSE", "TRAILING_PE", "PRICE_TO_CF"]
    frame = indicator_frame(
        bars, names[1:], layout, snapshots=many_snapshots(spark, d), as_of="2024-01-02 00:00:00", complete=True
    )
    return rounded(frame.select("symbol", "date", *names), names)


@register(
    "j1_bars_with_fundamentals",
    f"""{_F_SQL} SELECT bars.symbol, bars.date, round(bars.close + 1.37e-7, 4) AS "CLOSE",
        round(coalesce("TRAILING_PE", 0) + 1.37e-7, 4) AS "TRAILING_PE", round("PRICE_TO_CF" + 1.37e-7, 4) AS "PRICE_TO_CF"
        FROM bars JOIN f USING (symbol)""",
)
def _(spark, d):
    bars, layout = inputs(spark, d)
    frame = indicator_frame(bars, ["TRAILING_PE", "PRICE_TO_CF"], layout, snapshots=snapshots(spark, d))
    names = ["CLOSE", "TRAILING_PE", "PRICE_TO_CF"]
    return rounded(frame.select("symbol", "date", *names), names)


# --- rules ------------------------------------------------------------------------------------

_TREND = ["CLOSE > MA20", "VOLUME >= VMA20 * 0.8"]
_TREND_COLUMNS = ["OPEN", "HIGH", "LOW", "CLOSE", "VOLUME", "MA20", "VMA20", "ATR14"]
_EXACT = f"{o.chain(_TREND_COLUMNS)}, x AS (SELECT symbol, date, rn, {o.exact(_TREND_COLUMNS)} FROM ind)"


def exact_frame(spark, d, strategies, hold=1, base="day", extra=(), within=None, latest=False):
    if within:
        bars = _BARS[base](spark, d)
        layout = with_tasks(within, bars, _ticks(spark, d, base), _cells(spark, d, base))
    else:
        bars, layout = inputs(spark, d, base, hold)
    names = list(dict.fromkeys([*columns_of(strategies), *extra]))
    return indicator_frame(bars, names, layout, decimals=8, complete=True, latest=latest), layout


@register(
    "p05_p06_t02_t03_x2_signal_rows",
    f"""{_EXACT} SELECT symbol, date, round("CLOSE" + 1.37e-7, 4) AS entry_price,
        round("CLOSE" + "ATR14" * 3 + 1.37e-7, 4) AS take_profit, round("CLOSE" - "ATR14" * 2 + 1.37e-7, 4) AS stop_loss
        FROM x WHERE "CLOSE" > "MA20" AND "VOLUME" >= "VMA20" * 0.8""",
)
def signal_rows(spark, d):
    s = Strategy.from_mapping({"name": "TREND", "entry": _TREND})
    frame, layout = exact_frame(spark, d, [s])
    marked = frame.withColumns({"_hit": all_met(s.entry), "take_profit": value(s.target), "stop_loss": value(s.stop)},
    )
    rows = result_rows(marked.where("_hit"), layout)
    out = rows.select("symbol", "date", c("CLOSE").alias("entry_price"), "take_profit", "stop_loss")
    return rounded(out, ["entry_price", "take_profit", "stop_loss"])


@register(
    "p05_rule_over_zero",
    f"""{o.chain(["CLOSE", "RSI14", "BB_WIDTH"], "hour")}
        SELECT symbol, date, CASE WHEN coalesce("CLOSE" / nullif(round("BB_WIDTH", 8), 0) > 0.5, false)
        THEN 1 ELSE 0 END AS hit FROM ind""",
)
def _(spark, d):
    bars, layout = inputs(spark, d, "hour")
    frame = indicator_frame(bars, columns_used(["CLOSE / BB_WIDTH > 0.5"]), layout, decimals=8)
    hit = {"hit": scalars.flag(all_met(["CLOSE / BB_WIDTH > 0.5"]))}
    return result_rows(frame.withColumns(hit), layout).select("symbol", "date", "hit")


@register(
    "p09_p10_c12_period_bars",
    f"""{o.chain(["CLOSE", "MA50"])} SELECT symbol, date, {o.rounded(["CLOSE", "MA50"])} FROM ind
        QUALIFY date >= max(date) OVER (PARTITION BY symbol) - INTERVAL 90 DAY""",
)
def _(spark, d):
    bars, layout = inputs(spark, d)
    frame = trade_op.in_range(add_technical(bars, layout, ["MA50"]), layout, period="3m")
    out = result_rows(frame.where("_in"), layout).select("symbol", "date", "CLOSE", "MA50")
    return rounded(out, ["CLOSE", "MA50"])


@register(
    "x1_c10_a15_names_in_texts",
    """SELECT doc_id, CAST(len(list_distinct(regexp_extract_all(text, '[A-Z][a-z]+(\\d+)', 1))) AS INTEGER) AS numbers
       FROM documents""",
)
def _(spark, d):
    found = scalars.named_numbers(c("text"), r"[A-Z][a-z]+(\d+)")
    return table(spark, d, "documents").select("doc_id", F.size(found).alias("numbers"))


def _strategy_texts(spark: SparkSession, d: str) -> DataFrame:
    """Strategy files made from suppliers: lists, single texts, missing names, broken and empty ones."""
    key, nation = c("s_suppkey"), c("s_nationkey")
    number = (key % 40 + 5).cast("string")
    rule = F.concat(F.lit("CLOSE > MA"), number)
    entry = F.when(nation % 3 == 0, F.concat(F.lit('"'), rule, F.lit('"'))).otherwise(
        F.concat(F.lit('["'), rule, F.lit('", "VOLUME > 0"]'))
    )
    name = F.when(nation % 5 == 0, F.lit("")).otherwise(F.concat(F.lit('"name": "S'), (key % 7).cast("string"), F.lit('", ')))
    text = F.concat(F.lit("{"), name, F.lit('"max_hold_days": '), (key % 9).cast("string"), F.lit(', "entry": '), entry, F.lit("}"))
    value = F.when(nation == 1, F.lit(" ")).when(nation == 2, F.lit('{"entry": [')).otherwise(text)
    file = F.concat(F.lit("f"), F.lpad(key.cast("string"), 9, "0"), F.lit(".json"))
    return table(spark, d, "supplier").select(value.alias("value"), file.alias("file"))


@register(
    "s06_x1_c15_c20_strategy_texts",
    """WITH f AS (
         SELECT s_suppkey AS k, CASE WHEN s_nationkey % 5 = 0 THEN 'f' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0')
                ELSE 'S' || s_suppkey % 7 END AS name, CAST(s_suppkey % 9 AS INTEGER) AS max_hold,
           'CLOSE > MA' || (s_suppkey % 40 + 5) || CASE WHEN s_nationkey % 3 = 0 THEN '' ELSE '|VOLUME > 0' END AS entry
         FROM supplier WHERE s_nationkey NOT IN (1, 2))
       SELECT name, entry, max_hold FROM f QUALIFY row_number() OVER (PARTITION BY name ORDER BY k DESC) = 1""",
)
def _(spark, d):
    rows = parse_strategies(_strategy_texts(spark, d))
    return rows.select("name", F.array_join("entry", "|").alias("entry"), c("max_hold_days").alias("max_hold"))


@register("s04_s05_symbol_list_texts", "SELECT s_name AS symbol, s_name AS name FROM supplier")
def _(spark, d):
    # Lists of at most 100 names each.
    names = table(spark, d, "supplier").groupBy(F.floor(c("s_suppkey") / 100)).agg(F.to_json(F.collect_list("s_name")).alias("value"))
    return parse_symbol_list(names)


@register("c14_text_to_timestamp", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_orderdate AS TIMESTAMP) END AS at FROM orders")
def _(spark, d):
    text = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    text = F.when(c("o_orderkey") % 5 > 0, text).otherwise(F.lit("no date"))
    return table(spark, d, "orders").select("o_orderkey", scalars.text_timestamp(text).alias("at"))


@register(
    "c18_zip_of_unequal_lists",
    """SELECT p_partkey, CAST(i AS INTEGER) AS level, round(1.0 / i, 6) AS ratio
       FROM part, generate_series(1, 9) AS g(i) WHERE i <= least(p_size % 5 + 1, p_partkey % 4 + 1)""",
)
def _(spark, d):
    levels = F.sequence(F.lit(1), (c("p_size") % 5 + 1).cast("int"))
    ratios = F.transform(F.sequence(F.lit(1), (c("p_partkey") % 4 + 1).cast("int")), lambda i: F.round(1.0 / i, 6))
    zipped = scalars.zip_shorter(levels, ratios, ("level", "ratio"))
    return table(spark, d, "part").select("p_partkey", F.inline(zipped).alias("level", "ratio"))


# --- scalar functions -------------------------------------------------------------------------


@register(
    "c07_share_count",
    """SELECT l_orderkey, l_linenumber, l_extendedprice, l_quantity,
       CAST(floor(1000000 / nullif(l_extendedprice / l_quantity, 0)) AS DOUBLE) AS shares FROM lineitem""",
)
def _(spark, d):
    price = c("l_extendedprice") / c("l_quantity")
    return table(spark, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_extendedprice",
        "l_quantity",
        scalars.share_count(F.lit(AMOUNT), price).alias("shares"),
    )


@register(
    "c09_percent_text",
    """SELECT l_orderkey, l_linenumber, l_discount, l_tax,
       round(CASE WHEN l_tax > 0.03 THEN round(l_discount * 100 + 1.37e-5, 2) / 100 ELSE l_discount END, 6) AS part
       FROM lineitem""",
)
def _(spark, d):
    percent = F.concat(F.round(c("l_discount") * 100, 2).cast("string"), F.lit("%"))
    text = F.when(c("l_tax") > 0.03, percent).otherwise(c("l_discount").cast("string"))
    return table(spark, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_discount",
        "l_tax",
        F.round(scalars.percent_fraction(text), 6).alias("part"),
    )


@register(
    "c11_c13_c14_dates",
    """SELECT o_orderkey, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') AS INTEGER) AS held,
       strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders""",
)
def _(spark, d):
    return table(spark, d, "orders").select(
        "o_orderkey",
        scalars.days_held(c("o_orderdate"), F.lit("2002-01-01").cast("timestamp")).alias("held"),
        scalars.iso_date(c("o_orderdate")).alias("iso"),
    )


@register(
    "p02_p12_j2_c17_marked_symbols",
    f"""SELECT CAST(s_suppkey AS VARCHAR) || '.JK' AS symbol,
        CAST(s_suppkey AS VARCHAR) || CASE WHEN CAST(s_suppkey AS VARCHAR) IN ({COMPLIANCE_SQL})
        THEN '' ELSE '*' END AS ticker FROM supplier""",
)
def _(spark, d):
    symbols = table(spark, d, "supplier").select(
        F.concat(c("s_suppkey").cast("string"), F.lit(".JK")).alias("symbol")
    )
    marked = scan_op.with_compliance(symbols, compliance(spark, d))
    return marked.select(
        "symbol", scalars.display_symbol(c("symbol"), c("compliant")).alias("ticker")
    )


@register(
    "c18_c19_c20_levels_and_ratios",
    """SELECT part.p_partkey, CAST(i AS INTEGER) AS level, round(1.0 / n, 6) AS ratio
       FROM (SELECT p_partkey, (p_size % 5) + 1 AS n FROM part) part, generate_series(1, 5) AS g(i) WHERE i <= n""",
)
def _(spark, d):
    n = (c("p_size") % 5 + 1).cast("int")
    zipped = F.arrays_zip(
        F.sequence(F.lit(1), n).alias("level"),
        F.transform(scalars.equal_ratios(n), lambda x: F.round(x, 6)).alias("ratio"),
    )
    return table(spark, d, "part").select("p_partkey", F.inline(zipped).alias("level", "ratio"))


_SHORT_LIST = ["1", "3", "4", "8", "10"]


@register(
    "c17_listed_and_prefixed",
    f"""SELECT CAST(s_suppkey AS VARCHAR) || '.JK' AS symbol, CAST(s_suppkey AS VARCHAR) IN ({", ".join(map(repr, _SHORT_LIST))}) AS compliant,
        starts_with(CAST(s_suppkey AS VARCHAR), '1') OR starts_with(CAST(s_suppkey AS VARCHAR), '42') AS prefixed FROM supplier""",
)
def _(spark, d):
    symbols = table(spark, d, "supplier").select(F.concat(c("s_suppkey").cast("string"), F.lit(".JK")).alias("symbol"))
    marked = scan_op.with_compliance(symbols, _SHORT_LIST)
    return marked.withColumn("prefixed", scalars.has_prefix(c("symbol"), ["1", "42"]))


# --- scan -------------------------------------------------------------------------------------

_LOOSE = {
    "name": "LOOSE",
    "entry": ["CLOSE > MA5", "VOLUME > 0"],
    "tp": ["CLOSE + ATR14 * 2", "CLOSE * 9"],
    "sl": "ENTRY_PRICE * 0.97",
}


def _scan_strategies() -> list[Strategy]:
    return [*shipped(), Strategy.from_mapping({**_LOOSE, "tp": _LOOSE["tp"][:1]}),
            Strategy.from_mapping({"name": "DEFAULTS", "entry": ["CLOSE < MA20"]})]


def _scan_hits(spark, d, within=None):
    strategies = _scan_strategies()
    frame, layout = exact_frame(spark, d, strategies, within=within, latest=True)
    return scan_op.scan(frame, strategies, layout)


@register("t01_j4_scan_hits", ot.scan_hits_sql())
def _(spark, d):
    return rounded(_scan_hits(spark, d), ["entry_price", "stop_loss", "take_profit"])


@register(
    "p11_p13_s08_scan_rows",
    ot.scan_rows_sql(COMPLIANCE_SQL, AMOUNT),
)
def _(spark, d):
    bars, layout = inputs(spark, d)
    rows = scan_request(
        bars, _scan_strategies(), compliance(spark, d), layout, amount=AMOUNT, decimals=8, complete=True
    )
    return rounded(
        rows,
        ["price", "entry_price", "stop_loss", "take_profit", "est_profit_pct", "est_profit_rp",
         "est_loss_pct", "est_loss_rp"],
        2,
    )


@register("block_scan", ot.scan_hits_sql())
def _(spark, d):
    return rounded(_scan_hits(spark, d, _BLOCKS), ["entry_price", "stop_loss", "take_profit"])


@register("s10_o05_scan_display_page", ot.scan_page_sql(COMPLIANCE_SQL, AMOUNT, 0, 25))
def _(spark, d):
    rows = page(scan_op.scan_rows(_scan_hits(spark, d), compliance(spark, d), AMOUNT), SCAN_ORDER, 0, 25)
    doubles = [n for n, t in rows.dtypes if t == "double" and n != "pnl"]
    return scan_display(rounded(rows, doubles, 2))


# --- trades -----------------------------------------------------------------------------------


def trades_of(spark, d, strategies, base="day", within=None, marks=False, **when):
    hold = max(max(1, s.max_hold) for s in strategies)
    frame, layout = exact_frame(spark, d, strategies, hold, base, within=within)
    ranged = trade_op.in_range(frame, layout, **when)
    return extract_trades(ranged, strategies, AMOUNT, layout, marks)


def rounded_trades(trades):
    return rounded(
        trades, ["entry_price", "exit_price", "pnl", "roi_pct", "stop_loss", "take_profit"], 2
    )


_TP_SL = {
    "name": "LEVELS",
    "entry": ["CLOSE > MA20", "RSI14 > 40"],
    "tp": ["CLOSE + ATR14"],
    "sl": ["ENTRY_PRICE - ATR14 * 0.5", "ENTRY_PRICE * 0.5"],
    "max_hold_days": 7,
}
_TRAIL = {"name": "TRAIL", "entry": ["CLOSE > MA10"], "ts": "15%", "max_hold_days": 4}
_LONG_HOLD = {
    "name": "LONG_HOLD",
    "entry": ["CLOSE < MA50"],
    "tp": ["CLOSE * 1.9"],
    "sl": ["ENTRY_PRICE * 0.05"],
    "ts": 0.9,
    "max_hold_days": 40,
}
_FUNCTIONS = {
    "name": "FUNCTIONS",
    "entry": ["CLOSE > MA10"],
    "tp": ["CLOSE * 1.3"],
    "sl": [
        "GREATEST(ENTRY_PRICE * 0.6, CLOSE - ATR14)",
        "CASE WHEN ENTRY_PRICE > 1300 THEN LEAST(CLOSE * 0.9, ENTRY_PRICE * 0.8) ELSE MA20 * 0.5 END",
    ],
    "max_hold_days": 6,
}
_FIXED_STOP = {"name": "FIXED", "entry": ["CLOSE > MA20"], "tp": ["CLOSE + ATR14"], "sl": ["CLOSE - ATR14 * 0.5"], "stop": "fixed", "max_hold_days": 5}
_DENSE = {"name": "DENSE", "entry": ["CLOSE > 0"], "tp": ["CLOSE * 1.02"], "sl": ["ENTRY_PRICE * 0.98"], "max_hold_days": 6}
_HELD_200 = {
    "name": "HELD_200",
    "entry": ["CLOSE < MA50"],
    "tp": ["CLOSE * 3"],
    "sl": ["ENTRY_PRICE * 0.02", "LEAST(MA20 * 0.2, ENTRY_PRICE - ATR14 * 2)"],
    "ts": 0.97,
    "max_hold_days": 200,
}
_CASE_200 = {
    "name": "CASE_200",
    "entry": ["CLOSE < MA50"],
    "tp": ["CLOSE * 3"],
    "sl": ["CASE WHEN ENTRY_PRICE > 1300 THEN ENTRY_PRICE * 0.1 ELSE MA20 * 0.05 END"],
    "max_hold_days": 200,
}
_MADE = {s["name"]: s for s in (_TP_SL, _TRAIL, _LONG_HOLD, _FUNCTIONS, _FIXED_STOP, _DENSE, _HELD_200, _CASE_200)}


def made(name: str) -> Strategy:
    return Strategy.from_mapping(_MADE[name])


@register("t03_to_t14_t20_shipped_trades", ot.trades_sql(shipped(), AMOUNT))
def shipped_trades(spark, d):
    return rounded_trades(trades_of(spark, d, shipped()))


@register("t11_two_stop_levels", ot.trades_sql([Strategy.from_mapping(_TP_SL)], AMOUNT))
def _(spark, d):
    return rounded_trades(trades_of(spark, d, [made("LEVELS")]))


@register("p06_x2_t11_functions_of_entry_price", ot.trades_sql([Strategy.from_mapping(_FUNCTIONS)], AMOUNT))
def _(spark, d):
    return rounded_trades(trades_of(spark, d, [made("FUNCTIONS")]))


@register("d05_fixed_stop", ot.trades_sql([Strategy.from_mapping(_FIXED_STOP)], AMOUNT))
def _(spark, d):
    return rounded_trades(trades_of(spark, d, [made("FIXED")]))


@register("block_trades", ot.trades_sql(shipped(), AMOUNT))
def _(spark, d):
    return rounded_trades(trades_of(spark, d, shipped(), within=_BLOCKS))


@register("t09_t10_trailing_stop", ot.trades_sql([Strategy.from_mapping(_TRAIL)], AMOUNT))
def _(spark, d):
    return rounded_trades(trades_of(spark, d, [made("TRAIL")]))


@register("t08_x3_dynamic_amount", ot.trades_sql([example("DYNAMIC_AMOUNT_STRATEGY")], AMOUNT))
def _(spark, d):
    return rounded_trades(trades_of(spark, d, [example("DYNAMIC_AMOUNT_STRATEGY")]))


@register("t12_full_take_profit", ot.trades_sql([example("FULL_TP_STRATEGY")], AMOUNT))
def _(spark, d):
    return rounded_trades(trades_of(spark, d, [example("FULL_TP_STRATEGY")]))


@register("t13_long_hold_fold", ot.trades_sql([Strategy.from_mapping(_LONG_HOLD)], AMOUNT))
def _(spark, d):
    return rounded_trades(trades_of(spark, d, [made("LONG_HOLD")]))


@register("t15_t16_t17_partial_take_profit", ot.trades_sql([example("PARTIAL_TP_STRATEGY")], AMOUNT))
def _(spark, d):
    return rounded_trades(trades_of(spark, d, [example("PARTIAL_TP_STRATEGY")]))


@register("t18_t19_averaging", ot.trades_sql([example("MULTI_AVG_STRATEGY")], AMOUNT))
def _(spark, d):
    return rounded_trades(trades_of(spark, d, [example("MULTI_AVG_STRATEGY")]))


@register("t_dense_candidates", ot.trades_sql([Strategy.from_mapping(_DENSE)], AMOUNT, base="line"))
def _(spark, d):
    """Every bar is a signal, and one of the few symbols has half of all bars."""
    return rounded_trades(trades_of(spark, d, [made("DENSE")], "line", _BLOCKS_OF_HOLDS))


@register("t13_hold_of_200_bars", ot.trades_sql([Strategy.from_mapping(_HELD_200)], AMOUNT))
def _(spark, d):
    return rounded_trades(trades_of(spark, d, [made("HELD_200")]))


@register("t13_hold_of_200_bars_by_case", ot.trades_sql([Strategy.from_mapping(_CASE_200)], AMOUNT))
def _(spark, d):
    return rounded_trades(trades_of(spark, d, [made("CASE_200")]))


@register("block_hold_of_200_bars", ot.trades_sql([Strategy.from_mapping(_HELD_200)], AMOUNT))
def _(spark, d):
    return rounded_trades(trades_of(spark, d, [made("HELD_200")], within=BlockLayout(block_rows=256, lookback=64, lookahead=200)))


@register("p09_trades_of_last_year", ot.trades_sql(shipped(), AMOUNT, days=365))
def _(spark, d):
    return rounded_trades(trades_of(spark, d, shipped(), period="12m"))


@register("t_hour_bar_trades", ot.trades_sql([Strategy.from_mapping(_TP_SL)], AMOUNT, base="hour"))
def _(spark, d):
    return rounded_trades(trades_of(spark, d, [made("LEVELS")], "hour"))


@register("j05_first_exits", ot.first_exit_sql(Strategy.from_mapping(_TP_SL)))
def _(spark, d):
    s = made("LEVELS")
    frame, layout = exact_frame(spark, d, [s], s.max_hold)
    found = trade_op.exit_candidates(trade_op.in_range(frame, layout), [s], AMOUNT, layout)
    out = found.select(
        "symbol",
        "entry_date",
        c("exit.date").alias("exit_date"),
        c("exit.reason").alias("exit_reason"),
        c("exit.price").alias("exit_price"),
    )
    return rounded(out, ["exit_price"], 2)


@register("p14_s09_trade_rows", ot.trade_rows_sql(shipped(), COMPLIANCE_SQL, AMOUNT))
def _(spark, d):
    return rounded_trades(trade_op.trade_rows(trades_of(spark, d, shipped()), compliance(spark, d)))


@register(
    "o05_page_from_directory",
    f"""{ot.trade_rows_sql(shipped(), COMPLIANCE_SQL, AMOUNT)}
        ORDER BY {", ".join(TRADE_ORDER)} LIMIT 50 OFFSET 150""",
)
def _(spark, d):
    rows = rounded_trades(trade_op.trade_rows(trades_of(spark, d, shipped()), compliance(spark, d)))
    path = new_path(spark, "pages")
    write_pages(rows, TRADE_ORDER, path, rows_per_range=100)
    return read_page(spark, path, TRADE_ORDER, 3, 50)


@register("s01_scan_from_buckets", ot.scan_hits_sql())
def _(spark, d):
    """The scan over bars stored in buckets by symbol: no exchange before the windows."""
    name = f"bars_{uuid.uuid4().hex}"
    store_bars(day_bars(spark, d), name, max(8, tasks_of(_ticks(spark, d, "day"))), new_path(spark, "bars"))
    strategies = _scan_strategies()
    frame = indicator_frame(stored_bars(spark, name), columns_of(strategies), SymbolLayout(), decimals=8, complete=True)
    return rounded(scan_op.scan(frame, strategies, SymbolLayout()), ["entry_price", "stop_loss", "take_profit"])


@register("s10_trade_display_page", ot.trade_page_sql(shipped(), COMPLIANCE_SQL, AMOUNT, 1, 50))
def _(spark, d):
    rows = trade_op.trade_rows(trades_of(spark, d, shipped()), compliance(spark, d))
    return trade_display(rounded_trades(page(rows, TRADE_ORDER, 1, 50)))


@register("u01_trades_of_mixed_strategies", ot.trades_sql([*shipped(), example("PARTIAL_TP_STRATEGY")], AMOUNT))
def _(spark, d):
    mixed = [*shipped(), example("PARTIAL_TP_STRATEGY")]
    return rounded_trades(trades_of(spark, d, mixed))


# --- summaries --------------------------------------------------------------------------------


def _summary(spark, d):
    strategies = shipped()
    rows = trades_of(spark, d, strategies, marks=True)
    return summ.symbol_summary(rows, AMOUNT, names=[s.name for s in strategies])


@register("t21_a01_to_a09_symbol_summary", ot.summary_sql(shipped(), AMOUNT))
def _(spark, d):
    out = _summary(spark, d).drop("exit_reason_count")
    doubles = [n for n, t in out.dtypes if t == "double"]
    return rounded(out, doubles, 2)


@register("a08_exit_reason_counts", ot.reason_sql(shipped(), AMOUNT, by_symbol=True))
def _(spark, d):
    return _summary(spark, d).select(
        "strategy", "symbol", F.explode("exit_reason_count").alias("exit_reason", "n")
    )


@register("a10_a12_overall_summary", ot.overall_sql(shipped(), AMOUNT))
def _(spark, d):
    out = summ.overall_summary(_summary(spark, d), AMOUNT)
    return rounded(out, ["avg_winrate", "avg_holding_days", "net_profit", "final_equity"], 2)


@register("a11_exit_reason_totals", ot.reason_sql(shipped(), AMOUNT, by_symbol=False))
def _(spark, d):
    return summ.exit_reason_totals(_summary(spark, d))


