"""DuckDB SQL that defines the same results independently, for the side-by-side check.

Plain windows are written directly, exponential and Wilder averages as recursive CTEs (Spark
uses closed-form sums), and trades as a recursive CTE that steps one bar at a time (Spark
searches forward frames).

Compared values are rounded. Prices are quotients of short decimals and often end exactly half
way between two rounded values, where the last bit decides; both sides therefore add a shift
far below the rounding step first.
"""

from __future__ import annotations

from collections.abc import Sequence

DAY_BARS = """bars AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS symbol, CAST(l_shipdate AS DATE) AS date,
         first(p ORDER BY l_orderkey, l_linenumber, l_extendedprice, l_quantity) AS open,
         max(p) AS high, min(p) AS low,
         last(p ORDER BY l_orderkey, l_linenumber, l_extendedprice, l_quantity) AS close,
         CAST(sum(l_quantity) AS DOUBLE) AS volume
  FROM (SELECT *, l_extendedprice / l_quantity AS p FROM lineitem)
  GROUP BY 1, 2)"""

_EVENT_BARS = """bars AS (
  SELECT {symbol} AS symbol, {bucket} AS date,
         first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
         last(value ORDER BY ts, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM events GROUP BY 1, 2)"""
# Hour bars of return flags; a line's number is its hour.
LINE_BARS = DAY_BARS.replace("CAST(l_suppkey AS VARCHAR)", "l_returnflag").replace("CAST(l_shipdate AS DATE) AS date", "CAST(l_shipdate AS TIMESTAMP) + to_hours(CAST(l_linenumber AS INTEGER)) AS date")
HOUR_BARS = _EVENT_BARS.format(symbol="event_type", bucket="date_trunc('hour', ts)")
USER_BARS = _EVENT_BARS.format(symbol="CAST(user_id AS VARCHAR)", bucket="CAST(ts AS DATE)")
# Bars of every third symbol lack a close where much was traded; such bars are rejected.
GAP = "(volume >= 75 AND CAST(symbol AS INTEGER) % 3 = 0)"
KEPT_BARS = f"{DAY_BARS.replace('bars AS', 'all_bars AS', 1)}, bars AS (SELECT * FROM all_bars WHERE NOT {GAP})"
BASES = {"day": DAY_BARS, "hour": HOUR_BARS, "user": USER_BARS, "kept": KEPT_BARS, "line": LINE_BARS}


def over(n: int | None = None) -> str:
    frame = "" if n is None else f" ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW"
    return f"OVER (PARTITION BY symbol ORDER BY date{frame})"


SO_FAR = "OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def full(agg: str, column: str, n: int) -> str:
    return f"CASE WHEN rn >= {n - 1} THEN {agg}({column}) {over(n)} END"


def lag(column: str, n: int = 1) -> str:
    return f"lag({column}, {n}) {over()}"


def flag(condition: str) -> str:
    return f"CASE WHEN coalesce({condition}, false) THEN 1 ELSE 0 END"


_BODY10 = f"avg(body) {over(10)}"
_BODY10_BEFORE = "body10_before"

# Unfilled indicator columns over the CTE "l3" (see chain).
PLAIN = {
    "OPEN": "open",
    "HIGH": "high",
    "LOW": "low",
    "CLOSE": "close",
    "PRICE": "close",
    "VOLUME": "volume",
    "PREVIOUS_PRICE": "pc",
    **{
        f"PRICE_RETURN_{p}D_PCT": f"(close / nullif({lag('close', p)}, 0) - 1) * 100"
        for p in (1, 7, 30, 50, 100)
    },
    "PERCENT_SPIKE": f"CASE WHEN rn >= 29 THEN sum(up1) {over(30)} END",
    "VOLUME_SPIKE": f"volume / nullif({full('avg', 'volume', 30)}, 0)",
    "RVOL": f"volume / nullif({full('avg', 'volume', 10)}, 0)",
    "ATR14": full("avg", "tr", 14),
    "BB_MIDDLE": full("avg", "close", 20),
    "BB_UPPER": f"{full('avg', 'close', 20)} + 2 * {full('stddev_samp', 'close', 20)}",
    "BB_LOWER": f"{full('avg', 'close', 20)} - 2 * {full('stddev_samp', 'close', 20)}",
    "BB_WIDTH": f"4 * {full('stddev_samp', 'close', 20)}",
    "BB_PERCENT_B": (
        f"(close - ({full('avg', 'close', 20)} - 2 * {full('stddev_samp', 'close', 20)}))"
        f" / nullif(4 * {full('stddev_samp', 'close', 20)}, 0)"
    ),
    "RSI14": (
        f"CASE WHEN rn >= 14 THEN 100 - 100 / (1 + avg(gain) {over(14)}"
        f" / nullif(avg(loss) {over(14)}, 0)) END"
    ),
    "STOCH_K": "stoch",
    "STOCH_D": f"CASE WHEN rn >= 15 AND count(stoch) {over(3)} = 3 THEN avg(stoch) {over(3)} END",
    **{
        f"FIB_{k}": (
            f"{full('max', 'high', 50)} - ({full('max', 'high', 50)} - {full('min', 'low', 50)}) * {v}"
        )
        for k, v in (("236", 0.236), ("382", 0.382), ("50", 0.5), ("618", 0.618))
    },
    "SUPPORT": f"{full('avg', 'close', 20)} - 1.5 * {full('avg', 'tr', 14)}",
    "RESISTANCE": f"{full('avg', 'close', 20)} + 1.5 * {full('avg', 'tr', 14)}",
    "VWMA": (
        f"CASE WHEN rn >= 19 THEN sum((high + low + close) / 3 * volume) {over(20)}"
        f" / nullif(sum(volume) {over(20)}, 0) END"
    ),
    "VWAP": (
        f"CASE WHEN rn >= 19 THEN sum((high + low + close) / 3 * volume) {over(20)}"
        f" / nullif(sum(volume) {over(20)}, 0) END"
    ),
    "THREE_RED_CANDLES": flag(
        f"close < open AND {lag('close')} < {lag('open')} AND {lag('close', 2)} < {lag('open', 2)}"
    ),
    "THREE_GREEN_CANDLES": flag(
        f"close > open AND {lag('close')} > {lag('open')} AND {lag('close', 2)} > {lag('open', 2)}"
    ),
    "DOJI": flag("body < 0.1 * body10"),
    "HAMMER": flag("lower >= 2 * body AND upper <= 0.5 * body AND body < 0.2 * (high - low)"),
    "HANGING_MAN": flag("lower >= 2 * body AND upper <= 0.5 * body AND body < 0.2 * (high - low)"),
    "SHOOTING_STAR": flag("upper >= 2 * body AND lower <= 0.5 * body AND body < 0.2 * (high - low)"),
    "MORNING_STAR": flag(
        f"{lag('close', 2)} < {lag('open', 2)} AND {lag('body')} < 0.3 * {lag('body10')} AND close > open"
    ),
    "EVENING_STAR": flag(
        f"{lag('close', 2)} > {lag('open', 2)} AND {lag('body')} < 0.3 * {lag('body10')} AND close < open"
    ),
    "TRADE_FREQUENCY": f"100 * volume / nullif({full('avg', 'volume', 20)}, 0)",
    "HIGH_VOL_DAYS": f"CASE WHEN rn >= 29 THEN sum(busy) {over(30)} END",
}
MACD = {"MACD_LINE": "line", "MACD_SIGNAL": "signal", "MACD_HISTOGRAM": "line - signal"}
ADX = {"ADX_PLUS": "pdi", "ADX_MINUS": "mdi", "ADX14": "adx"}
FLAGS = {
    "THREE_RED_CANDLES", "THREE_GREEN_CANDLES", "DOJI", "HAMMER", "HANGING_MAN",
    "SHOOTING_STAR", "MORNING_STAR", "EVENING_STAR",
}

_NUMBERED = (("VMA", "avg", "volume"), ("MA", "avg", "close"), ("HH", "max", "high"), ("LL", "min", "low"))


def plain(name: str) -> str:
    if name in PLAIN:
        return PLAIN[name]
    for prefix, agg, column in _NUMBERED:
        if name.startswith(prefix) and name[len(prefix) :].isdigit():
            return full(agg, column, int(name[len(prefix) :]))
    raise KeyError(name)


def _ema_steps(spans: Sequence[int]) -> str:
    """CTE ``exp``: exponential averages of closes, one bar after the other."""
    first = ", ".join(f"close AS e{n}" for n in spans)
    step = ", ".join(f"e.e{n} + (b.close - e.e{n}) * 2 / {n + 1} AS e{n}" for n in spans)
    return f"""exp AS (
  SELECT symbol, rn, {first} FROM b WHERE rn = 0
  UNION ALL
  SELECT b.symbol, b.rn, {step} FROM exp e JOIN b ON b.symbol = e.symbol AND b.rn = e.rn + 1)"""


_STEPS = f"""b AS MATERIALIZED (
  SELECT *, row_number() {over()} - 1 AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM bars),
l1 AS (
  SELECT *, {lag('close')} AS pc, {lag('high')} AS ph, {lag('low')} AS pl,
         abs(close - open) AS body, high - greatest(close, open) AS upper,
         least(close, open) - low AS lower FROM b),
l2 AS (
  SELECT *,
    CASE WHEN pc IS NULL THEN high - low
         ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr,
    CASE WHEN pc IS NOT NULL THEN greatest(close - pc, 0) END AS gain,
    CASE WHEN pc IS NOT NULL THEN greatest(pc - close, 0) END AS loss,
    CASE WHEN (close / nullif(pc, 0) - 1) * 100 >= 1 THEN 1 ELSE 0 END AS up1,
    CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0 END AS pdm,
    CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0 END AS mdm,
    CASE WHEN rn >= 19 AND volume > 1.5 * avg(volume) {over(20)} THEN 1 ELSE 0 END AS busy,
    CASE WHEN rn >= 9 THEN avg(body) {over(10)} END AS body10,
    CASE WHEN rn >= 13 THEN 100 * (close - min(low) {over(14)})
      / nullif(max(high) {over(14)} - min(low) {over(14)}, 0) END AS stoch
  FROM l1)"""

_MACD_STEPS = """ema AS (
  SELECT symbol, rn, close AS e12, close AS e26, CAST(0 AS DOUBLE) AS line, CAST(0 AS DOUBLE) AS signal
  FROM b WHERE rn = 0
  UNION ALL
  SELECT symbol, rn, e12, e26, e12 - e26, signal * 0.8 + (e12 - e26) * 0.2 FROM (
    SELECT b.symbol, b.rn, e.e12 + (b.close - e.e12) * 2 / 13 AS e12,
           e.e26 + (b.close - e.e26) * 2 / 27 AS e26, e.signal
    FROM ema e JOIN b ON b.symbol = e.symbol AND b.rn = e.rn + 1))"""

_ADX_STEPS = f"""wseed AS MATERIALIZED (
  SELECT symbol, rn, n, tr, pdm, mdm, sum(tr) {SO_FAR} AS s0, sum(pdm) {SO_FAR} AS p0,
         sum(mdm) {SO_FAR} AS m0 FROM l2),
wilder AS (
  SELECT symbol, rn, n, s0 AS s, p0 AS p, m0 AS m FROM wseed WHERE rn = 13 AND n >= 28
  UNION ALL
  SELECT d.symbol, d.rn, d.n, w.s - w.s / 14 + d.tr, w.p - w.p / 14 + d.pdm, w.m - w.m / 14 + d.mdm
  FROM wilder w JOIN wseed d ON d.symbol = w.symbol AND d.rn = w.rn + 1),
di AS MATERIALIZED (
  SELECT symbol, rn, p / nullif(s, 0) * 100 AS pdi, m / nullif(s, 0) * 100 AS mdi,
         abs(p / nullif(s, 0) - m / nullif(s, 0))
           / nullif(abs(p / nullif(s, 0)) + abs(m / nullif(s, 0)), 0) * 100 AS dx
  FROM wilder),
adx AS (
  SELECT symbol, CAST(27 AS BIGINT) AS rn, avg(dx) AS adx FROM di WHERE rn BETWEEN 14 AND 27
  GROUP BY symbol
  UNION ALL
  SELECT d.symbol, d.rn, (a.adx * 13 + d.dx) / 14
  FROM adx a JOIN di d ON d.symbol = a.symbol AND d.rn = a.rn + 1)"""


def chain(columns: Sequence[str], base: str = "day", *, fill: bool = True) -> str:
    """CTEs ending in ``ind``: symbol, date, rn and the asked indicator columns."""
    macd = [n for n in columns if n in MACD]
    adx = [n for n in columns if n in ADX]
    ctes = [BASES[base], _STEPS]
    joins = ""
    if macd:
        ctes.append(_MACD_STEPS)
        joins += " LEFT JOIN ema USING (symbol, rn)"
    if adx:
        ctes.append(_ADX_STEPS)
        joins += " LEFT JOIN di USING (symbol, rn) LEFT JOIN adx USING (symbol, rn)"
    spans = {n: int(n[3:]) for n in columns if n.startswith("EMA")}
    if spans:
        ctes.append(_ema_steps(list(spans.values())))
        joins += " LEFT JOIN exp USING (symbol, rn)"
    exprs = []
    for n in columns:
        text = MACD.get(n) or ADX.get(n) or (f"e{spans[n]}" if n in spans else plain(n))
        exprs.append(f'{text} AS "{n}"')
    ctes.append(
        f"raw AS (SELECT symbol, date, rn, {', '.join(exprs)} FROM l2{joins})"
    )
    filled = []
    for n in columns:
        if n in FLAGS or not fill:
            filled.append(f'"{n}"')
        else:
            filled.append(f'coalesce(last_value("{n}" IGNORE NULLS) {SO_FAR}, 0) AS "{n}"')
    ctes.append(f"ind AS MATERIALIZED (SELECT symbol, date, rn, {', '.join(filled)} FROM raw)")
    return "WITH RECURSIVE " + ",\n".join(ctes)


def rounded(columns: Sequence[str], digits: int = 4) -> str:
    parts = []
    for n in columns:
        value = f'round("{n}" + 1.37e-{digits + 3}, {digits})'
        parts.append(f'CAST("{n}" AS INTEGER) AS "{n}"' if n in FLAGS else f'{value} AS "{n}"')
    return ", ".join(parts)


def indicator_query(columns: Sequence[str], base: str = "day", digits: int = 4) -> str:
    return f"{chain(columns, base)}\nSELECT symbol, date, {rounded(columns, digits)} FROM ind"


def exact(columns: Sequence[str]) -> str:
    """Indicator columns rounded to 8 decimals, as the checked Spark rules see them."""
    return ", ".join(f'"{n}"' if n in FLAGS else f'round("{n}", 8) AS "{n}"' for n in columns)
