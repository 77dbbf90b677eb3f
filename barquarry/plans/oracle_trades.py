"""DuckDB SQL for scans, trades and summaries. Trades step one bar at a time per symbol."""

from __future__ import annotations

import re
from collections.abc import Sequence

from barquarry.operators.rules import columns_used
from barquarry.operators.strategy import Strategy, columns_of
from barquarry.plans import oracle as o
from barquarry.plans.presets import shipped


def _columns(strategies: Sequence[Strategy]) -> list[str]:
    return list(dict.fromkeys(["OPEN", "HIGH", "LOW", "CLOSE", "PRICE", "VOLUME", "ATR14", *columns_of(strategies)]))


def _exact(strategies: Sequence[Strategy], base: str = "day", days: int | None = None) -> str:
    """CTE x: rounded indicators, and whether the bar is inside the backtest range."""
    names = _columns(strategies)
    inside = "true"
    if days is not None:
        inside = f"date >= max(date) OVER (PARTITION BY symbol) - INTERVAL {days} DAY"
    return (
        f"{o.chain(names, base)},\n"
        f"x AS MATERIALIZED (SELECT symbol, date, rn, {inside} AS inside, {o.exact(names)} FROM ind)"
    )


def _met(s: Strategy) -> str:
    return "coalesce(" + " AND ".join(f"({rule})" for rule in s.entry) + ", false)"


def _bound(rule: str, name: str) -> str:
    return rule.replace("ENTRY_PRICE", name)


def _fixed_size(price: str, amount: float) -> str:
    return f"floor({amount!r} / {price})"


def _size(s: Strategy, amount: float, otherwise: str, entry: str) -> str:
    if not s.amount:
        return otherwise
    money = _bound(s.amount, entry).replace("FIXED_AMOUNT", f"CAST({amount!r} AS DOUBLE)")
    return f"CASE WHEN isfinite({money}) THEN floor(({money}) / CLOSE) ELSE {otherwise} END"


def _steps(s: Strategy, index: int, amount: float, stamp: str) -> str:
    """The state of one strategy after every bar, with the exits made on that bar."""
    entry = f"STRUCT(ed {stamp}, cd {stamp}, ep DOUBLE, px DOUBLE, q DOUBLE, why VARCHAR, sl DOUBLE, tp DOUBLE)[]"
    taken = "".join(f", false AS t{k}" for k in range(len(s.partial_tp)))
    first = (
        f"SELECT symbol, CAST(-1 AS BIGINT) AS rn, false AS pos, CAST(NULL AS {stamp}) AS ed, "
        "CAST(0 AS DOUBLE) AS ENTRY_PRICE, CAST(0 AS DOUBLE) AS stop, CAST(0 AS DOUBLE) AS target, "
        "CAST(0 AS DOUBLE) AS qty, CAST(0 AS DOUBLE) AS qty0, CAST(0 AS DOUBLE) AS peak, "
        f"0 AS held, 0 AS dn, 0 AS up{taken}, CAST([] AS {entry}) AS made "
        "FROM (SELECT DISTINCT symbol FROM x)"
    )
    peak = "greatest(z.peak, x.HIGH)" if s.trailing is not None else "z.peak"
    q = (
        f"SELECT z.* EXCLUDE (rn, peak, held, made), x.* EXCLUDE (symbol), z.pos AS was, {peak} AS peak, "
        f"z.held + 1 AS held, CAST([] AS {entry}) AS made "
        f"FROM st{index} z JOIN x ON x.symbol = z.symbol AND x.rn = z.rn + 1"
    )

    def row(price: str, qty: str, why: str) -> str:
        return (
            f"list_append(made, {{'ed': ed, 'cd': date, 'ep': ENTRY_PRICE, 'px': {price}, 'q': {qty}, "
            f"'why': {why}, 'sl': stop, 'tp': target}})"
        )

    for k, (rule, ratio) in enumerate(zip(s.partial_tp, s.partial_ratios)):
        q = f"SELECT *, ({rule}) AS lv, was AND pos AND NOT t{k} AND HIGH >= ({rule}) AS f FROM ({q})"
        q = (
            f"SELECT * EXCLUDE (f, lv) REPLACE (f OR t{k} AS t{k}, "
            f"CASE WHEN f THEN qty - qty0 * {ratio!r} ELSE qty END AS qty, "
            f"CASE WHEN f THEN {row('lv', f'qty0 * {ratio!r}', repr(f'Partial TP {k + 1}'))} ELSE made END AS made, "
            f"pos AND NOT (f AND qty - qty0 * {ratio!r} <= 1e-9 * qty0) AS pos) FROM ({q})"
        )
    for rules, count, sign in ((s.avg_down, "dn", "<="), (s.avg_up, "up", ">=")):
        for rule in rules:
            more = _size(s, amount, "qty0", "ENTRY_PRICE")
            q = (
                f"SELECT *, was AND pos AND {count} < {len(rules)} AND CLOSE {sign} ({rule}) AS f, "
                f"{more} AS more FROM ({q})"
            )
            mean = "((ENTRY_PRICE * qty + CLOSE * more) / (qty + more))"
            stop = f", CASE WHEN f THEN {mean} - ATR14 * 1.5 ELSE stop END AS stop" if count == "dn" else ""
            q = (
                f"SELECT * EXCLUDE (f, more) REPLACE (CASE WHEN f THEN {mean} ELSE ENTRY_PRICE END AS ENTRY_PRICE, "
                f"CASE WHEN f THEN qty + more ELSE qty END AS qty, "
                f"CASE WHEN f THEN {count} + 1 ELSE {count} END AS {count}{stop}) FROM ({q})"
            )
    why, price = [], []
    if not s.partial_tp:
        if s.trailing is not None:
            level = f"peak * (1 - {s.trailing!r})"
            why.append(f"WHEN LOW <= {level} THEN 'Trailing Stop Hit'")
            price.append(f"WHEN LOW <= {level} THEN {level}")
        for k, rule in enumerate(["stop"] if s.fixed_stop else s.sl):
            why.append(f"WHEN LOW <= ({rule}) THEN 'SL Hit (Level {k + 1})'")
            price.append(f"WHEN LOW <= ({rule}) THEN ({rule})")
        why.append(f"WHEN HIGH >= target THEN 'TP Hit' WHEN held >= {s.max_hold} THEN 'MaxHold Exit'")
        price.append(f"WHEN HIGH >= target THEN target WHEN held >= {s.max_hold} THEN CLOSE")
        q = (
            f"SELECT *, CASE WHEN was AND pos THEN CASE {' '.join(why)} END END AS why, "
            f"CASE {' '.join(price)} END AS px FROM ({q})"
        )
        q = (
            f"SELECT * EXCLUDE (why, px) REPLACE (CASE WHEN why IS NOT NULL THEN {row('px', 'qty', 'why')} "
            f"ELSE made END AS made, pos AND why IS NULL AS pos) FROM ({q})"
        )
    size = _size(s, amount, _fixed_size("CLOSE", amount), "CLOSE")
    q = f"SELECT *, NOT was AND inside AND {_met(s)} AND ({size}) > 0 AS enters, {size} AS sz FROM ({q})"
    flags = "".join(f", NOT enters AND t{k}" for k in range(len(s.partial_tp)))
    step = (
        "SELECT symbol, rn, enters OR pos, CASE WHEN enters THEN date ELSE ed END, "
        "CASE WHEN enters THEN CLOSE ELSE ENTRY_PRICE END, "
        f"CASE WHEN enters THEN {_bound(s.stop, 'CLOSE')} ELSE stop END, "
        f"CASE WHEN enters THEN {_bound(s.target, 'CLOSE')} ELSE target END, "
        "CASE WHEN enters THEN sz ELSE qty END, CASE WHEN enters THEN sz ELSE qty0 END, "
        "CASE WHEN enters THEN CLOSE ELSE peak END, CASE WHEN enters THEN 0 ELSE held END, "
        f"CASE WHEN enters THEN 0 ELSE dn END, CASE WHEN enters THEN 0 ELSE up END{flags}, made "
        f"FROM ({q})"
    )
    return f"st{index} AS (\n{first}\nUNION ALL\n{step})"


def _trades(strategies: Sequence[Strategy], amount: float, base: str = "day", days: int | None = None) -> str:
    stamp = "TIMESTAMP" if base in ("hour", "line") else "DATE"
    ctes = [_exact(strategies, base, days)]
    ctes += [_steps(s, i, amount, stamp) for i, s in enumerate(strategies)]
    parts = [
        f"SELECT '{s.name}' AS strategy, symbol, unnest(made) AS t FROM st{i} WHERE len(made) > 0"
        for i, s in enumerate(strategies)
    ]
    ctes.append(
        "trades AS MATERIALIZED (SELECT strategy, symbol, t.ed AS entry_date, t.cd AS close_date, t.ep AS entry_price, "
        "t.px AS exit_price, (t.px - t.ep) * t.q AS pnl, (t.px / t.ep - 1) * 100 AS roi_pct, "
        "CAST(floor((epoch(t.cd) - epoch(t.ed)) / 86400) AS INTEGER) AS hold_period, t.why AS exit_reason, "
        f"t.sl AS stop_loss, t.tp AS take_profit FROM ({' UNION ALL '.join(parts)}))"
    )
    return ",\n".join(ctes)


_ROUNDED = ", ".join(
    f"round({n} + 1.37e-5, 2) AS {n}" for n in ("entry_price", "exit_price", "pnl", "roi_pct", "stop_loss", "take_profit")
)


def trades_sql(strategies: Sequence[Strategy], amount: float, base: str = "day", days: int | None = None) -> str:
    return (
        f"{_trades(strategies, amount, base, days)}\nSELECT strategy, symbol, entry_date, close_date, "
        f"hold_period, exit_reason, {_ROUNDED} FROM trades"
    )


def _marked(compliance: str) -> str:
    return f"symbol || CASE WHEN symbol IN ({compliance}) THEN '' ELSE '*' END AS ticker"


def trade_rows_sql(strategies: Sequence[Strategy], compliance: str, amount: float) -> str:
    return (
        f"{_trades(strategies, amount)}\nSELECT strategy, {_marked(compliance)}, "
        "strftime(entry_date, '%Y-%m-%d') AS entry_date, strftime(close_date, '%Y-%m-%d') AS close_date, "
        f"hold_period, exit_reason, {_ROUNDED} FROM trades"
    )


def _hits() -> str:
    strategies = [
        *shipped(),
        Strategy(name="LOOSE", entry=("CLOSE > MA5", "VOLUME > 0"), tp=("CLOSE + ATR14 * 2",), sl=("ENTRY_PRICE * 0.97",)),
        Strategy(name="DEFAULTS", entry=("CLOSE < MA20",)),
    ]
    parts = [
        f"SELECT '{s.name}' AS strategy, symbol, date AS entry_date, CLOSE AS entry_price, "
        f"{_bound(s.stop, 'CLOSE')} AS stop_loss, {_bound(s.target, 'CLOSE')} AS take_profit "
        f"FROM lastbar WHERE {_met(s)}"
        for s in strategies
    ]
    return (
        f"{_exact(strategies)},\nlastbar AS (SELECT * FROM x QUALIFY row_number() OVER "
        f"(PARTITION BY symbol ORDER BY date DESC) = 1),\nhits AS ({' UNION ALL '.join(parts)})"
    )


def scan_hits_sql() -> str:
    return (
        f"{_hits()}\nSELECT strategy, symbol, entry_date, round(entry_price + 1.37e-7, 4) AS entry_price, "
        "round(stop_loss + 1.37e-7, 4) AS stop_loss, round(take_profit + 1.37e-7, 4) AS take_profit FROM hits"
    )


def scan_rows_sql(compliance: str, amount: float) -> str:
    up, down = "(take_profit / entry_price - 1) * 100", "(stop_loss / entry_price - 1) * 100"
    return (
        f"{_hits()}\nSELECT strategy, {_marked(compliance)}, round(entry_price + 1.37e-5, 2) AS price, "
        "round(entry_price + 1.37e-5, 2) AS entry_price, round(stop_loss + 1.37e-5, 2) AS stop_loss, round(take_profit + 1.37e-5, 2) AS take_profit, "
        f"round({up} + 1.37e-5, 2) AS est_profit_pct, round({amount!r} * ({up}) / 100 + 1.37e-5, 2) AS est_profit_rp, "
        f"round({down} + 1.37e-5, 2) AS est_loss_pct, round({amount!r} * ({down}) / 100 + 1.37e-5, 2) AS est_loss_rp, "
        "CAST(NULL AS DOUBLE) AS pnl, strftime(entry_date, '%Y-%m-%d') AS entry_date, "
        "CAST(NULL AS VARCHAR) AS close_date, CAST(NULL AS INTEGER) AS hold_period FROM hits"
    )


def _fixed2(n: str) -> str:
    return f"printf('%.2f', round({n} + 1.37e-5, 2))"


def _grouped(n: str) -> str:
    """Thousands parted by '.', decimals after ',' without trailing zeros."""
    value = f"round({n} + 1.37e-5, 2)"
    text = f"translate(format('{{:,.2f}}', {value}), ',.', '.,')"
    return f"regexp_replace({text}, ',?0+$', '')"


def scan_page_sql(compliance: str, amount: float, number: int, size: int) -> str:
    up, down = "(take_profit / entry_price - 1) * 100", "(stop_loss / entry_price - 1) * 100"
    return (
        f"{_hits()}, rows AS (SELECT *, {_marked(compliance)} FROM hits)\n"
        f'SELECT ticker AS "Ticker", {_fixed2("entry_price")} AS "Price", {_fixed2("entry_price")} AS "Entry", '
        f'{_fixed2("stop_loss")} AS "SL", {_fixed2("take_profit")} AS "TP", '
        f"""{_fixed2(up)} || ' %' AS "TP_pct", {_grouped(f"{amount!r} * ({up}) / 100")} AS "TP_Rp", """
        f"""{_fixed2(down)} || ' %' AS "SL_pct", {_grouped(f"{amount!r} * ({down}) / 100")} AS "SL_Rp", '' AS "PnL", """
        f"""strftime(entry_date, '%Y-%m-%d') AS "Start", '' AS "End", '' AS "Hold" """
        f"FROM rows ORDER BY ticker, strategy LIMIT {size} OFFSET {number * size}"
    )


def trade_page_sql(strategies: Sequence[Strategy], compliance: str, amount: float, number: int, size: int) -> str:
    return (
        f"{_trades(strategies, amount)}, rows AS (SELECT *, {_marked(compliance)} FROM trades)\n"
        f'SELECT ticker AS "Ticker", {_fixed2("exit_price")} AS "Price", {_fixed2("entry_price")} AS "Entry", '
        f'{_fixed2("stop_loss")} AS "SL", {_fixed2("take_profit")} AS "TP", '
        f"""'' AS "TP_pct", '' AS "TP_Rp", '' AS "SL_pct", '' AS "SL_Rp", {_grouped("pnl")} AS "PnL", """
        f"""strftime(entry_date, '%Y-%m-%d') AS "Start", strftime(close_date, '%Y-%m-%d') AS "End", """
        f"""hold_period || 'd' AS "Hold" FROM rows """
        f"ORDER BY entry_date, ticker, strategy, close_date, exit_reason, exit_price LIMIT {size} OFFSET {number * size}"
    )


def first_exit_sql(s: Strategy) -> str:
    """The bars a signal may be held for as lead columns, and the first of them with an exit."""
    used = columns_used(s.sl)
    names = dict.fromkeys(["LOW", "HIGH", "CLOSE", *used])
    ahead = range(1, s.max_hold + 1)
    leads = ", ".join(f"lead({n}, {k}) {o.over()} AS {n}_{k}" for k in ahead for n in ["date", *names])

    def on(rule: str, k: int) -> str:
        """Stop rules name columns of the bar under test; the entry price is the signal bar's close."""
        for n in used:
            rule = re.sub(rf"\b{n}\b", f"{n}_{k}", rule)
        return rule.replace("ENTRY_PRICE", "CLOSE")

    def checks(k: int) -> list[tuple[str, str, str]]:
        found = [(f"LOW_{k} <= ({on(rule, k)})", f"'SL Hit (Level {n + 1})'", f"({on(rule, k)})") for n, rule in enumerate(s.sl)]
        found.append((f"HIGH_{k} >= target", "'TP Hit'", "target"))
        return [*found, (f"date_{k} IS NOT NULL", "'MaxHold Exit'", f"CLOSE_{k}")] if k == s.max_hold else found

    def chosen(part: int) -> str:
        return "CASE " + " ".join(f"WHEN {check[0]} THEN {(check[1], check[2], f'date_{k}')[part]}" for k in ahead for check in checks(k)) + " END"

    return f"""{_exact([s])},
e AS (SELECT *, {_bound(s.target, "CLOSE")} AS target, {leads} FROM x)
SELECT symbol, date AS entry_date, {chosen(2)} AS exit_date, {chosen(0)} AS exit_reason, round({chosen(1)} + 1.37e-5, 2) AS exit_price
FROM e WHERE {_met(s)} AND floor(1000000 / CLOSE) > 0"""


def _summary(strategies: Sequence[Strategy], amount: float) -> str:
    names = ", ".join(f"('{s.name}')" for s in strategies)
    return f"""{_trades(strategies, amount)},
keys AS (SELECT s.strategy, l.symbol FROM (VALUES {names}) s(strategy),
         (SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS symbol FROM lineitem) l),
summary AS MATERIALIZED (
  SELECT k.strategy, k.symbol, count(t.pnl) AS total_trades,
    count(*) FILTER (t.pnl > 0) AS wins, count(*) FILTER (t.pnl <= 0) AS losses,
    coalesce(100.0 * count(*) FILTER (t.pnl > 0) / nullif(count(t.pnl), 0), 0) AS winrate,
    coalesce(avg(t.hold_period), 0) AS avg_holding_days,
    coalesce(sum(t.pnl), 0) AS net_profit, {amount!r} + coalesce(sum(t.pnl), 0) AS final_equity,
    coalesce(avg(t.roi_pct) FILTER (t.pnl > 0), 0) AS avg_win_pct,
    coalesce(avg(t.roi_pct) FILTER (t.pnl <= 0), 0) AS avg_loss_pct,
    coalesce(max(t.roi_pct), 0) AS best_roi_pct
  FROM keys k LEFT JOIN trades t ON t.strategy = k.strategy AND t.symbol = k.symbol
  GROUP BY 1, 2)"""


def summary_sql(strategies: Sequence[Strategy], amount: float) -> str:
    return f"""{_summary(strategies, amount)}
SELECT strategy, symbol, total_trades, wins, losses, round(winrate + 1.37e-5, 2) AS winrate,
  round(avg_holding_days + 1.37e-5, 2) AS avg_holding_days, round(net_profit + 1.37e-5, 2) AS net_profit,
  round(final_equity + 1.37e-5, 2) AS final_equity, round(avg_win_pct + 1.37e-5, 2) AS avg_win_pct,
  round(avg_loss_pct + 1.37e-5, 2) AS avg_loss_pct, round(best_roi_pct + 1.37e-5, 2) AS best_roi_pct,
  CASE WHEN avg_loss_pct < 0 THEN round(abs(avg_win_pct / avg_loss_pct) + 1.37e-5, 2) END AS risk_reward
FROM summary"""


def overall_sql(strategies: Sequence[Strategy], amount: float) -> str:
    return f"""{_summary(strategies, amount)}
SELECT strategy, CAST(sum(total_trades) AS BIGINT) AS total_trades, round(avg(winrate) + 1.37e-5, 2) AS avg_winrate,
  round(avg(avg_holding_days) + 1.37e-5, 2) AS avg_holding_days, round(sum(net_profit) + 1.37e-5, 2) AS net_profit,
  round({amount!r} + sum(net_profit) + 1.37e-5, 2) AS final_equity FROM summary GROUP BY strategy"""


def reason_sql(strategies: Sequence[Strategy], amount: float, *, by_symbol: bool) -> str:
    keys = "strategy, symbol" if by_symbol else "strategy"
    return (
        f"{_trades(strategies, amount)}\nSELECT {keys}, exit_reason, CAST(count(*) AS BIGINT) AS n "
        f"FROM trades GROUP BY {keys}, exit_reason"
    )
