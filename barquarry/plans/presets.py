"""Ready-made strategies."""

from __future__ import annotations

from barquarry.operators.strategy import Strategy

# Rules, targets, stops and holding times of the three shipped strategies.
SHIPPED = [
    {
        "name": "BEFORE_BREAKOUT",
        "entry": [
            "CLOSE > OPEN",
            "CLOSE > MA20",
            "MA20 > MA50",
            "MA50 > MA200",
            "RSI14 >= 50",
            "RSI14 <= 70",
            "VOLUME >= VMA20 * 0.8",
            "VOLUME <= VMA20 * 1.5",
            "CLOSE <= VWAP * 1.05",
        ],
        "tp": ["CLOSE + (ATR14 * 2)"],
        "sl": ["CLOSE - (ATR14 * 1.5)"],
        "max_hold_days": 5,
    },
    {
        "name": "TRENDING",
        "entry": [
            "CLOSE >= MA20",
            "MA20 >= MA200",
            "RSI14 >= 30",
            "RSI14 <= 80",
            "VOLUME <= VMA20 * 2",
            "CLOSE <= VWMA * 2",
            "VOLUME_SPIKE > 1",
            "STOCH_K >= STOCH_D",
            "ADX14 >= 30",
        ],
        "tp": ["CLOSE + (ATR14 * 2)"],
        "sl": ["CLOSE - (ATR14 * 1.5)"],
        "max_hold_days": 5,
    },
    {
        "name": "VOLUME_SPIKE_STRATEGY",
        "entry": [
            "VOLUME_SPIKE > 1",
            "VOLUME_SPIKE <= 2",
            "MACD_LINE <= MACD_SIGNAL",
            "PRICE > MA50",
            "PRICE > MA200",
        ],
        "tp": ["CLOSE * 1.05"],
        "sl": ["CLOSE * 0.95"],
        "max_hold_days": 3,
    },
]

# The documented examples of the optional features.
_OVERSOLD = ["RSI14 < 30", "VOLUME > VMA20"]
_WIDE_STOP = ["PRICE - (ATR14 * 2)"]
EXAMPLES = [
    {
        "name": "FULL_TP_STRATEGY",
        "entry": _OVERSOLD,
        "tp": ["PRICE + (ATR14 * 3)"],
        "sl": _WIDE_STOP,
        "max_hold_days": 10,
    },
    {
        "name": "PARTIAL_TP_STRATEGY",
        "entry": _OVERSOLD,
        "tp": ["ENTRY_PRICE * 1.01", "ENTRY_PRICE * 1.02", "ENTRY_PRICE * 1.03"],
        "sl": _WIDE_STOP,
        "max_hold_days": 10,
    },
    {
        "name": "MULTI_AVG_STRATEGY",
        "entry": _OVERSOLD,
        "tp": ["PRICE + (ATR14 * 3)"],
        "sl": _WIDE_STOP,
        "avg_down": ["ENTRY_PRICE * 0.98", "ENTRY_PRICE * 0.95", "ENTRY_PRICE * 0.92"],
        "avg_up": ["ENTRY_PRICE * 1.02", "ENTRY_PRICE * 1.04", "ENTRY_PRICE * 1.06"],
        "max_hold_days": 10,
    },
    {
        "name": "DYNAMIC_AMOUNT_STRATEGY",
        "entry": _OVERSOLD,
        "tp": ["PRICE + (ATR14 * 3)"],
        "sl": _WIDE_STOP,
        "amount": "FIXED_AMOUNT * (1 / (ATR14 / PRICE)) * (RSI14 / 50)",
        "ts": "2%",
        "max_hold_days": 10,
    },
]


def shipped() -> list[Strategy]:
    return [Strategy.from_mapping(s) for s in SHIPPED]


def example(name: str) -> Strategy:
    return next(Strategy.from_mapping(s) for s in EXAMPLES if s["name"] == name)
