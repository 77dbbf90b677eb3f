"""Strategy definitions, normalised on the driver: a handful of small texts."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from barquarry.operators.rules import FIXED_AMOUNT, ENTRY_PRICE, check_rule, columns_used

DEFAULT_MAX_HOLD = 3
DEFAULT_TARGET = "CLOSE + ATR14 * 3"
DEFAULT_STOP = "CLOSE - ATR14 * 2"


def as_list(x: Any) -> tuple[Any, ...]:
    """A scalar counts as a list of one; nothing as an empty list."""
    if x is None or x == "":
        return ()
    return tuple(x) if isinstance(x, (list, tuple)) else (x,)


def trailing_fraction(text: str | float | None) -> float | None:
    """'2%' is 0.02, a bare number is the fraction itself, nothing means no trailing stop."""
    if text is None or text == "":
        return None
    if isinstance(text, str) and text.strip().endswith("%"):
        return float(text.strip()[:-1]) / 100
    return float(text)


@dataclass(frozen=True)
class Strategy:
    name: str
    entry: tuple[str, ...] = ()
    tp: tuple[str, ...] = ()
    sl: tuple[str, ...] = ()
    max_hold: int = DEFAULT_MAX_HOLD
    avg_down: tuple[str, ...] = ()
    avg_up: tuple[str, ...] = ()
    partial_tp: tuple[str, ...] = ()
    partial_ratios: tuple[float, ...] = ()
    amount: str | None = None
    trailing: float | None = None
    description: str = ""
    #: Exits use the stop recorded at entry instead of the stop rules on each bar.
    fixed_stop: bool = False

    @classmethod
    def from_mapping(cls, config: Mapping[str, Any], default_name: str = "") -> Strategy:
        tp = as_list(config.get("tp"))
        partial = as_list(config.get("partial_tp"))
        ratios = tuple(float(r) for r in as_list(config.get("partial_tp_ratios")))
        if not partial and len(tp) > 1:
            partial, ratios = tp, ()
        if partial and not ratios:
            ratios = (1.0 / len(partial),) * len(partial)
        used = min(len(partial), len(ratios))
        hold = config.get("max_hold_days")
        made = cls(
            name=config.get("name") or default_name,
            description=config.get("description") or "",
            entry=as_list(config.get("entry")),
            tp=tp,
            sl=as_list(config.get("sl")),
            max_hold=DEFAULT_MAX_HOLD if hold is None else int(hold),
            avg_down=as_list(config.get("avg_down")),
            avg_up=as_list(config.get("avg_up")),
            partial_tp=partial[:used],
            partial_ratios=ratios[:used],
            amount=config.get("amount") or None,
            trailing=trailing_fraction(config.get("ts")),
            fixed_stop=config.get("stop") == "fixed",
        )
        made.check()
        return made

    def check(self) -> None:
        for rule in self.entry:
            check_rule(rule)
        for rule in (*self.tp, *self.sl, *self.avg_down, *self.avg_up, *self.partial_tp):
            check_rule(rule, [ENTRY_PRICE])
        if self.amount:
            check_rule(self.amount, [ENTRY_PRICE, FIXED_AMOUNT])
        if self.trailing is not None and not math.isfinite(self.trailing):
            raise ValueError(f"trailing stop of {self.name} is not a number")

        if self.fixed_stop and self.needs_fold:
            raise ValueError(f"{self.name}: a fixed stop goes with positions that do not change")

    @property
    def target(self) -> str:
        return self.tp[0] if self.tp else DEFAULT_TARGET

    @property
    def stop(self) -> str:
        return self.sl[0] if self.sl else DEFAULT_STOP

    @property
    def rules(self) -> tuple[str, ...]:
        amount = (self.amount,) if self.amount else ()
        return (
            *self.entry, self.target, self.stop, *self.sl, *self.partial_tp,
            *self.avg_down, *self.avg_up, *amount,
        )

    @property
    def columns(self) -> list[str]:
        """Indicator columns the strategy needs (averaging down moves the stop by ATR14)."""
        used = columns_used(self.rules)
        return used + ["ATR14"] if self.avg_down and "ATR14" not in used else used

    @property
    def needs_fold(self) -> bool:
        """The position changes while it is open."""
        return bool(self.avg_down or self.avg_up or self.partial_tp)


def columns_of(strategies: Sequence[Strategy]) -> list[str]:
    return list(dict.fromkeys(n for s in strategies for n in s.columns))
