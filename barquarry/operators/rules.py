"""Strategy rules: Spark SQL expression text over indicator columns.

Rules are handed to ``F.expr`` after a check that they only name known columns and scalar
functions. Division by zero inside a rule gives null (the rule is then not met) whatever the
session's ANSI setting: what is divided by is put into NULLIF(..., 0).
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterable
from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from barquarry.operators.fundamentals import FUNDAMENTAL_COLUMNS
from barquarry.operators.indicators import is_technical

ENTRY_PRICE = "ENTRY_PRICE"
FIXED_AMOUNT = "FIXED_AMOUNT"

# Words a rule may use besides column names.
_WORDS = (
    "AND OR NOT TRUE FALSE NULL IS IN BETWEEN CASE WHEN THEN ELSE END IF "
    "ABS GREATEST LEAST POWER POW SQRT LN LOG LOG10 EXP FLOOR CEIL ROUND SIGN "
    "COALESCE NULLIF TRY_DIVIDE"
).split()
_TEXT = re.compile(r"[\w\s.+\-*/%()<>=!,]+")
_NAME = re.compile(r"(?<![\w.])[A-Za-z_]\w*")


def columns_used(rules: Iterable[str]) -> list[str]:
    """Indicator columns named in rules, each once, in order of appearance."""
    found: dict[str, None] = {}
    for rule in rules:
        for word in _NAME.findall(rule):
            name = word.upper()
            if is_technical(name) or name in FUNDAMENTAL_COLUMNS:
                found[name] = None
    return list(found)


def check_rule(rule: str, extra: Iterable[str] = ()) -> str:
    """The rule itself, or ValueError naming what is not allowed in it."""
    if not _TEXT.fullmatch(rule):
        raise ValueError(f"unsupported character in rule: {rule!r}")
    allowed = {*_WORDS, *extra}
    for word in _NAME.findall(rule):
        name = word.upper()
        if not (name in allowed or is_technical(name) or name in FUNDAMENTAL_COLUMNS):
            raise ValueError(f"unknown name {word!r} in rule: {rule!r}")
    return rule


_WORD = re.compile(r"[\w.]+")
_CASE = re.compile(r"\b(?:CASE|END)\b", re.IGNORECASE)


def _operand_end(rule: str, at: int) -> int:
    """Where the operand that starts at ``at`` ends: signs, then a group, a call, a CASE or a word."""
    while at < len(rule) and rule[at] in " \t\n+-":
        at += 1
    word = _WORD.match(rule, at)
    if word and word.group().upper() == "CASE":
        depth = 0
        for found in _CASE.finditer(rule, at):
            depth += 1 if found.group().upper() == "CASE" else -1
            if depth == 0:
                return found.end()
        return len(rule)
    at = word.end() if word else at
    opening = re.compile(r"\s*\(").match(rule, at)
    if opening is None:
        return at
    depth, at = 1, opening.end()
    while at < len(rule) and depth:
        depth += {"(": 1, ")": -1}.get(rule[at], 0)
        at += 1
    return at


def guarded(rule: str) -> str:
    """The rule with every divisor in NULLIF(..., 0)."""
    found = re.search("[/%]", rule)
    if found is None:
        return rule
    end = _operand_end(rule, found.end())
    divisor = guarded(rule[found.end() : end])
    return f"{rule[: found.end()]} NULLIF({divisor.strip()}, 0){guarded(rule[end:])}"


def bind(rule: str, values: dict[str, str]) -> str:
    """Replace whole-word names by SQL text."""
    for name, text in values.items():
        rule = re.sub(rf"\b{name}\b", f"({text})", rule, flags=re.IGNORECASE)
    return rule


def value(rule: str, *, entry_price: str = "CLOSE", amount: float | None = None) -> Column:
    """A value expression (target, stop, size) on one bar, as a double."""
    extra = [ENTRY_PRICE] + ([FIXED_AMOUNT] if amount is not None else [])
    check_rule(rule, extra)
    values = {ENTRY_PRICE: entry_price}
    if amount is not None:
        values[FIXED_AMOUNT] = f"{float(amount)!r}D"
    return F.expr(bind(guarded(rule), values)).cast("double")


def per_bar(rules: dict[str, str], bars: str, entry: str = "CLOSE") -> Column:
    """Array of structs: each ``bar`` of the array column ``bars`` and the rules' values on it.

    Column names in a rule are fields of the bar under test; ENTRY_PRICE is the SQL text ``entry``.
    """

    def field(match: re.Match) -> str:
        name = match.group().upper()
        if name == ENTRY_PRICE:
            return f"({entry})"
        return f"bar.`{name}`" if is_technical(name) or name in FUNDAMENTAL_COLUMNS else match.group()

    texts = {n: _NAME.sub(field, guarded(check_rule(rule, [ENTRY_PRICE]))) for n, rule in rules.items()}
    fields = "".join(f", '{n}', CAST(({text}) AS DOUBLE)" for n, text in texts.items())
    return F.expr(f"transform({bars}, bar -> named_struct('bar', bar{fields}))")


def _divided(a, b):
    b = np.asarray(b, dtype=float)
    return np.divide(a, b, out=np.full(np.broadcast(a, b).shape, np.nan), where=b != 0)


# How plain arithmetic is done on arrays. Not a number stands for null.
_OPERATORS = {ast.Add: np.add, ast.Sub: np.subtract, ast.Mult: np.multiply, ast.Div: _divided}
_FUNCTIONS = {"ABS": np.abs, "GREATEST": np.fmax, "LEAST": np.fmin}


def arithmetic(rule: str) -> tuple[Callable[[dict[str, np.ndarray]], np.ndarray], set[str]] | None:
    """A plain arithmetic rule as a function of arrays by column name, and the names; None for other rules.

    Plain are + - * / and ABS, GREATEST and LEAST on columns, numbers and the entry price. Arithmetic between numbers
    alone is left to Spark, which does it in decimals.
    """
    check_rule(rule, [ENTRY_PRICE])
    try:
        tree = ast.parse(rule.strip(), mode="eval").body
    except SyntaxError:
        return None
    names: set[str] = set()

    def made(node: ast.AST) -> tuple[Callable, bool] | None:
        """The node as a function, and whether it is a number."""
        if isinstance(node, ast.Constant) and type(node.value) in (int, float):
            return (lambda _, x=float(node.value): x), True
        if isinstance(node, ast.Name) and node.id.upper() not in _WORDS:
            names.add(node.id.upper())
            return (lambda values, name=node.id.upper(): values[name]), False
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            inner = made(node.operand)
            return inner and ((lambda values: -inner[0](values)), inner[1])
        if isinstance(node, ast.BinOp) and type(node.op) in _OPERATORS:
            parts = [made(node.left), made(node.right)]
            f = _OPERATORS[type(node.op)]
        elif isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and not node.keywords:
            f = _FUNCTIONS.get(node.func.id.upper())
            if f is None or len(node.args) != (1 if f is np.abs else 2):
                return None
            parts = [made(x) for x in node.args]
        else:
            return None
        if any(p is None for p in parts) or all(number for _, number in parts):
            return None
        return (lambda values: f(*[p(values) for p, _ in parts])), False

    found = made(tree)
    return None if found is None else (found[0], names)


def entry_degree(rule: str) -> int | None:
    """Power of the entry price in a plain arithmetic rule; None where it is divided by, in a function or a case."""

    def degree(node: ast.AST) -> int | None:
        if isinstance(node, ast.Name):
            return int(node.id.upper() == ENTRY_PRICE)
        if isinstance(node, ast.Constant):
            return 0
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub | ast.UAdd):
            return degree(node.operand)
        if isinstance(node, ast.BinOp) and type(node.op) in _OPERATORS:
            left, right = degree(node.left), degree(node.right)
            if left is None or right is None or (isinstance(node.op, ast.Div) and right):
                return None
            return max(left, right) if isinstance(node.op, ast.Add | ast.Sub) else left + right
        if isinstance(node, ast.Call) and all(degree(x) == 0 for x in node.args):
            return 0
        return None

    try:
        return degree(ast.parse(rule.strip(), mode="eval").body)
    except SyntaxError:
        return None


def names_entry(rule: str) -> bool:
    return re.search(rf"\b{ENTRY_PRICE}\b", rule, re.IGNORECASE) is not None


def affine_in_entry(rule: str, amount: float | None = None) -> tuple[Column, Column]:
    """Columns (a, b) such that the rule equals a * ENTRY_PRICE + b on each bar.

    Only for positions whose entry price changes while they are open. A rule whose form is not that of a sum of
    first powers of the entry price (by ``entry_degree``) is refused.
    """
    if not names_entry(rule):
        return F.lit(0.0), value(rule, amount=amount)
    if entry_degree(rule) != 1:
        raise ValueError(f"only sums and multiples of {ENTRY_PRICE} may be used where the entry price moves: {rule!r}")
    at1, at2 = (value(rule, entry_price=f"{x}.0D", amount=amount) for x in (1, 2))
    return at2 - at1, at1 * 2 - at2


def all_met(rules: Iterable[str]) -> Column:
    """All rules hold; an unknown one does not, and no rules at all never hold."""
    checks = [F.expr(guarded(check_rule(rule))) for rule in rules]
    if not checks:
        return F.lit(False)
    return F.coalesce(reduce(and_, checks), F.lit(False))

