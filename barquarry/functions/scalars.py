"""Scalar column helpers. All of them are compositions of built-in Spark functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EXCHANGE_SUFFIX = ".JK"


def nz(c: Column) -> Column:
    """Zero becomes null, so that a division by it is null instead of an error."""
    return F.nullif(c, F.lit(0.0))


def flag(c: Column) -> Column:
    """Boolean to 0/1; unknown counts as 0."""
    return F.coalesce(c, F.lit(False)).cast("int")


def as_double(c: Column) -> Column:
    """Cast that keeps missing values null: NaN sorts above every number in Spark."""
    d = c.cast("double")
    return F.when(~F.isnan(d), d)


def base_symbol(c: Column) -> Column:
    return F.replace(c, F.lit(EXCHANGE_SUFFIX), F.lit(""))


def display_symbol(symbol: Column, compliant: Column) -> Column:
    """Base symbol, with a trailing star unless it is on the compliance list."""
    return F.concat(base_symbol(symbol), F.when(compliant, F.lit("")).otherwise(F.lit("*")))


def parse_symbols(raw: Column) -> Column:
    """Comma list to an array of upper-case symbols with the exchange suffix; blanks dropped."""
    parts = F.transform(F.split(raw, ","), lambda x: F.upper(F.trim(x)))
    kept = F.filter(parts, lambda x: x != "")
    return F.transform(kept, lambda x: F.concat(x, F.lit(EXCHANGE_SUFFIX)))


def percent_fraction(text: Column) -> Column:
    """'2%' to 0.02; a bare number is taken as the fraction itself; anything else is null."""
    t = F.trim(text)
    return F.when(t.endswith("%"), F.rtrim(t, F.lit("%")).try_cast("double") / 100.0).otherwise(
        t.try_cast("double")
    )


def zip_shorter(a: Column, b: Column, names: tuple[str, str]) -> Column:
    """Pairs of two arrays as structs; the shorter one ends the list."""
    n = F.least(F.size(a), F.size(b))
    return F.arrays_zip(F.slice(a, 1, n).alias(names[0]), F.slice(b, 1, n).alias(names[1]))


def text_timestamp(text: Column) -> Column:
    """ISO text to a timestamp; anything else is null."""
    return F.try_to_timestamp(text)


def share_count(amount: Column, price: Column) -> Column:
    """Whole shares an amount buys, as a double; null for a zero price."""
    return F.floor(F.try_divide(amount, price)).cast("double")


def days_held(entry: Column, close: Column) -> Column:
    """Whole days between two bars. For timestamps it is the elapsed time rounded down."""
    seconds = F.unix_timestamp(close.cast("timestamp")) - F.unix_timestamp(entry.cast("timestamp"))
    return F.floor(seconds / F.lit(86400)).cast("int")


def iso_date(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def fixed2(c: Column) -> Column:
    """Two decimals without grouping; blank for null."""
    return F.coalesce(c.cast("decimal(38,2)").cast("string"), F.lit(""))


def grouped_id(c: Column) -> Column:
    """Number with '.' between thousands and up to three decimals after ','; blank for null."""
    text = F.translate(F.format_number(c, 3), ",.", ".,")
    trimmed = F.regexp_replace(text, ",?0+$", "")
    out = F.when(text.contains(","), trimmed).otherwise(text)
    return F.coalesce(F.when(out == "-0", F.lit("0")).otherwise(out), F.lit(""))


def range_days(period: str) -> int:
    """Calendar days covered by a backtest period name."""
    # Period name to days; every other name means two years.
    days = {"1m": 30, "3m": 90, "6m": 180, "12m": 365}
    return days.get(period, 730)


def listed(name: Column, names: Column | Sequence[str]) -> Column:
    """Is the name among ``names``, a column of arrays or a short list?"""
    among = names if isinstance(names, Column) else F.array(*[F.lit(n) for n in names]).cast("array<string>")
    return F.coalesce(F.array_contains(among, name), F.lit(False))


def has_prefix(text: Column, prefixes: Column | Sequence[str]) -> Column:
    """Does the text start with any of ``prefixes``?"""
    among = prefixes if isinstance(prefixes, Column) else F.array(*[F.lit(p) for p in prefixes]).cast("array<string>")
    return F.coalesce(F.exists(among, lambda p: F.startswith(text, p)), F.lit(False))


def named_numbers(text: Column, pattern: str) -> Column:
    """What the first group of ``pattern`` finds in a text, each once: window lengths in rules, say."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))


def equal_ratios(n: Column) -> Column:
    """n equal parts of 1."""
    return F.array_repeat(F.lit(1.0) / n, n.cast("int"))
