"""What rules may say, and how they are evaluated."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from barquarry.operators.rules import affine_in_entry, all_met, check_rule, columns_used, entry_degree, guarded, value
from barquarry.operators.strategy import Strategy
from barquarry.plans.presets import EXAMPLES, SHIPPED


@pytest.mark.parametrize("config", [*SHIPPED, *EXAMPLES], ids=lambda s: s["name"])
def test_known_strategies_are_accepted(config):
    assert Strategy.from_mapping(config).name == config["name"]


@pytest.mark.parametrize(
    "rule", ["__import__('os')", "CLOSE > UNKNOWN", "java_method(1)", "CLOSE > 1; DROP", "`a` > 1", "reflect(CLOSE)", "_TR > 1"]
)
def test_other_text_is_refused(rule):
    with pytest.raises(ValueError):
        check_rule(rule)


def test_columns_used():
    rules = ["close > MA37", "ADX14 >= 30 AND HH15 > 1e3", "TRAILING_PE < 10", "MA37 > 0"]
    assert columns_used(rules) == ["CLOSE", "MA37", "ADX14", "HH15", "TRAILING_PE"]


def test_division_by_zero_is_not_met(spark):
    before = spark.conf.get("spark.sql.ansi.enabled")
    df = spark.sql("SELECT 1D AS CLOSE, 0D AS VOLUME UNION ALL SELECT 4D, 2D")
    out = df.withColumns({"ok": all_met(["CLOSE / VOLUME > 1"]), "none": all_met([])})
    assert sorted((r.ok, r.none) for r in out.collect()) == [(False, False), (True, False)]
    assert spark.conf.get("spark.sql.ansi.enabled") == before
    assert df.where(F.col("CLOSE") > 1).count() == 1


@pytest.mark.parametrize(
    ("rule", "divisor_guarded"),
    [
        ("CLOSE / VOLUME", "CLOSE / NULLIF(VOLUME, 0)"),
        ("CLOSE/-VOLUME*2", "CLOSE/ NULLIF(-VOLUME, 0)*2"),
        ("1 / (CLOSE - OPEN / LOW) > 2", "1 / NULLIF((CLOSE - OPEN / NULLIF(LOW, 0)), 0) > 2"),
        ("CLOSE % ABS(LOW / 2) + 1", "CLOSE % NULLIF(ABS(LOW / NULLIF(2, 0)), 0) + 1"),
        ("CLOSE / CASE WHEN LOW > 1 THEN CASE WHEN 1 > 0 THEN 2 END ELSE 0 END > 3", "CLOSE / NULLIF(CASE WHEN LOW > 1 THEN CASE WHEN 1 > 0 THEN 2 END ELSE 0 END, 0) > 3"),
        ("CLOSE > 1e3", "CLOSE > 1e3"),
    ],
)
def test_divisors_are_guarded(rule, divisor_guarded):
    assert guarded(rule) == divisor_guarded


def test_rules_do_not_depend_on_the_session(spark):
    """Other threads analyse queries in the same session meanwhile and keep its setting."""
    df = spark.sql("SELECT 4D AS CLOSE, 0D AS VOLUME, 3D AS LOW")
    rules = ["CLOSE / VOLUME > 0", "CLOSE % (VOLUME * 2) < 9", "LOW / (CLOSE - 4) / 2 > 0", "CLOSE / LOW / 2 > 0.6"]
    key = "spark.sql.ansi.enabled"
    before = spark.conf.get(key)

    def asked(_):
        with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
            spark.sql("SELECT 1 / 0").collect()
        return [df.select(all_met([rule]).alias("x")).first().x for rule in rules] + [df.select(value("CLOSE / VOLUME").alias("x")).first().x]

    try:
        for ansi in ("true", "false"):
            spark.conf.set(key, ansi)
            with ThreadPoolExecutor(2) as pool:
                found = list(pool.map(asked if ansi == "true" else (lambda _: [df.select(all_met([r]).alias("x")).first().x for r in rules]), range(2)))
            assert [f[:4] for f in found] == [[False, False, False, True]] * 2
            assert ansi == "false" or [f[4] for f in found] == [None, None]
            assert spark.conf.get(key) == ansi
    finally:
        spark.conf.set(key, before)


def test_power_of_the_entry_price():
    degrees = {
        "ENTRY_PRICE * 0.97 - ATR14 / 2": 1,
        "(ENTRY_PRICE - 1) * (ENTRY_PRICE - 2) * (ENTRY_PRICE - 3)": 3,
        "-ENTRY_PRICE + ABS(CLOSE)": 1,
        "CLOSE / ENTRY_PRICE": None,
        "GREATEST(ENTRY_PRICE, CLOSE)": None,
        "CASE WHEN ENTRY_PRICE > 1 THEN 1 END": None,
        "CLOSE * 2": 0,
    }
    assert {rule: entry_degree(rule) for rule in degrees} == degrees
    with pytest.raises(ValueError, match="sums and multiples"):
        affine_in_entry("(ENTRY_PRICE - 1) * (ENTRY_PRICE - 2) * (ENTRY_PRICE - 3)")
