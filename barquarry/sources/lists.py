"""Symbol lists: the universe, the compliance list, and the symbols of a request."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barquarry.functions.scalars import EXCHANGE_SUFFIX, parse_symbols


def read_symbol_list(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of strings as rows (symbol, name). A missing file is an empty list."""
    empty = spark.createDataFrame([], "symbol string, name string")
    try:
        texts = spark.read.text(path, wholetext=True)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return empty
        raise
    return parse_symbol_list(texts)


def parse_symbol_list(texts: DataFrame) -> DataFrame:
    """Rows (symbol, name) of JSON arrays in column value; a text that is none gives no row."""
    symbols = F.explode(F.from_json("value", "array<string>"))
    return texts.select(symbols.alias("symbol")).withColumn("name", F.col("symbol"))


def requested_symbols(spark: SparkSession, raw: str | None, universe: DataFrame) -> DataFrame:
    """Distinct symbols of a comma list, or of the whole universe if it is blank."""
    if raw and raw.strip():
        asked = spark.range(1).select(F.explode(parse_symbols(F.lit(raw))).alias("symbol"))
    else:
        asked = universe.select(
            F.concat(F.upper("symbol"), F.lit(EXCHANGE_SUFFIX)).alias("symbol")
        )
    return asked.distinct()
