"""Strategy files: one JSON object per file in a folder, read anew on every call."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barquarry.operators.strategy import Strategy

_LISTS = ["entry", "tp", "sl", "avg_down", "avg_up", "partial_tp"]
_FIELDS = [
    "name string",
    "description string",
    *[f"{n} string" for n in _LISTS],
    "max_hold_days int",
    "partial_tp_ratios array<double>",
    "amount string",
    "ts string",
    "_bad string",
]


def read_strategy_table(spark: SparkSession, folder: str) -> DataFrame:
    """One row per strategy name. Empty and invalid files are skipped; a missing name is the
    file stem; of files with the same name the last in file order wins."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.[jJ][sS][oO][nN]")
    return parse_strategies(files.select("value", F.col("_metadata.file_name").alias("file")))


def parse_strategies(files: DataFrame) -> DataFrame:
    """The strategy table of texts (value, file); a rule list may be given as one text."""
    parsed = files.where(F.trim("value") != "").withColumn(
        "cfg",
        F.from_json(
            "value",
            ", ".join(_FIELDS),
            {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"},
        ),
    ).where("cfg IS NOT NULL AND cfg._bad IS NULL")
    stem = F.regexp_replace("file", r"\.[^.]*$", "")
    lists = []
    for n in _LISTS:
        text = F.col(f"cfg.{n}")
        is_list = F.startswith(F.ltrim(text), F.lit("["))
        lists.append(
            F.when(is_list, F.from_json(text, "array<string>"))
            .when(text.isNotNull(), F.array(text))
            .otherwise(F.array().cast("array<string>"))
            .alias(n)
        )
    table = parsed.select(
        F.coalesce(F.nullif("cfg.name", F.lit("")), stem).alias("name"),
        "cfg.description",
        *lists,
        "cfg.max_hold_days",
        "cfg.partial_tp_ratios",
        "cfg.amount",
        "cfg.ts",
        "file",
    )
    newest = Window.partitionBy("name").orderBy(F.col("file").desc())
    return table.withColumn("_k", F.row_number().over(newest)).where("_k = 1").drop("_k", "file")


def load_strategies(spark: SparkSession, folder: str) -> dict[str, Strategy]:
    """Checked strategies by name. Only these small definitions come to the driver."""
    rows = read_strategy_table(spark, folder).collect()
    return {r["name"]: Strategy.from_mapping(r.asDict()) for r in rows}


def pick_strategy(strategies: dict[str, Strategy], name: str) -> Strategy:
    if name not in strategies:
        raise KeyError(f"unknown strategy: {name}")
    return strategies[name]
