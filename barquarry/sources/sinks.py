"""Result tables and their display form."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from barquarry.functions.scalars import fixed2, grouped_id
from barquarry.session import computed_once

PAGE_SIZES = (10, 25, 50, 100)


# Characters that Spark writes as % and two hexadecimal digits in the name of a partition folder.
_ESCAPED = {*(chr(i) for i in range(1, 32)), *"\"#%'*/:=?\\\x7f{[]^"}


def _folder(strategy: str) -> str:
    return "strategy=" + "".join(f"%{ord(ch):02X}" if ch in _ESCAPED else ch for ch in strategy)


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    to_path = jvm.org.apache.hadoop.fs.Path
    return to_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), to_path


def write_rows(rows: DataFrame, path: str, format: str = "json", strategies: Sequence[str] = ()) -> None:
    """Result rows, one folder per strategy. Rows of other strategies that are there already stay.

    Replaced are the strategies that occur in ``rows`` and those named in ``strategies``, which may have no
    rows now. New rows are first written aside: if that fails, everything is left as it was.
    Folders are then exchanged one by one, the old ones being kept until all are.
    """
    fs, to_path = _files(rows.sparkSession, path)
    staged = f"{path}/_staged-{uuid.uuid4().hex}"
    try:
        rows.write.partitionBy("strategy").format(format).save(f"{staged}/new")
    except BaseException:
        fs.delete(to_path(staged), True)
        raise
    found = [s.getPath().getName() for s in fs.listStatus(to_path(f"{staged}/new"))]
    found = [n for n in found if n.startswith("strategy=")]
    moves = []
    for name in sorted({*found, *map(_folder, strategies)}):
        if fs.exists(to_path(f"{path}/{name}")):
            moves.append((f"{path}/{name}", f"{staged}/old/{name}"))
        if name in found:
            moves.append((f"{staged}/new/{name}", f"{path}/{name}"))
    fs.mkdirs(to_path(f"{staged}/old"))
    for here, there in moves:
        if not fs.rename(to_path(here), to_path(there)):
            raise OSError(f"could not move {here} to {there}; earlier rows are in {staged}/old")
    fs.delete(to_path(staged), True)


def write_backtest(
    trades: DataFrame, summary: DataFrame, path: str, format: str = "parquet", strategies: Sequence[str] = ()
) -> None:
    write_rows(trades, f"{path}/trades", format, strategies)
    write_rows(summary, f"{path}/summary", format, strategies)


def _percent(name: str):
    c = F.col(name)
    return F.when(c.isNull(), "").otherwise(F.concat(fixed2(c), F.lit(" %")))


def _held():
    days = F.col("hold_period")
    return F.when(days.isNull(), "").otherwise(F.concat(days.cast("string"), F.lit("d")))


def _text(name: str):
    return F.coalesce(F.col(name), F.lit(""))


def scan_display(rows: DataFrame) -> DataFrame:
    """The 13 table columns of scan rows as text; blank where there is no value."""
    return rows.select(
        F.col("ticker").alias("Ticker"),
        fixed2(F.col("price")).alias("Price"),
        fixed2(F.col("entry_price")).alias("Entry"),
        fixed2(F.col("stop_loss")).alias("SL"),
        fixed2(F.col("take_profit")).alias("TP"),
        _percent("est_profit_pct").alias("TP_pct"),
        grouped_id(F.col("est_profit_rp")).alias("TP_Rp"),
        _percent("est_loss_pct").alias("SL_pct"),
        grouped_id(F.col("est_loss_rp")).alias("SL_Rp"),
        grouped_id(F.col("pnl")).alias("PnL"),
        _text("entry_date").alias("Start"),
        _text("close_date").alias("End"),
        _held().alias("Hold"),
    )


def trade_display(rows: DataFrame) -> DataFrame:
    """The same columns for trade rows; estimates stay blank."""
    blank = F.lit("")
    return rows.select(
        F.col("ticker").alias("Ticker"),
        fixed2(F.col("exit_price")).alias("Price"),
        fixed2(F.col("entry_price")).alias("Entry"),
        fixed2(F.col("stop_loss")).alias("SL"),
        fixed2(F.col("take_profit")).alias("TP"),
        blank.alias("TP_pct"),
        blank.alias("TP_Rp"),
        blank.alias("SL_pct"),
        blank.alias("SL_Rp"),
        grouped_id(F.col("pnl")).alias("PnL"),
        _text("entry_date").alias("Start"),
        _text("close_date").alias("End"),
        _held().alias("Hold"),
    )


# Total orders over typed columns: one scan row per strategy and symbol, one trade per entry date too.
SCAN_ORDER = ("ticker", "strategy")
TRADE_ORDER = ("entry_date", "ticker", "strategy", "close_date", "exit_reason", "exit_price")


def page(rows: DataFrame, order: Sequence[str], number: int = 0, size: int = 25) -> DataFrame:
    """One page of a result table in a total order (a top-k, not a full sort).

    The order is that of typed columns; format the page afterwards. Every page of a long table
    keeps the rows before it too; ``page_after`` does not.
    """
    if size not in PAGE_SIZES:
        raise ValueError(f"page size must be one of {PAGE_SIZES}")
    return rows.orderBy(*order).offset(number * size).limit(size)


def page_after(rows: DataFrame, order: Sequence[str], last: Row | None, size: int = 25) -> DataFrame:
    """The ``size`` rows after ``last``, a row of the page before: bounded whatever the page.

    The columns of ``order`` must not be null.
    """
    if size not in PAGE_SIZES:
        raise ValueError(f"page size must be one of {PAGE_SIZES}")
    if last is not None:
        rows = rows.where(F.struct(*order) > F.struct(*[F.lit(last[n]) for n in order]))
    return rows.orderBy(*order).limit(size)


def write_pages(rows: DataFrame, order: Sequence[str], path: str, rows_per_range: int = 10_000) -> None:
    """Store a result table for paging: ranges of the order, and a directory of where each one starts.

    Rows are dealt out by ranges of ``order``, of about ``rows_per_range`` rows each; the directory has one
    row per range.
    """
    rows = computed_once(rows)  # counted, sampled for the ranges and written
    ranges = max(1, -(-rows.count() // rows_per_range))
    dealt = rows.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id())
    dealt.write.mode("overwrite").partitionBy("_range").parquet(f"{path}/rows")
    spark = rows.sparkSession
    # An empty table has no range; its columns are still known.
    rows.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{path}/columns")
    sizes = _ranged(spark, path).groupBy("_range").agg(F.count("*").alias("n"))
    so_far = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    starts = sizes.withColumn("end", F.sum("n").over(so_far)).withColumn("start", F.col("end") - F.col("n"))
    starts.coalesce(1).write.mode("overwrite").parquet(f"{path}/directory")


def _ranged(spark: SparkSession, path: str) -> DataFrame:
    columns = spark.read.parquet(f"{path}/columns").schema
    return spark.read.schema(columns.add("_range", "integer")).parquet(f"{path}/rows")


def read_page(spark: SparkSession, path: str, order: Sequence[str], number: int = 0, size: int = 25) -> DataFrame:
    """Page ``number`` of a table stored by ``write_pages``: only the ranges that hold its rows are read."""
    if size not in PAGE_SIZES:
        raise ValueError(f"page size must be one of {PAGE_SIZES}")
    first = number * size
    ranges = spark.read.parquet(f"{path}/directory").where((F.col("start") < first + size) & (F.col("end") > first))
    held = sorted((r["start"], r["_range"]) for r in ranges.collect())
    rows = _ranged(spark, path).where(F.col("_range").isin([k for _, k in held]))
    skip = first - held[0][0] if held else 0
    return rows.drop("_range").orderBy(*order).offset(skip).limit(size)
