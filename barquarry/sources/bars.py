"""Bar tables: reading, header repair, validation and construction from ticks."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date as Date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barquarry.functions.scalars import as_double
from barquarry.session import computed_once

BAR_SCHEMA = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("volume", T.DoubleType()),
    ]
)
PRICE_COLUMNS = ["open", "high", "low", "close"]
_BAR_VALUES = [*PRICE_COLUMNS, "volume"]


def read_bars(
    spark: SparkSession,
    path: str,
    *,
    format: str = "parquet",
    schema: T.StructType | None = BAR_SCHEMA,
    symbols: DataFrame | Sequence[str] | None = None,
    start: Date | str | None = None,
    end: Date | str | None = None,
    **options: str,
) -> DataFrame:
    """Bars of the asked symbols and dates. Date and symbol-list filters reach the files."""
    reader = spark.read.format(format).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return restrict(reader.load(path), symbols=symbols, start=start, end=end)


def restrict(
    bars: DataFrame,
    *,
    symbols: DataFrame | Sequence[str] | None = None,
    start: Date | str | None = None,
    end: Date | str | None = None,
) -> DataFrame:
    if start is not None:
        bars = bars.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        bars = bars.where(F.col("date") <= F.lit(end).cast("date"))
    if isinstance(symbols, DataFrame):
        # No broadcast hint: Spark broadcasts the list when its size allows it.
        bars = bars.join(symbols.select("symbol").distinct(), "symbol", "left_semi")
    elif symbols is not None:
        bars = bars.where(F.col("symbol").isin(list(symbols)))
    return bars


def normalise_headers(df: DataFrame) -> DataFrame:
    """Lower-case column names; of names that then coincide the first is kept."""
    first: dict[str, int] = {}
    for i, name in enumerate(df.columns):
        first.setdefault(name.lower(), i)
    unique = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return unique.select(*[F.col(f"_{i}").alias(name) for name, i in first.items()])


def require_columns(df: DataFrame, needed: Sequence[str] = tuple(PRICE_COLUMNS)) -> DataFrame:
    """The frame itself, or no rows of it when a needed column is absent.

    ``missing_columns`` tells why, so that a file left out can be reported.
    """
    return df if not missing_columns(df, needed) else df.limit(0)


def missing_columns(df: DataFrame, needed: Sequence[str] = tuple(PRICE_COLUMNS)) -> list[str]:
    have = {n.lower() for n in df.columns}
    return [n for n in needed if n not in have]


def reject_reason() -> Column:
    """Why a bar cannot be used, or null."""
    absent = F.lit(False)
    unusable = F.lit(False)
    for n in PRICE_COLUMNS:
        absent = absent | F.col(n).isNull() | F.isnan(n)
        unusable = unusable | (F.col(n) <= 0)
    return (
        F.when(F.col("symbol").isNull() | F.col("date").isNull(), "missing key")
        .when(absent, "missing price")
        .when(unusable, "price not positive")
        .when(F.col("volume").isNull() | F.isnan("volume"), "missing volume")
    )


def split_rejects(bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable bars, rejects(symbol, date, reason)). Row filters only: no shuffle."""
    marked = bars.withColumn("reason", reject_reason())
    good = marked.where(F.col("reason").isNull()).drop("reason")
    return good, marked.where(F.col("reason").isNotNull()).select("symbol", "date", "reason")


def split_duplicates(bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bars with one row per symbol and date, rejects(symbol, date, reason)).

    Of bars that are equal in all prices and the volume one stays. Where bars of one symbol and date contradict
    each other none can be trusted: they are rejected. Dates that repeat are found by a partial
    aggregate, so that only keys and extremes are moved, and only their rows are taken out.
    """
    values = [n for n in _BAR_VALUES if n in bars.columns]
    extremes = [f(n).alias(f"_{k}_{n}") for n in values for k, f in (("low", F.min), ("high", F.max), ("known", F.count))]
    repeated = bars.groupBy("symbol", "date").agg(F.count("*").alias("_n"), *extremes).where("_n > 1")
    same = F.lit(True)
    for n in values:
        same = same & F.col(f"_low_{n}").eqNullSafe(F.col(f"_high_{n}")) & F.col(f"_known_{n}").isin(0, F.col("_n"))
    repeated = computed_once(repeated.withColumn("_same", same))
    merged = repeated.where("_same").select("symbol", "date", *[F.col(f"_low_{n}").alias(n) for n in values])
    single = bars.join(repeated.select("symbol", "date"), ["symbol", "date"], "left_anti").select("symbol", "date", *values)
    rejects = repeated.where("NOT _same").select("symbol", "date", F.lit("contradicting bars").alias("reason"))
    return single.unionByName(merged), rejects


def usable_frames(spark: SparkSession, frames: dict[str, DataFrame], needed: Sequence[str] | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """(frames with all needed columns by name, rejects(source, reason)): a file left out is named with what it lacks."""
    needed = PRICE_COLUMNS if needed is None else needed
    lacking = {name: missing_columns(df, needed) for name, df in frames.items()}
    rows = [(name, "missing column " + ", ".join(names)) for name, names in lacking.items() if names]
    return {n: df for n, df in frames.items() if not lacking[n]}, spark.createDataFrame(rows, "source string, reason string")


def store_bars(bars: DataFrame, table: str, buckets: int, path: str | None = None) -> None:
    """Bars as a table in buckets of symbols, sorted by date: per-symbol windows and joins on it need no shuffle.

    ``path`` puts the files there instead of into the warehouse. One task writes one bucket, so choose as many
    buckets as a shuffle of the bars would have partitions.
    """
    writer = bars.repartition(buckets, "symbol").write.mode("overwrite").format("parquet")
    writer = writer.bucketBy(buckets, "symbol").sortBy("symbol", "date")
    (writer.option("path", path) if path else writer).saveAsTable(table)


def stored_bars(spark: SparkSession, table: str, symbols: DataFrame | Sequence[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars of a table written by ``store_bars``, restricted as by ``read_bars``."""
    return restrict(spark.table(table), symbols=symbols, start=start, end=end)


def without_failing_symbols(bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bars of symbols with no bad bar, rejects(symbol, reason)): one bad bar drops the symbol."""
    _, bad = split_rejects(bars)
    rejects = bad.groupBy("symbol").agg(F.min("reason").alias("reason"))
    return bars.join(rejects.select("symbol"), "symbol", "left_anti"), rejects


def unusable_ticks(ticks: DataFrame, *, symbol: Column, ts: Column, price: Column) -> DataFrame:
    """(reason, n): ticks that ``bars_from_ticks`` skips, counted by what they lack."""
    reason = (
        F.when(symbol.isNull(), "missing symbol").when(ts.isNull(), "missing time").when(as_double(price).isNull(), "missing price")
    )
    return ticks.groupBy(reason.alias("reason")).agg(F.count("*").alias("n")).where("reason IS NOT NULL")


def _bucketed(ts: Column, bucket: str | int) -> Column:
    if bucket == "day":
        return F.to_date(ts)
    if isinstance(bucket, str):
        return F.date_trunc(bucket, ts)
    return F.timestamp_seconds(F.floor(F.unix_timestamp(ts) / bucket) * bucket)


def bar_states(
    ticks: DataFrame,
    *,
    symbol: Column,
    ts: Column,
    price: Column,
    volume: Column | None = None,
    order: Column | None = None,
    bucket: str | int = "day",
) -> DataFrame:
    """Bars that can be merged: open and close stand with their places in the order of ticks.

    Ticks without symbol, time or price (null or NaN) are skipped; ``unusable_ticks`` counts
    them. A missing size counts as nothing traded.

    ``bucket`` is 'day' (a DATE), another date_trunc unit, or seconds (a TIMESTAMP). Ticks are
    aggregated before the shuffle, so a symbol with most of the ticks is no larger task than
    any other: at most one row per bucket and input partition is sent. ``order`` decides
    open and close inside a bucket; a plain numeric or time column keeps the aggregate hashed.
    """
    size = F.lit(1.0) if volume is None else volume.cast("double")
    flat = ticks.select(
        symbol.cast("string").alias("symbol"),
        _bucketed(ts, bucket).alias("date"),
        as_double(price).alias("_p"),
        F.coalesce(as_double(size), F.lit(0.0)).alias("_v"),
        (ts if order is None else order).alias("_o"),
    ).where("symbol IS NOT NULL AND date IS NOT NULL AND _p IS NOT NULL")
    return flat.groupBy("symbol", "date").agg(
        F.min_by("_p", "_o").alias("open"),
        F.max("_p").alias("high"),
        F.min("_p").alias("low"),
        F.max_by("_p", "_o").alias("close"),
        F.coalesce(F.sum("_v"), F.lit(0.0)).alias("volume"),
        F.min("_o").alias("open_at"),
        F.max("_o").alias("close_at"),
    )


def merge_states(states: DataFrame, bucket: str | int | None = None) -> DataFrame:
    """States of one symbol and date made one, or rolled up to a coarser ``bucket``.

    Merging stored states with those of late ticks, or hour states into days, gives what all ticks together
    would, and no tick is read again. The order must hold across what is merged.
    """
    date = F.col("date") if bucket is None else _bucketed(F.col("date"), bucket)
    return states.groupBy("symbol", date.alias("date")).agg(
        F.min_by("open", "open_at").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "close_at").alias("close"),
        F.sum("volume").alias("volume"),
        F.min("open_at").alias("open_at"),
        F.max("close_at").alias("close_at"),
    )


def bars_of(states: DataFrame) -> DataFrame:
    return states.drop("open_at", "close_at")


def bars_from_ticks(
    ticks: DataFrame,
    *,
    symbol: Column,
    ts: Column,
    price: Column,
    volume: Column | None = None,
    order: Column | None = None,
    bucket: str | int = "day",
) -> DataFrame:
    """Open/high/low/close/volume bars per symbol and time bucket, without nulls; see ``bar_states``."""
    return bars_of(bar_states(ticks, symbol=symbol, ts=ts, price=price, volume=volume, order=order, bucket=bucket))
