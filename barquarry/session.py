"""Session defaults for local runs and tests; on a cluster the given session is used as it is."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    # Loopback only: no other interface is bound.
    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("barquarry")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("BARQUARRY_DRIVER_MEMORY", "6g"))
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str | None:
    """The folder named by ``spark.checkpoint.dir`` or set before, which driver and executors share.

    A local session (driver and tasks are one process) without one gets a temporary folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (context.master == "local" or context.master.startswith("local[")):
            return None
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="barquarry-"))
    return context.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    folder = shared_folder(spark)
    if folder is None:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def computed_once(df: DataFrame) -> DataFrame:
    """A checkpoint of ``df`` in the session's shared checkpoint folder.

    For frames that a plan reads several times. Files there outlive lost executors. On a cluster without a
    folder the frame itself is returned: results are the same, but it is computed per reader.
    """
    return df if shared_folder(df.sparkSession) is None else df.checkpoint()


def dealt_once(df: DataFrame, keys: Sequence[str], order: str, tasks: int) -> DataFrame:
    """``df`` written once in ``tasks`` buckets of ``keys``, ordered by them and ``order``: windows and joins on the keys move nothing.

    Without a shared folder the rows are dealt out and ordered anew for each reader.
    """
    spark = df.sparkSession
    dealt = df.repartition(tasks, *keys)
    if shared_folder(spark) is None:
        return dealt.sortWithinPartitions(*keys, order)
    path = new_path(spark, "dealt")
    name = path.rpartition("/")[2].replace("-", "_")
    writer = dealt.write.format("parquet").bucketBy(tasks, *keys).sortBy(*keys, order)
    writer.option("path", path).saveAsTable(name)
    written = spark.table(name)
    # The frame knows its files and buckets; the name is needed no more, and the files stay.
    spark.sql(f"DROP TABLE {name}")
    return written
