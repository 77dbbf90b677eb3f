"""Helpers shared by the text operators: written intermediate tables and Arrow batches of texts."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

#: Texts of one Arrow batch are worked on in slices of at most about so many characters.
SLICE_CHARS = 4_000_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in a local session."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    made = spark.sparkContext.getCheckpointDir()
    if made:
        return made.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="barquarry-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def stored(df: DataFrame, among: list[str] | None = None) -> DataFrame:
    """``df`` written once in the shared folder and read back.

    Cuts the lineage and fixes values that depend on partitioning; lost executors do not lose it.
    The path is added to ``among``, for ``dropped``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if among is not None:
        among.append(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, paths: list[str]) -> None:
    """Delete stored tables that nothing reads any more: all that was made from them is itself stored."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while paths:
        path = jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(conf).delete(path, True)


def trimmed() -> None:
    """Give memory that this worker's last batches have freed back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def remainder(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % parts, F.lit(-1))


_KEPT: dict[tuple, object] = {}


def kept_in_worker(key: tuple, make: Callable[[], object]):
    """What ``make()`` gives, kept for later tasks of this Python worker under ``key``.

    Asking for another key drops it: a worker that serves one stage after the other holds the
    store of one operator at a time.
    """
    if key not in _KEPT:
        _KEPT.clear()
        trimmed()
        _KEPT[key] = make()
    return _KEPT[key]


def text_slices(texts: list, most: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of ``texts`` with about ``most`` characters; a longer text stands alone."""
    return size_slices([len(text) if text is not None else 0 for text in texts], most)


def size_slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of ``sizes`` that add up to about ``most``; a larger one stands alone."""
    first = total = 0
    for i, n in enumerate(sizes):
        if i > first and total + n > most:
            yield first, i
            first, total = i, 0
        total += n
    if first < len(sizes):
        yield first, len(sizes)


def map_texts(docs: DataFrame, make: Callable[[], Callable[[list], list]], schema: str, keep: tuple[str, ...] = ("doc_id",), most: int = SLICE_CHARS) -> DataFrame:
    """Columns ``keep`` of ``docs`` followed by those that a scorer gives for each text.

    ``make()`` is called once per task; the scorer takes a list of texts (or None), of about ``most``
    characters, and returns one
    list or array per column of ``schema``. Other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    head = docs.select(*keep).schema
    out = spark.createDataFrame([], schema).schema
    names = [f.name for f in out]
    types = [to_arrow_type(f.dataType) for f in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        for batch in batches:
            if not batch.num_rows:
                continue
            scorer = scorer or make()
            texts = batch.column(len(keep)).to_pylist()
            for a, b in text_slices(texts, most):
                found = scorer(texts[a:b])
                columns = [batch.column(i).slice(a, b - a) for i in range(len(keep))]
                columns += [pa.array(v, type=t) for v, t in zip(found, types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *names])
        trimmed()

    return docs.select(*keep, "text").mapInArrow(run, StructType([*head, *out]))


def filter_texts(docs: DataFrame, make: Callable[[], Callable[[list], list]], most: int = SLICE_CHARS) -> DataFrame:
    """The rows of ``docs``, with all columns, whose text the judge of ``make()`` accepts."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = None
        for batch in batches:
            if not batch.num_rows:
                continue
            judge = judge or make()
            texts = batch.column(at).to_pylist()
            accepted = [x for a, b in text_slices(texts, most) for x in judge(texts[a:b])]
            yield batch.filter(pa.array(accepted, type=pa.bool_()))
        trimmed()

    return docs.mapInArrow(run, docs.schema)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, each: int, seed: int = 0, where: Column | None = None) -> list[tuple[str, int]]:
    """At most about ``each`` (text, label) pairs per value of ``label`` (0 or 1), chosen by a hash of the id.

    Ids are drawn from the labels first, so that texts of the documents are read once, against a
    list that is never longer than twice ``each`` (more only if ids are repeated).
    """
    rows = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    rows = rows if where is None else rows.where(where)
    share = {r[label]: min(1.0, each / r["n"]) for r in rows.groupBy(label).agg(F.count("*").alias("n")).collect()}
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1_000_000)) / 1e6
    rows = rows.where(place < F.when(F.col(label) == 1, share.get(1, 0.0)).otherwise(share.get(0, 0.0)))
    rows = rows.select("doc_id", label).dropDuplicates(["doc_id"])
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    found = texts.join(F.broadcast(rows), "doc_id").select("text", label).collect()
    return sorted((r["text"], r[label]) for r in found)
