"""Shared helpers: the word pattern, lambda-bound values, and tables in the shared folder."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space is the space and the five ASCII controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Spark's setting to delete a query's shuffle files when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once for the row, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_of(df: DataFrame, col: str = "text") -> Column:
    """The text column with null read as empty."""
    return F.coalesce(df[col].cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the words of a text."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def held(column: Column) -> Column:
    """A one-row generator around a costly value: the optimizer can't inline it into each later use."""
    return F.explode(F.array(column))


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Running results of an associative ``op`` over an array, in blocks of the root of its length: appending copies an array, and blocks keep copies short."""

    def fold(part: Column) -> Column:
        empty = F.slice(part, 1, 0)
        return F.aggregate(part, empty, lambda a, x: F.concat(a, F.array(F.coalesce(op(F.get(a, F.size(a) - 1), x), x))))

    def joined(parts: Column) -> Column:
        return let(
            fold(F.transform(parts, lambda p: F.get(p, F.size(p) - 1))),
            lambda upto: F.flatten(F.transform(parts, lambda p, b: let(F.get(upto, b - 1), lambda before: F.transform(p, lambda x: F.coalesce(op(before, x), x))))),
        )

    def blocks(v: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(v))).cast("int")
        return let(width, lambda w: joined(F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / w).cast("int") - 1), lambda b: fold(F.slice(v, b * w + 1, w)))))

    return let(values, lambda v: F.when(F.size(v) == 0, v).otherwise(blocks(v)))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a local session (as in tests) gets one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="fathomlake-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it back. The shuffle files of the write go with its end, not with a later garbage collection."""
    spark = df.sparkSession
    path = table_path(spark, name)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete a stored table that no later step reads."""
    files = table.inputFiles()
    if files:
        jvm = table.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files of frames that nobody holds any more: it does so when its driver collects garbage, which first has to hear of them."""
    gc.collect()
    time.sleep(2)  # Python tells the driver's JVM of its dead frames from a thread that looks for them every second
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Give what this process freed back to the system (glibc and Arrow keep it otherwise)."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for mapInArrow; at its end the worker gives back what it freed. Spark keeps idle workers for a minute, and their memory counts beside that of the next stage's."""

    @functools.wraps(run)
    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
