"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the result contracts: runs of anything but space, tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"

_OWN_DIR: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); a local one where it is unset and the master is local, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _OWN_DIR:
            _OWN_DIR.append(tempfile.mkdtemp(prefix="textloom-"))
        at = f"file://{_OWN_DIR[0]}"
    return f"{at.rstrip('/')}/textloom-{spark.sparkContext.applicationId}"


#: Whether Spark deletes a query's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read again: lineage ends there, and lost executors cost no recomputation. The shuffle files it took are deleted at once, since nothing reads them again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Delete the files of a staged frame that nothing reads any more."""
    jvm = df.sparkSession._jvm
    for f in df.inputFiles()[:1]:
        p = jvm.org.apache.hadoop.fs.Path(f).getParent()
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def source_bytes(df: DataFrame) -> int:
    """Bytes of the files under a frame, which only choose numbers of partitions; 0 where Spark doesn't know them."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    total = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return total if total < 1 << 55 else 0


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows and bytes, so a Python worker holds little of long texts at once. A session setting; results don't depend on it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 << 20))


def documents(df: DataFrame, *more: str) -> DataFrame:
    """doc_id and text as bigint and string, and the named columns; other columns, whatever their names, are left."""
    bound_batches(df.sparkSession)
    names = {c.lower(): c for c in df.columns}
    return df.select(F.col(f"`{names['doc_id']}`").cast("bigint").alias("doc_id"), F.col(f"`{names['text']}`").cast("string").alias("text"), *(F.col(f"`{names[c]}`").alias(c) for c in more))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ids_repeat(docs: DataFrame) -> bool:
    """Whether a doc_id stands on more than one row."""
    return docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").limit(1).count() > 0


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text, empty for null, without decoding."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def trim() -> None:
    """Give a Python worker's free memory back; workers live on after a task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


_KEPT: dict = {}


def kept(key: tuple, make: Callable[[], object]) -> object:
    """An object that this Python worker keeps from task to task; it keeps one at a time."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def release() -> None:
    """Give up what an earlier operator's tasks kept in this worker."""
    if _KEPT:
        _KEPT.clear()
        trim()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
