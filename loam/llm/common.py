"""Shared plumbing of the corpus operators.

Intermediate tables go to the folder that the cluster names in ``spark.checkpoint.dir``; no operator keeps state on
an executor, so a lost executor costs a recomputation and nothing else.
"""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder as shared_dir

#: Rows in one Arrow batch. Texts have no length limit, so batches are also cut by bytes (``TEXT_BATCH_BYTES``).
ARROW_ROWS = 1000
TEXT_BATCH_BYTES = 32 << 20

_MASK = (1 << 64) - 1


def tune(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(TEXT_BATCH_BYTES))
    except Exception:  # noqa: BLE001  an older Spark knows no such setting; the row limit holds
        pass
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


#: Folders of the tables that operators have written for themselves, while ``swept`` keeps account of them.
_WRITTEN: list[list[str]] = []


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back; later passes start from the files."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/loam/{label}-{uuid.uuid4().hex}"
    for account in _WRITTEN:
        account.append(at)
    df.write.option("compression", "zstd").parquet(at)
    return spark.read.schema(df.schema).parquet(at)


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Within this block a result is made and written; at its end the tables that operators wrote on the way are deleted."""
    _WRITTEN.append([])
    try:
        yield
    finally:
        for at in _WRITTEN.pop():
            discard(spark, at)


def discard(spark: SparkSession, at: str) -> None:
    """Delete a written table that no later step reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of steps that are done and written: it does so when their plans are collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Memory that an operator keeps in its workers between its own tasks: name -> what drops it.
KEPT: dict[str, Callable[[], None]] = {}


def drop_kept(but: str | None) -> None:
    for name in [k for k in KEPT if k != but]:
        KEPT.pop(name)()


def trimmed(run, keeps: str | None = None):
    """``run`` for mapInArrow, after which the worker gives free memory back: workers are kept for later tasks of any kind,
    and share an executor's memory with its heap. What other operators than ``keeps`` have kept is dropped first."""

    def go(batches):
        drop_kept(keeps)
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library keeps it as it likes
            pass

    return go


def partitions_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the two columns that the operators read, whatever else the table has."""
    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def rows_of(batches) -> Iterator[tuple]:
    """(doc_id, text) of every row of an Arrow batch iterator."""
    for b in batches:
        yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)


def small_enough(df: DataFrame, most_rows: int) -> bool:
    """Whether a table has at most ``most_rows`` rows; reads no more than that many and one."""
    return df.limit(most_rows + 1).count() <= most_rows
