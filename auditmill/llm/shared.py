"""Scratch tables in the folder that the driver and all executors share, and file access by its address.

The folder is the session's spark.checkpoint.dir. Only where a session has none (tests, a laptop) one is made.
"""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of files that one task reads, where there are more of them than cores.
TASK_BYTES = 128_000_000
#: Bytes of text whose hashes or segments one part of a hash space holds: what one task takes whole. More text makes more parts.
PART_BYTES = 8_000_000
_made: list[tuple[SparkSession, str, int]] = []


def folder(spark: SparkSession) -> str:
    """The shared folder's address, with its scheme: a bare path is one of the cluster's default file system."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="auditmill-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return "file://" + full[5:] if full.startswith("file:/") and not full.startswith("file://") else full


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; cleaned by clean() or when the driver ends."""
    path = f"{folder(spark)}/auditmill/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clean_all)
    _made.append((spark, path, threading.get_ident()))
    return path


def _drop(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def clean(spark: SparkSession) -> None:
    """Delete all scratch tables of this session. Only for a caller that has written its results."""
    for item in [x for x in _made if x[0] is spark]:
        _drop(*item[:2])
        _made.remove(item)


@contextmanager
def scope(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Scratch that this thread makes inside is deleted at the end, but for tables that are put in the list. For callers that have written what they need."""
    before, me, kept = {x[1] for x in _made}, threading.get_ident(), []
    yield kept
    files = [f for df in kept for f in df.inputFiles()[:1]]
    for item in [x for x in _made if x[0] is spark and x[2] == me and x[1] not in before]:
        if not any(item[1].removeprefix("file://") in f for f in files):
            _drop(*item[:2])
            _made.remove(item)


def drop(df: DataFrame) -> None:
    """Delete the scratch table that df reads, if it is one."""
    files = df.inputFiles()[:1]
    for item in [x for x in _made if any(x[1].removeprefix("file://") in f for f in files)]:
        _drop(*item[:2])
        _made.remove(item)


def _clean_all() -> None:
    for spark, path, _ in _made:
        try:
            _drop(spark, path)
        except Exception:  # noqa: BLE001 - the gateway may be gone at exit
            return


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df from a table in the shared folder: cuts lineage, so that a lost executor costs no step before this one."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(rows: DataFrame, n: int, n_bytes: int) -> DataFrame:
    """rows, of which each stands for some of n_bytes elsewhere, over tasks by their number: AQE would put rows that are so small in one task.

    A task for each row, or for TASK_BYTES where that makes fewer, but not fewer than the cluster's cores."""
    return rows.repartition(max(1, min(n, max(rows.sparkSession.sparkContext.defaultParallelism, -(-n_bytes // TASK_BYTES)))))


def parts_of(spark: SparkSession, n_bytes: int) -> int:
    """Parts of a hash space over n_bytes of text, each of which a task can hold. They go to tasks by number (repartitionById), one to each.

    The session's auditmill.partBytes says how much text makes a part, for executors with more memory: at 100 TB, 128 MB make 780,000 parts."""
    return max(1, -(-n_bytes // int(spark.conf.get("auditmill.partBytes", str(PART_BYTES)))))


def release_memory() -> None:
    """Give freed memory back to the system. A worker process outlives its task, and what its allocators keep would be missing in the next stages."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def frugal(run: Callable) -> Callable:
    """A function of Arrow batches that leaves no freed memory behind."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release_memory()

    return wrapped


def frugal_group(run: Callable) -> Callable:
    """The same of one group's rows."""

    def wrapped(pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            return run(pdf)
        finally:
            release_memory()

    return wrapped


def filesystem(address: str):
    """pyarrow's file system for an address, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(address) if "://" in address else (fs.LocalFileSystem(), address)
