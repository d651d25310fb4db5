"""What the operators of this subpackage share: sizing, shared folders, row carrying."""

from __future__ import annotations

import ctypes
import math
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a scanned input for each block or bucket that one task holds in memory.
BLOCK_BYTES = 6 << 20


def scaled_parts(df: DataFrame, bytes_each: int = BLOCK_BYTES, most: int = 1 << 20) -> int:
    """A number of partitions that follows the planned size of ``df``.

    Catalyst's size estimate of a file scan is the size of its files, so no job runs.
    Never fewer than ``spark.sql.shuffle.partitions``.
    """
    spark = df.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 62:  # no statistics
        size = 0
    return max(1, least, min(most, math.ceil(size / bytes_each)))


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``. Where that is unset it is one of this machine in local mode, and the warehouse's on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        local = spark.sparkContext.master.split("[")[0] == "local"
        base = "file://" + tempfile.mkdtemp(prefix="tessera-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/tessera"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def materialize(df: DataFrame, compression: str | None = None, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors. By default the session's Parquet compression and options."""
    path = shared_dir(df.sparkSession)
    schema = df.schema
    df.write.options(**(options or {})).parquet(path, compression=compression)
    return df.sparkSession.read.schema(schema).parquet(path)


def stable(df: DataFrame) -> DataFrame:
    """``df``, or a written copy of it where a shuffle may deal its rows otherwise when a task runs again."""
    return materialize(df) if "Exchange" in df._jdf.queryExecution().executedPlan().toString() else df


def carried(df: DataFrame, id_col: str, text_col: str, carry: bool) -> DataFrame:
    """``df`` as (``__id``, ``__text``, ``__row``): the whole row rides along in a struct, so no name can clash."""
    bound_batches(df.sparkSession)
    cols: list[Column] = [F.col(f"`{id_col}`").cast("long").alias("__id"), F.col(f"`{text_col}`").alias("__text")]
    if carry:
        cols.append(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != text_col]).alias("__row"))
    return df.select(*cols)


def restored(df: DataFrame, like: DataFrame, text_col: str, text: Column) -> DataFrame:
    """The columns of ``like`` again, out of ``__row``, with ``text`` as the text column."""
    return df.select(*[(text if c == text_col else F.col(f"__row.`{c}`")).alias(c) for c in like.columns])


#: Most bytes of texts that Spark hands to a Python worker at once; long texts make batches of fewer rows.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Hold Arrow batches to BATCH_BYTES in this session, unless they are held to less already."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    value = spark.conf.get(key) or ""
    if not value.isdigit() or int(value) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


#: What empties the caches that an operator keeps in a Python worker, by operator.
CACHES: dict[str, Callable[[], None]] = {}


def enter(owner: str) -> None:
    """Workers outlive a stage: the caches of other operators go before this one's work begins."""
    for name, clear in CACHES.items():
        if name != owner:
            clear()


def leave() -> None:
    """Give freed memory back to the system, which otherwise counts against the executor while the worker idles."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def tidy(owner: str, run):
    """``run``, a function of batches for mapInArrow, between ``enter`` and ``leave``."""

    def wrapped(batches):
        enter(owner)
        try:
            yield from run(batches)
        finally:
            leave()

    return wrapped


def tidy_group(owner: str, run):
    """The same for a function of one group or two cogroups."""

    def one(key, table):
        enter(owner)
        try:
            return run(key, table)
        finally:
            leave()

    def two(key, left, right):
        enter(owner)
        try:
            return run(key, left, right)
        finally:
            leave()

    return two if run.__code__.co_argcount == 3 else one
