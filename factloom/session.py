"""What a session needs before Python tasks of this package run in it."""

from __future__ import annotations

import functools
import os
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a batch between Spark and Python. Spark's own bound (64 MB) lets a batch of long texts, and its copies on both sides, fill an executor.
BATCH_BYTES = 1 << 20
_SHARED = "spark.factloom.shared"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

#: What keeps freed memory from staying with idle Python workers: the C library's allocator for Arrow, with few arenas.
WORKERS = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2"}

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def importable(spark: SparkSession) -> SparkSession:
    """Adds this package's folder to the path of Python workers, however the session was started, and keeps batches and workers small unless the session says otherwise."""
    if re.fullmatch(r"67108864b?|64mb?", spark.conf.get(_BATCH).lower()):
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    environment = spark.sparkContext.environment
    parts = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in parts:
        environment["PYTHONPATH"] = os.pathsep.join([*parts, _ROOT])
    for name, value in WORKERS.items():
        environment.setdefault(name, value)
    return spark


def shared_base(spark: SparkSession) -> str:
    """The folder that all machines share, also set for checkpoints: spark.checkpoint.dir. Where that is unset, one of our own if driver and tasks are one process; on a cluster that is an error."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or spark.conf.get(_SHARED, None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = f"file://{tempfile.mkdtemp(prefix='factloom-')}"
        spark.conf.set(_SHARED, base)
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(base)
    return base


def cut(df: DataFrame, purpose: str = "step") -> DataFrame:
    """df as a table in the shared folder: computed once, with no lineage behind it."""
    path = f"{shared_base(df.sparkSession).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a narrow table that a task groups or sorts.
TASK_ROWS = 500_000


def parts_of(rows: int, spark: SparkSession, most: int = TASK_ROWS) -> int:
    """Into how many partitions so many rows go, at most `most` each, so that a task's share doesn't grow with them."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // most))


def ready(f: Callable) -> Callable:
    """f(spark, ...) in a session whose workers can import this package."""

    @functools.wraps(f)
    def call(spark: SparkSession, *args):
        return f(importable(spark), *args)

    return call
