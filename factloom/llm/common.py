"""Helpers that several operators share: shared folders, input columns, ragged arrays, blocks of text."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.session import shared_base

#: Characters with the Unicode property White_Space (fixed values).
WHITE_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: Bytes of text that a task holds as one block.
BLOCK_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_open: list[list[str]] = []


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path in the folder that all machines share. Within scratch() it goes at the end."""
    path = f"{shared_base(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    return path


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are written inside go at the end: for steps whose result is written to a path made outside."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            discard(spark, path)


def discard(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, path: str, **options: str) -> DataFrame:
    """df as a Parquet table at path, so that later steps neither recompute it nor depend on one executor."""
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts(documents: DataFrame) -> DataFrame:
    """doc_id (long) and text, with null texts as empty ones; all other columns are left out, so none can clash."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def blocks(batches: Iterable[pa.RecordBatch], most: int = BLOCK_BYTES, column: str = "text") -> Iterator[pa.Table]:
    """The same rows in tables of about `most` bytes of text (one longer text stands alone), whatever the sizes of the batches."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
        ends = np.cumsum(lengths, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + most - size, side="right")))
            held.append(batch.slice(start, stop - start))
            size += int(ends[stop - 1] - done)
            start = stop
            if size >= most:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
    held = []
    release()


def release() -> None:
    """Hands freed memory back: a Python worker outlives its task, and what it keeps is lost to the tasks of others."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def column(rows: pa.Table, name: str) -> pa.Array:
    """A column in one piece, with 64-bit offsets for strings so that no block can be too long."""
    whole = rows.column(name)
    if pa.types.is_string(whole.type):
        whole = whole.cast(pa.large_string())
    return whole.chunk(0) if whole.num_chunks == 1 else pa.concat_arrays(whole.chunks)


#: Bits of a filter over hashes: its size is fixed, whatever it was made from.
FILTER_BITS = 1 << 24


def bit_filter(hashes: DataFrame, size: int = FILTER_BITS) -> bytes:
    """So many bits, those of the column hash (a long) set: gathered as 64-bit words, of which there is a fixed number at most."""
    place = F.col("hash").bitwiseAND(F.lit(size - 1))
    words = hashes.select((place / 64).cast("int").alias("w"), (place % 64).cast("int").alias("at")).groupBy("w").agg(F.expr("bit_or(shiftleft(1L, at))").alias("bits")).toArrow()
    out = np.zeros(size // 64, dtype="<i8")
    out[np.asarray(words.column("w"))] = np.asarray(words.column("bits"))
    return out.tobytes()


def held_bits(kept, hashes):
    """Whether a broadcast filter has these hashes (one, or an array of unsigned longs)."""
    bits = np.frombuffer(kept.value, "u1")
    places = np.asarray(hashes, dtype="<u8") & np.uint64(8 * len(bits) - 1)
    return (bits[(places >> np.uint64(3)).astype(np.int64)] >> (places & np.uint64(7)).astype("u1")) & 1 == 1


def ragged_take(offsets: np.ndarray, values: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists number `picks` of a ragged array, end to end, and how long each is."""
    lengths = (offsets[1:] - offsets[:-1])[picks]
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    where = np.arange(total, dtype=np.int64) + np.repeat(offsets[:-1][picks] - (ends - lengths), lengths)
    return values[where], lengths


def bounds(lengths: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def per_list_sum(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of the given lengths; 0 for a run of none."""
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    ends = np.cumsum(lengths)
    return total[ends] - total[ends - lengths]
