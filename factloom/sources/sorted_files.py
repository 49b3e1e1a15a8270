"""Tables in key order: files that hold a range of keys each, with their bounds in a manifest.

A lookup reads the manifest and the few files whose range it needs. A batch rewrites the
files that its keys fall into and no others, and a new manifest takes the place of the
former one in a log, so readers see all of a batch or nothing.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.session import cut
from factloom.sources.commits import CommitLog, Conflict

#: Rows that a task of a merge sorts; it writes them as several files.
TASK_ROWS = 1_000_000
#: Files of a table: their bounds go to every task of a merge. A table beyond it needs more rows a file.
MOST_FILES = 100_000


class SortedFiles:
    """A table of `schema`, sorted by `keys` (strings and numbers, never null), that no two rows share."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], rows_per_file: int = 500_000):
        self.spark, self.path, self.keys, self.rows_per_file = spark, path.rstrip("/"), keys, rows_per_file
        self.schema = spark.createDataFrame([], schema).schema
        self.log = CommitLog(spark, f"{self.path}/log")
        #: Files that the last lookup opened.
        self.opened: list[str] = []
        bound = T.StructType([self.schema[k] for k in keys])
        self._manifest = T.StructType([T.StructField("file", T.StringType()), T.StructField("low", bound), T.StructField("high", bound), T.StructField("rows", T.LongType())])

    def files(self) -> DataFrame:
        """file (below path), low, high, rows of the latest manifest."""
        _, entry = self.log.last()
        if entry is None:
            return self.spark.createDataFrame([], self._manifest)
        return self.spark.read.schema(self._manifest).parquet(f"{self.path}/{entry['manifest']}")

    def read(self, files: list[str]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{f}" for f in files))

    def all(self) -> DataFrame:
        return self.read([r.file for r in self._listed()])

    def _listed(self) -> list:
        rows = self.files().orderBy("low").limit(MOST_FILES + 1).collect()
        if len(rows) > MOST_FILES:
            raise ValueError(f"more than {MOST_FILES} files: give more rows to a file")
        return rows

    def _tuple(self, values: tuple, of: str | None = None) -> tuple[Column, Column]:
        """As many key columns as there are values, and the values, as two structs that compare."""
        names = self.keys[: len(values)]
        own = F.struct(*(F.col(f"{of}.{k}" if of else k).alias(k) for k in names))
        return own, F.struct(*(F.lit(v).cast(self.schema[k].dataType).alias(k) for k, v in zip(names, values, strict=True)))

    def _within(self, low: tuple | None, high: tuple | None, after: tuple | None) -> Column:
        """low <= key < high and key > after; a bound may be of the first keys alone."""
        out = F.lit(True)
        for values, test in ((low, Column.__ge__), (high, Column.__lt__), (after, Column.__gt__)):
            if values is not None:
                out = out & test(*self._tuple(values))
        return out

    def _ranges(self, low: tuple | None, high: tuple | None, after: tuple | None) -> DataFrame:
        out = self.files()
        for values, of, test in ((low, "high", Column.__ge__), (high, "low", Column.__lt__), (after, "high", Column.__gt__)):
            if values is not None:
                out = out.where(test(*self._tuple(values, of)))
        return out.orderBy("low")

    def first(self, count: int, low: tuple | None = None, high: tuple | None = None, after: tuple | None = None, where: Column | None = None) -> DataFrame:
        """The first `count` rows of a range in key order, from as few files as hold them.

        Without a condition the manifest tells how many: the first file may hold few of the
        range, all between hold nothing else. With one more files are opened while rows are missing.
        """
        ranges, take, inside = self._ranges(low, high, after), 4, self._within(low, high, after)
        if where is None:
            while True:
                some = ranges.limit(take).collect()
                sums = 0
                for k, r in enumerate(some):
                    if sums >= count:
                        some = some[:k]
                        break
                    sums += r["rows"] if k else 0
                else:
                    if len(some) == take:
                        take *= 4
                        continue
                break
            self.opened = [r.file for r in some]
            return self.read(self.opened).where(inside).orderBy(*self.keys).limit(count)
        found: list = []
        self.opened, at = [], 0
        while len(found) < count:
            some = ranges.offset(at).limit(take).collect()
            self.opened += [r.file for r in some]
            found += self.read([r.file for r in some]).where(inside & where).orderBy(*self.keys).limit(count - len(found)).collect()
            if len(some) < take:
                break
            at, take = at + take, take * 4
        return self.spark.createDataFrame(found, self.schema)

    def _routed(self, rows: DataFrame, lows: list[tuple], highs: list[tuple], group: list[str]) -> DataFrame:
        """Places of the files (one row each) that hold, or would hold, keys of the rows by their first columns."""
        width = len(group)
        starts, ends = [x[:width] for x in lows], [x[:width] for x in highs]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hit: set[int] = set()
            for batch in batches:
                for key in set(zip(*(batch.column(k).to_pylist() for k in group), strict=True)):
                    last = bisect_right(starts, key) - 1
                    hit.update(range(max(0, min(bisect_left(ends, key), last)), max(0, last) + 1))
            yield pa.RecordBatch.from_arrays([pa.array(sorted(hit), pa.int32())], names=["at"])

        return rows.select(*group).distinct().mapInArrow(run, "at int").distinct()

    def holding(self, rows: DataFrame, group: list[str] | None = None) -> list[str]:
        """Files whose ranges the rows' keys (or the first columns of them) fall into."""
        listed = self._listed()
        at = self._routed(rows, [tuple(r.low) for r in listed], [tuple(r.high) for r in listed], group or self.keys).collect() if listed else []
        return [listed[r["at"]].file for r in sorted(at)]

    def missing(self, rows: DataFrame) -> DataFrame:
        """The rows whose keys the table doesn't hold, each key once; only files that could hold them are read, and of these the keys."""
        return rows.dropDuplicates(self.keys).join(self.read(self.holding(rows)).select(*self.keys), self.keys, "left_anti")

    def merge(self, batch: DataFrame, combine: Callable[[DataFrame, DataFrame], tuple[DataFrame, Callable[[DataFrame], DataFrame] | None]] | None = None, group: list[str] | None = None, tries: int = 10) -> dict[str, int]:
        """Adds a batch: files that it falls into are rewritten as what combine(their rows, batch) gives, by default both without keys that are there.

        group: the first key columns by which a batch finds its files, where it doesn't have
        all keys. Files of neighbouring ranges are rewritten together, in files of
        rows_per_file rows at most; ranges of files never overlap. combine gives rows with None,
        or rows that may lack their last key and a function that makes it: it gets them dealt by
        ranges of (segment, group) and returns them in the order of segment and keys. If another
        writer is faster the merge is made anew on what it left. Returns numbers of files: kept, rewritten, written.
        """
        batch = cut(batch, "batch")
        size = batch.count()
        for _ in range(tries):
            number, _ = self.log.last()
            listed = self._listed() if number else []
            if not size:
                return {"kept": len(listed), "rewritten": 0, "written": 0}
            lows, highs = [tuple(r.low) for r in listed], [tuple(r.high) for r in listed]
            hit = sorted(r["at"] for r in self._routed(batch, lows, highs, group or self.keys).collect()) if listed else []
            old = self.read([listed[k].file for k in hit])
            new, finish = (combine or self._added)(old, batch)
            folder = f"data-{uuid.uuid4().hex}"
            count = size + sum(listed[k]["rows"] for k in hit)
            # a task's rows are in order, so the files that it cuts them into are ranges too
            parts = max(1, -(-count // max(TASK_ROWS, self.rows_per_file)))
            placed = self._segments(new.select(*self.schema.names), lows, hit, len(group or self.keys))
            dealt = placed.repartitionByRange(parts, "segment", *(group if finish else self.keys))
            dealt = finish(dealt) if finish else dealt.sortWithinPartitions("segment", *self.keys)
            dealt.write.option("maxRecordsPerFile", self.rows_per_file).partitionBy("segment").parquet(f"{self.path}/{folder}")
            made = self._bounds(folder)
            stay = [tuple(r) for k, r in enumerate(listed) if k not in set(hit)]
            manifest = f"manifest-{uuid.uuid4().hex}"
            self.spark.createDataFrame([*stay, *made], self._manifest).coalesce(1).write.parquet(f"{self.path}/{manifest}")
            if self.log.append(number, {"manifest": manifest, "kept": len(stay), "rewritten": len(hit), "written": len(made)}):
                return {"kept": len(stay), "rewritten": len(hit), "written": len(made)}
        raise Conflict(f"{self.path}: others were faster {tries} times")

    def _added(self, old: DataFrame, batch: DataFrame) -> tuple[DataFrame, None]:
        return old.unionByName(batch.dropDuplicates(self.keys).join(old.select(*self.keys), self.keys, "left_anti").select(*self.schema.names)), None

    def _segments(self, rows: DataFrame, lows: list[tuple], hit: list[int], width: int) -> DataFrame:
        """With `segment`: neighbouring rewritten files are one; a file of the result never spans a file that stays. Rows whose last key is still to be made go where their first `width` keys are."""
        of: dict[int, int] = {}
        for k in hit:
            of[k] = of[k - 1] if k - 1 in of else len(set(of.values()))
        keys, starts = self.keys, [x[:width] for x in lows]
        if len(set(of.values())) < 2:
            return rows.withColumn("segment", F.lit(0))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = [of[max(0, (bisect_right(starts, key[:width]) if key[-1] is None else bisect_right(lows, key)) - 1)] for key in zip(*(batch.column(k).to_pylist() for k in keys), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32())], names=[*batch.schema.names, "segment"])

        return rows.mapInArrow(run, T.StructType([*self.schema.fields, T.StructField("segment", T.IntegerType())]))

    def _bounds(self, folder: str) -> list[tuple]:
        """A row a file: files are in order, so their first and last rows are their bounds."""
        rows = self.spark.read.schema(self.schema).parquet(f"{self.path}/{folder}")
        place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")]
        sizes = {r.file: r["rows"] for r in rows.select(place[0]).groupBy("file").agg(F.count(F.lit(1)).alias("rows")).collect()}
        wanted = self.spark.createDataFrame([(f, at) for f, n in sizes.items() for at in {0, n - 1}], "file string, at long")
        ends = {(r.file, r["at"]): tuple(r[k] for k in self.keys) for r in rows.select(*place, *self.keys).join(F.broadcast(wanted), ["file", "at"]).collect()}
        return [(f"{folder}/{f.rsplit(f'/{folder}/', 1)[1]}", ends[f, 0], ends[f, n - 1], n) for f, n in sizes.items()]
