"""Stored edges of both directions with their ranks, in files by adjacency."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions.canonical import utf16_key
from factloom.operators.facts import LARGE, ranks_of_large
from factloom.operators.graph import both_directions
from factloom.sources.sorted_files import SortedFiles

ADJACENCY = ["direction", "anchor", "relation"]


class RankedEdges:
    """direction, anchor, relation, rank, far, occ_id, sorted by the first four: a page of an adjacency is a range of keys."""

    def __init__(self, spark: SparkSession, path: str, rows_per_file: int = 500_000):
        schema = "direction string, anchor string, relation string, rank int, far string, occ_id long"
        self.table = SortedFiles(spark, path, schema, [*ADJACENCY, "rank"], rows_per_file)

    def add(self, edges: DataFrame) -> dict[str, int]:
        """Adds edges (occ_id, subject, relation, object): adjacencies that they touch are ranked anew, files that hold these rewritten, all others stay. Occurrences that are there already, in an adjacency that is touched, aren't added twice."""
        return self.table.merge(both_directions(edges), self._joined, ADJACENCY)

    @staticmethod
    def _joined(old: DataFrame, batch: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame] | None]:
        """Rows of both; ranks of the batch's adjacencies are made where these are dealt to, unless one is too large for a task."""
        both = old.unionByName(batch.withColumn("rank", F.lit(None).cast("int")))
        large = lambda *keys: not both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LARGE).isEmpty()
        # counts by hash first, as numbers are counted faster; they are never too low
        if not (large(F.xxhash64(*ADJACENCY).bitwiseAND(F.lit(0xFFFF))) and large(*ADJACENCY)):
            return both, RankedEdges._ranked
        touched = batch.select(*ADJACENCY).distinct()
        own = old.drop("rank").join(touched, ADJACENCY, "left_semi")
        new = batch.dropDuplicates([*ADJACENCY, "occ_id"]).join(own.select(*ADJACENCY, "occ_id"), [*ADJACENCY, "occ_id"], "left_anti")
        way = F.concat("direction", F.lit(" "), "relation")
        ranked = ranks_of_large(own.unionByName(new).withColumn("way", way), "anchor", "far", "occ_id", relation="way").drop("way")
        return old.join(touched, ADJACENCY, "left_anti").unionByName(ranked.withColumn("rank", F.col("rank").cast("int"))), None

    @staticmethod
    def _ranked(rows: DataFrame) -> DataFrame:
        """Ranks of adjacencies with rows of a batch, of which each occurrence stays once; all others keep theirs. Rows come dealt by adjacency, so one sort in their tasks is all."""
        keyed = rows.withColumn("_key", utf16_key(F.col("far")))
        whole = Window.partitionBy("segment", *ADJACENCY)
        order = whole.orderBy("_key", "occ_id")
        same = (F.row_number().over(order) > 1) & F.lag("occ_id").over(order).eqNullSafe(F.col("occ_id")) & F.lag("_key").over(order).eqNullSafe(F.col("_key"))
        touched = F.max(F.col("rank").isNull()).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        placed = keyed.select("*", F.dense_rank().over(order).alias("_place"), touched.alias("_touched"), same.alias("_copy")).where("not (_copy and _touched)")
        return placed.withColumn("rank", F.when(F.col("_touched"), F.col("_place")).otherwise(F.col("rank"))).drop("_key", "_place", "_touched", "_copy")

    def page(self, anchor: str, relation: str, direction: str = "OUT", after: int = 0, limit: int = 20) -> DataFrame:
        """Up to `limit` rows of an adjacency behind a rank: ranks are dense, so both ends of the page are keys."""
        own = (direction, anchor, relation)
        return self.table.first(limit, low=(*own, after + 1), high=(*own, after + limit + 1))

    def edges_of(self, anchors: list[str]) -> DataFrame:
        """Rows of the files that hold these anchors, in either direction."""
        asked = self.table.spark.createDataFrame([(d, a) for a in anchors for d in ("IN", "OUT")], "direction string, anchor string")
        return self.table.read(self.table.holding(asked, ADJACENCY[:2]))

    def edges(self) -> DataFrame:
        return self.table.all()
