"""Sharding by fixed virtual slots.

A record's hash decides its virtual slot, one of some thousands, for good. Bytes
are summed by slot; a slot-to-shard map, kept as a versioned table, deals slots
to shards of nearly equal bytes. Rebalancing edits the map: it moves slots, never
single records, and writes the next version.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.common import shared_dir, written

#: Virtual slots. The map and the table of sums have at most so many rows, whatever the input.
SLOTS = 8192
_MAP = "version int, vslot int, shard int, bytes long, rows long"


def with_slots(documents: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text plus 16; null: 16), text_crc32 (null: of no bytes) and vslot.

    The slot comes from doc_id and content, so neither repeated ids nor repeated texts
    meet in one slot unless they agree in both. Of equal rows the first of each part of the
    table goes by that hash, each further one by the hash with its number in the part, so
    many equal rows fill many slots. Nulls hash like any value.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = rows.withColumn("part", F.spark_partition_id())
    copy = F.row_number().over(Window.partitionBy("part", "doc_id", "text_crc32", "size").orderBy(F.lit(0)))
    own = F.when(F.col("copy") == 1, F.xxhash64("doc_id", "text_crc32")).otherwise(F.xxhash64("doc_id", "text_crc32", "copy"))
    return rows.withColumn("copy", copy).withColumn("vslot", F.pmod(own, F.lit(slots)).cast("int")).drop("copy", "part")


def slot_sums(slotted: DataFrame, slots: int = SLOTS) -> DataFrame:
    """vslot, bytes, rows of every slot, also of those without a record."""
    sums = slotted.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    every = slotted.sparkSession.range(slots).select(F.col("id").cast("int").alias("vslot"))
    return every.join(sums, "vslot", "left").fillna(0, ["bytes", "rows"])


def deal(sums: list[tuple[int, int]], shards: int) -> dict[int, int]:
    """(slot, bytes) -> shard of each slot: the largest slots first, each to the shard with the fewest bytes; slots without any are dealt by turns, for records to come."""
    heap = [(0, s) for s in range(shards)]
    out, empty = {}, 0
    for slot, size in sorted(sums, key=lambda x: (-x[1], x[0])):
        if not size:
            out[slot], empty = empty % shards, empty + 1
            continue
        held, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (held + size, shard))
    return out


def grow(sums: list[tuple[int, int]], placed: dict[int, int], shards: int) -> dict[int, int]:
    """The map edited for one more shard: slots move into it alone, from the fullest shards, until it has its share."""
    size = dict(sums)
    held = dict.fromkeys(range(shards), 0)
    own: dict[int, list[tuple[int, int]]] = {s: [] for s in held}
    for slot, shard in placed.items():
        held[shard] += size.get(slot, 0)
        own[shard].append((size.get(slot, 0), slot))
    for slots in own.values():
        slots.sort(reverse=True)
    share, new, out = sum(held.values()) / (shards + 1), 0, dict(placed)
    for k, slot in enumerate(sorted(s for s in placed if not size.get(s))):
        if k % (shards + 1) == shards:  # its share of slots without bytes
            out[slot] = shards
    heap = [(-b, s) for s, b in held.items()]
    heapq.heapify(heap)
    while heap:
        _, shard = heapq.heappop(heap)
        k = next((i for i, (b, _) in enumerate(own[shard]) if 0 < b <= share - new and held[shard] - b >= new - b), None)
        if k is None or held[shard] <= share:
            continue
        b, slot = own[shard].pop(k)
        out[slot] = shards
        new += b
        held[shard] -= b
        heapq.heappush(heap, (-held[shard], shard))
    return out


def store_map(spark: SparkSession, path: str, version: int, sums: list[tuple[int, int, int]], placed: dict[int, int]) -> None:
    """Adds a version of the map to the table at path; earlier versions stay."""
    rows = [(version, slot, placed[slot], size, n) for slot, size, n in sums]
    spark.createDataFrame(rows, _MAP).coalesce(1).write.mode("append").parquet(path)


def load_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema(_MAP).parquet(path).where(F.col("version") == version)


def make_map(documents: DataFrame, shards: int, path: str, slots: int = SLOTS) -> None:
    """Version 1 of the map at path: all slots, by the bytes that these documents put into them."""
    sums = _sums(documents, slots)
    store_map(documents.sparkSession, path, 1, sums, deal([(s, b) for s, b, _ in sums], shards))


def _sums(documents: DataFrame, slots: int) -> list[tuple[int, int, int]]:
    return [tuple(r) for r in slot_sums(with_slots(documents, slots), slots).collect()]  # `slots` rows


def grow_map(spark: SparkSession, path: str, version: int, shards: int, documents: DataFrame | None = None) -> None:
    """The next version of the map at path, for one shard more, by the bytes of these documents (without any: by those of the version)."""
    rows = load_map(spark, path, version).collect()  # a row for each slot
    sums = [(r.vslot, r.bytes, r["rows"]) for r in rows] if documents is None else _sums(documents, len(rows))
    after = grow([(s, b) for s, b, _ in sums], {r.vslot: r.shard for r in rows}, shards)
    store_map(spark, path, version + 1, sums, after)


def assign(documents: DataFrame, path: str, version: int = 1, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, vslot, shard, and slot: the record's place in its shard, without gaps.

    A shard's virtual slots stand one behind the other; a slot's records stand by the part
    of the table that they came from, and by rank in that part: so no task orders a shard,
    nor a slot that many equal rows fill. Places come from the counts of these documents,
    whichever ones the map was made of: none is lost and there is no gap. Repeated rows get
    places of their own; an empty table gives an empty result; other columns are ignored.
    """
    spark = documents.sparkSession
    # written, so that counts and ranks see the same parts
    rows = written(with_slots(documents, slots).withColumn("part", F.spark_partition_id()), shared_dir(spark, "slotted"))
    counts = written(rows.groupBy("vslot", "part").agg(F.count(F.lit(1)).alias("n")), shared_dir(spark, "slot-counts"))
    inside = counts.withColumn("inside", F.coalesce(F.sum("n").over(Window.partitionBy("vslot").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    own = counts.groupBy("vslot").agg(F.sum("n").alias("own"))  # a row for each slot
    placed = load_map(spark, path, version).join(own, "vslot", "left").fillna(0, ["own"]).withColumn("before", F.coalesce(F.sum("own").over(Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("vslot", "part").orderBy("doc_id", "text_crc32", "size"))
    ranked = rows.withColumn("rank", rank - 1).join(inside, ["vslot", "part"]).join(F.broadcast(placed.select("vslot", "shard", "before")), "vslot")  # a map has a row for each slot
    return ranked.select("doc_id", "size", "text_crc32", "vslot", "shard", (F.col("before") + F.col("inside") + F.col("rank")).cast("long").alias("slot"))


def moved(spark: SparkSession, path: str, version: int, to: int) -> DataFrame:
    """vslot, shard, next_shard: the maps of two versions side by side."""
    return load_map(spark, path, version).select("vslot", "shard").join(load_map(spark, path, to).select("vslot", F.col("shard").alias("next_shard")), "vslot")

