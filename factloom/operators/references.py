"""Searching references: families, prefix, name, contained text, and keyset pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import names
from factloom.functions.canonical import reference_hash


def references(facts: DataFrame) -> DataFrame:
    """The index: each reference that facts name, its type, hash and search key."""
    named = facts.select(F.explode(F.array("subject", "object")).alias("reference")).where("reference is not null").distinct()
    keyed = named.withColumn("_key", names.key_of(F.col("reference")))
    return names.with_folded(keyed, "_key", "search_key").select("reference", names.kind_of(F.col("reference")).alias("type"), reference_hash(F.col("reference")).alias("reference_hash"), "search_key")


def families(index: DataFrame) -> DataFrame:
    """References by type, the most frequent first."""
    return index.groupBy("type").agg(F.count(F.lit(1)).alias("references")).orderBy(F.desc("references"), "type")


def page(rows: DataFrame, keys: list[str], after: tuple | None, limit: int | None) -> DataFrame:
    """Keyset page: up to limit + 1 rows behind a key (all without a limit); the one more tells whether there is a next page."""
    if after is not None:
        later: Column = F.lit(False)
        equal: Column = F.lit(True)
        for k, v in zip(keys, after, strict=True):
            later = later | (equal & (F.col(k) > F.lit(v)))
            equal = equal & (F.col(k) == F.lit(v))
        rows = rows.where(later)
    return rows if limit is None else rows.orderBy(*keys).limit(limit + 1)


def by_prefix(index: DataFrame, text: str, kind: str | None = None, after: tuple[str, str] | None = None, limit: int = 50) -> DataFrame:
    rows = index.where(F.col("search_key").startswith(names.prefix(text)))
    return page(rows if kind is None else rows.where(F.col("type") == kind), ["search_key", "reference_hash"], after, limit)


def name_index(index: DataFrame) -> DataFrame:
    """A row for each name of a reference."""
    return index.select("reference", "reference_hash", "type", F.explode(names.name_keys(F.col("reference"))).alias("name_key"))


def by_name(named: DataFrame, text: str, kind: str | None = None, after: str | None = None, limit: int | None = 50) -> DataFrame:
    rows = named.where(F.col("name_key") == names.name(text))
    return page(rows if kind is None else rows.where(F.col("type") == kind), ["reference_hash"], None if after is None else (after,), limit)


def containing(index: DataFrame, text: str, after: tuple[str, str] | None = None, limit: int = 50, scan: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """Matches among the next `scan` references in key order (up to limit + 1), and one row of how far the scan came: scanned, search_key, reference_hash (where to go on; null at the end).

    The bound on what is read is the operator's meaning: a caller continues from the bound,
    even if a page holds no match.
    """
    read = page(index, ["search_key", "reference_hash"], after, scan)
    some = F.row_number().over(Window.orderBy("search_key", "reference_hash"))  # scan + 1 rows at most
    read = read.withColumn("_n", some)
    rows = read.where((F.col("_n") <= scan) & F.contains("search_key", F.lit(names.prefix(text)))).drop("_n").orderBy("search_key", "reference_hash").limit(limit + 1)
    more = F.max("_n") > scan
    last = F.max(F.when(F.col("_n") <= scan, F.struct("search_key", "reference_hash")))
    return rows, read.agg(F.least(F.count(F.lit(1)), F.lit(scan)).alias("scanned"), F.when(more, last["search_key"]).alias("search_key"), F.when(more, last["reference_hash"]).alias("reference_hash"))


def all_containing(index: DataFrame, text: str) -> DataFrame:
    """Every match: what a caller gets that follows the bounds to the end, in one pass."""
    return index.where(F.contains("search_key", F.lit(names.prefix(text))))
