"""A kept index of references: by search key for prefixes and contained text, by name for the ends of keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import names
from factloom.operators import references
from factloom.sources.sorted_files import SortedFiles


class ReferenceIndex:
    """References in order of (search_key, reference_hash), and their names in order of (name_key, reference_hash).

    A search reads the files of its range alone: as many as its page needs, however large
    the index is. An update reads and rewrites only files that new references fall into.
    """

    def __init__(self, spark: SparkSession, path: str, rows_per_file: int = 500_000):
        self.keyed = SortedFiles(spark, f"{path}/references", "search_key string, reference_hash string, reference string, type string", ["search_key", "reference_hash"], rows_per_file)
        self.named = SortedFiles(spark, f"{path}/names", "name_key string, reference_hash string, reference string, type string", ["name_key", "reference_hash"], rows_per_file)

    def update(self, index: DataFrame) -> dict[str, int]:
        """Adds references (as references() gives them) that the index doesn't hold; what became of its files."""
        new = self.keyed.missing(index.select(*self.keyed.schema.names))
        rows = references.name_index(new).dropDuplicates(["name_key", "reference_hash"]).select(*self.named.schema.names)
        self.named.merge(rows)  # first: a reference that is there has its names
        return self.keyed.merge(new)

    def by_prefix(self, text: str, kind: str | None = None, after: tuple[str, str] | None = None, limit: int = 50) -> DataFrame:
        """Up to limit + 1 references whose key begins with the text, behind a key."""
        low = names.prefix(text)
        high = names.successor(low)
        return self.keyed.first(limit + 1, low=(low,), high=high and (high,), after=after, where=None if kind is None else F.col("type") == kind)

    def by_name(self, text: str, kind: str | None = None, after: str | None = None, limit: int = 50) -> DataFrame:
        """Up to limit + 1 references that have this name."""
        key = names.name(text)
        return self.named.first(limit + 1, low=(key,), high=(key + "\0",), after=after and (key, after), where=None if kind is None else F.col("type") == kind)

    def containing(self, text: str, after: tuple[str, str] | None = None, limit: int = 50, scan: int = 20_000) -> tuple[DataFrame, DataFrame]:
        """references.containing() over the next `scan` references, from the files that hold them."""
        return references.containing(self.keyed.first(scan + 1, after=after), text, None, limit, scan)
