"""Sending what fits: the longest prefix within a budget, short references, pages of source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.session import cut


def prefix(rows: DataFrame, order: list[str], size: Column, budget: int, ranges: int | None = None) -> DataFrame:
    """The rows of the longest prefix whose sizes add up to the budget at most, with used, the sum so far.

    Rows are dealt by sampled ranges of the order columns, of any type, so that no task orders all:
    ranges before the one where the budget ends are taken whole, and the running sum is
    made within ranges. Equal rows of the order columns stay together.
    """
    n = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sized = rows.withColumn("_size", size)
    dealt = cut(sized.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "prefix") if n > 1 else sized.withColumn("_range", F.lit(0))
    sums = dealt.groupBy("_range").agg(F.sum("_size").alias("_sum"))  # a row for each range
    before = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where(F.col("_before") <= budget).select("_range", "_before")
    running = F.sum("_size").over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.join(F.broadcast(before), "_range").withColumn("used", F.col("_before") + running).where(F.col("used") <= budget).drop("_size", "_range", "_before")


def with_size(envelope: Column, field: str = "bytes") -> Column:
    """A JSON object's text with a last field that holds the UTF-8 size of the whole, that field included: a number of k digits fits if the rest and k add up to one of k digits."""
    rest = F.octet_length(envelope) + F.when(envelope == "{}", 0).otherwise(1) + len(f'"{field}":')
    size = F.coalesce(*[F.when(F.length((rest + k).cast("string")) == k, rest + k) for k in range(1, 12)])
    return F.concat(F.substr(envelope, F.lit(1), F.length(envelope) - 1), F.when(envelope == "{}", "").otherwise(","), F.lit(f'"{field}":'), size.cast("string"), F.lit("}"))


def counted_prefix(rows: DataFrame, order: list[str], size: Column, budget: int) -> DataFrame:
    """sent and not_sent: how many rows fit, and how many don't."""
    sent = prefix(rows, order, size, budget).agg(F.count(F.lit(1)).alias("sent"))
    return sent.join(F.broadcast(rows.agg(F.count(F.lit(1)).alias("n"))), F.lit(True)).select("sent", (F.col("n") - F.col("sent")).alias("not_sent"))


def short_references(sent: DataFrame, key: str, letter: str = "F") -> DataFrame:
    """key, short: F1, F2 ... in the order of first appearance (column seq), numbered range by range."""
    first = prefix(sent.groupBy(key).agg(F.min("seq").alias("seq")), ["seq", key], F.lit(1).cast("long"), 2**62)
    return first.select(key, F.concat(F.lit(letter), F.col("used").cast("string")).alias("short"))


def compact(sent: DataFrame, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with the key of their combination of common fields in place of these, and the table of combinations."""
    keyed = sent.withColumn("common", F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256))
    return keyed.drop(*fields), keyed.select("common", *fields).dropDuplicates(["common"])


def expand(rows: DataFrame, common: DataFrame) -> DataFrame:
    """The inverse of compact()."""
    return rows.join(common, "common").drop("common")


def briefing(facts: DataFrame, order: list[str], size: Column, budget: int, most: int = 200) -> DataFrame:
    """The longest prefix of at most `most` facts that fits the budget."""
    return prefix(facts.orderBy(*order).limit(most), order, size, budget, ranges=1)


def source_piece(lines: Column, first: int, most_lines: int = 200, most_bytes: int = 16_384) -> Column:
    """Whole lines from a place on that fit both limits; a piece that is cut never ends in blank lines."""
    part = F.slice(lines, first, most_lines)
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("bytes"))
    step = lambda a, line: F.struct(F.when(a["bytes"] + F.octet_length(line) + 1 <= most_bytes, a["n"] + 1).otherwise(a["n"]).alias("n"), (a["bytes"] + F.octet_length(line) + 1).cast("int").alias("bytes"))
    kept = F.slice(part, F.lit(1), F.aggregate(part, start, step)["n"])
    cut = F.size(kept) < F.size(lines) - first + 1
    trimmed = F.regexp_replace(F.array_join(kept, "\n"), r"\s*$", "")
    return F.when(cut, trimmed).otherwise(F.array_join(kept, "\n"))
