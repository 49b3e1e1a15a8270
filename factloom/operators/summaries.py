"""Aggregates over executions, coverage diagnostics, analyses and usage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.facts import unread

#: Categories of a diagnostic (fixed values).
DIAGNOSTICS = ("UNKNOWN", "AMBIGUOUS", "UNSUPPORTED", "OUT_OF_SCOPE")


def execution_summary(facts: DataFrame) -> DataFrame:
    """Facts and distinct subjects by relation."""
    return facts.groupBy("relation").agg(F.count(F.lit(1)).alias("facts"), F.countDistinct("subject").alias("subjects"))


def coverage_summary(coverage: DataFrame, samples: int = 5) -> DataFrame:
    """Coverage rows by type with the first `samples` subjects. The kept samples are bounded in each partial aggregate: ranks are cut before lists are made."""
    from pyspark.sql import Window

    ranked = coverage.select("coverage_type", "subject").distinct().withColumn("_n", F.row_number().over(Window.partitionBy("coverage_type").orderBy("subject"))).where(F.col("_n") <= samples)
    lists = ranked.groupBy("coverage_type").agg(F.array_sort(F.collect_list("subject")).alias("samples"))
    return coverage.groupBy("coverage_type").agg(F.count(F.lit(1)).alias("n")).join(lists, "coverage_type", "left")


def restitution(coverage: DataFrame) -> DataFrame:
    """Of diagnostics: sites proven, listed without proof, seen but not listed; and subjects that weren't read.

    coverage: subject, coverage_type, sites_seen, sites_listed, sites_proven.
    """
    return coverage.agg(
        F.coalesce(F.sum("sites_proven"), F.lit(0)).alias("proven"),
        F.coalesce(F.sum(F.greatest(F.col("sites_listed") - F.col("sites_proven"), F.lit(0))), F.lit(0)).alias("listed"),
        F.coalesce(F.sum(F.greatest(F.col("sites_seen") - F.col("sites_listed"), F.lit(0))), F.lit(0)).alias("unseen"),
        F.countDistinct(F.when(unread(), F.col("subject"))).alias("unread"),
    )


def diagnostic_counts(sites: DataFrame, truncated: bool) -> DataFrame:
    """category, precision, n: exact counts of what is there, or, if sites were cut off, at least so many of each of the four."""
    counts = sites.where("category is not null").groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    if not truncated:
        return counts.select("category", F.lit("EXACT").alias("precision"), "n")
    every = sites.sparkSession.createDataFrame([(c,) for c in DIAGNOSTICS], "category string")
    return every.join(counts, "category", "left").select("category", F.lit("AT_LEAST").alias("precision"), F.coalesce("n", F.lit(0)).alias("n"))


def unread_reasons(coverage: DataFrame) -> DataFrame:
    """Distinct, sorted reasons of unread coverage by subject; reasons is an array column."""
    return coverage.where(unread()).select("subject", F.explode_outer("reasons").alias("reason")).groupBy("subject").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))


def unknown_zones(coverage: DataFrame) -> DataFrame:
    return coverage.where(unread()).groupBy("producer_id").agg(F.countDistinct("subject").alias("unknown_zones"))


def analysis_choices(executions: DataFrame) -> DataFrame:
    """Of each analysis the number of facts and the producers that failed."""
    return executions.groupBy("analysis_id").agg(F.sum("facts").alias("fact_count"), F.array_sort(F.collect_set(F.when(F.col("status") == "FAILED", F.col("producer_id")))).alias("failed"))


def tile_metadata(elements: DataFrame) -> DataFrame:
    return elements.agg(F.countDistinct("commit").alias("commits"), F.array_sort(F.collect_set("producer_id")).alias("producers"))


def usage(calls: DataFrame) -> DataFrame:
    """Tokens by model."""
    return calls.groupBy("model").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.count(F.lit(1)).alias("calls"))


def totals(rows: DataFrame, by: str, category: str, value: str) -> DataFrame:
    """Sums by both columns and, with nulls in their place, over either and both."""
    return rows.rollup(by, category).agg(F.sum(value).alias(value))
