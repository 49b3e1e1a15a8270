"""Facts derived from the star-schema, document, conversation and event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ref(kind: str, key: Column | str) -> Column:
    """A reference, kind:key."""
    return F.concat(F.lit(f"{kind}:"), (F.col(key) if isinstance(key, str) else key).cast("string"))


def assertion(rows: DataFrame, subject: Column, relation: str, obj: Column, producer: str, *extra: Column) -> DataFrame:
    return rows.select(F.lit("ASSERTION").alias("kind"), subject.alias("subject"), F.lit(relation).alias("relation"), obj.alias("object"), F.lit(producer).alias("producer_id"), *extra)


def supplied_by(spark: SparkSession, sf_dir: str, *extra: Column) -> DataFrame:
    return assertion(table(spark, sf_dir, "lineitem"), ref("part", "l_partkey"), "SUPPLIED_BY", ref("supplier", "l_suppkey"), "lineitem", *extra)


def placed_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assertion(table(spark, sf_dir, "orders"), ref("order", "o_orderkey"), "PLACED_BY", ref("customer", "o_custkey"), "orders")


def located(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = assertion(table(spark, sf_dir, "customer"), ref("customer", "c_custkey"), "IN_NATION", ref("nation", "c_nationkey"), "places")
    supplier = assertion(table(spark, sf_dir, "supplier"), ref("supplier", "s_suppkey"), "IN_NATION", ref("nation", "s_nationkey"), "places")
    nation = assertion(table(spark, sf_dir, "nation"), ref("nation", "n_nationkey"), "IN_REGION", ref("region", "n_regionkey"), "places")
    return customer.unionByName(supplier).unionByName(nation)


def written_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assertion(table(spark, sf_dir, "documents"), ref("document", "doc_id"), "WRITTEN_IN", ref("language", "lang"), "inventory")


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A coverage row for each document: ANALYSED if it has a label, else NOT_INTERPRETED."""
    labels = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("seen", F.lit(True))
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(labels, "doc_id", "left")
    return rows.select(
        F.lit("COVERAGE").alias("kind"),
        ref("document", "doc_id").alias("subject"),
        F.when(F.col("seen"), "ANALYSED").otherwise("NOT_INTERPRETED").alias("coverage_type"),
        F.col("lang").alias("language"),
        F.col("source").alias("producer_id"),
    )


def conversations_as_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn as a child of the one before it: child, parent, role."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return rows.where("turn > 0").select("conv_id", F.col("turn").alias("child"), (F.col("turn") - 1).alias("parent"), "role")
