"""Comparing two analyses by fact identity, producer by producer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["identity_hash", "producer_id"]


def only(left: DataFrame, right: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Identities of the left side that the right one lacks."""
    return left.select(*dict.fromkeys([*keys, *(c for c in ("slot",) if c in left.columns)])).distinct().join(right.select(*keys).distinct(), keys, "left_anti")


def common(left: DataFrame, right: DataFrame, keys: list[str] = KEY) -> DataFrame:
    return left.select(*keys).distinct().join(right.select(*keys).distinct(), keys, "left_semi")


def added_removed(before: DataFrame, after: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Every identity of either side with ADDED, REMOVED or COMMON, from one aggregation of both sides."""
    sides = before.select(*keys, F.lit(1).alias("b"), F.lit(0).alias("a")).unionByName(after.select(*keys, F.lit(0).alias("b"), F.lit(1).alias("a")))
    found = sides.groupBy(*keys).agg(F.max("b").alias("b"), F.max("a").alias("a"))
    return found.select(*keys, F.when(F.col("b") == 0, "ADDED").when(F.col("a") == 0, "REMOVED").otherwise("COMMON").alias("category"))


def counts(changes: DataFrame, by: str | None = None) -> DataFrame:
    """Changes by category, and by another column if given; what is zero has no row."""
    return changes.groupBy(*([by] if by else []), "category").agg(F.count(F.lit(1)).alias("n"))


def pair_modified(removed: DataFrame, added: DataFrame, slot: list[str], value: str) -> DataFrame:
    """One removed and one added value of a slot are one modified fact: slot, before, after. Slots with more on a side pair nothing; null slots neither."""
    one = lambda df, name: df.where(" and ".join(f"{s} is not null" for s in slot)).groupBy(*slot).agg(F.min(value).alias(name), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    return one(removed, "before").join(one(added, "after"), slot)


def signals(before: DataFrame, after: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Of identities on both sides: what differs between their occurrences.

    Each side: keys, status, validity, evidence, content. Different numbers give
    OCCURRENCE_COUNT_CHANGED; single occurrences are compared part by part; several as
    multisets, by sums of their hashes, so an identity with very many fills no task.
    """

    def side(df: DataFrame, tag: str) -> DataFrame:
        evidence = F.col("evidence") if dict(df.dtypes)["evidence"].startswith(("array", "struct", "map")) else F.col("evidence").cast("string")
        shown = F.to_json(F.struct(evidence.alias("evidence")), {"ignoreNullFields": "false"})
        state = F.concat_ws("|", F.coalesce("status", F.lit("")), F.coalesce("validity", F.lit("")))
        # sums don't depend on an order: two of them tell multisets of occurrences apart
        digest = lambda seed: F.sum(F.xxhash64(F.lit(seed), shown, *[F.coalesce(c, F.lit("\0")) for c in ("status", "validity", "content")]).cast("decimal(38,0)"))
        return df.groupBy(*keys).agg(
            F.count(F.lit(1)).alias(f"n_{tag}"),
            F.struct(digest(1).alias("x"), digest(2).alias("y")).alias(f"all_{tag}"),
            F.min(F.xxhash64(shown)).alias(f"evidence_{tag}"),
            F.min(state).alias(f"state_{tag}"),
            F.min(F.coalesce("content", F.lit(""))).alias(f"content_{tag}"),
        )

    both = side(before, "b").join(side(after, "a"), keys)
    single = F.array_compact(F.array(*[F.when(F.col(f"{p}_b") != F.col(f"{p}_a"), F.lit(s)) for p, s in (("evidence", "EVIDENCE_CHANGED"), ("state", "STATUS_CHANGED"), ("content", "OCCURRENCES_CHANGED"))]))
    several = F.when(F.col("all_b") != F.col("all_a"), F.array(F.lit("OCCURRENCES_CHANGED"))).otherwise(F.array().cast("array<string>"))
    found = F.when(F.col("n_b") != F.col("n_a"), F.array(F.lit("OCCURRENCE_COUNT_CHANGED"))).when(F.col("n_b") == 1, single).otherwise(several)
    return both.select(*keys, F.col("n_b").alias("before"), F.col("n_a").alias("after"), found.alias("signals"))


def comparability(sides: DataFrame) -> DataFrame:
    """Producers of two analyses (full outer) with the first reason not to compare them, or null.

    Columns before and after: struct(catalogs array, failed, known, supported), null if absent.
    """
    b, a = F.col("before"), F.col("after")
    changed = ~F.array_sort(b["catalogs"]).eqNullSafe(F.array_sort(a["catalogs"]))
    known = b["known"] & a["known"]
    reason = (
        F.when(b.isNull(), "ABSENT_BEFORE")
        .when(a.isNull(), "ABSENT_AFTER")
        .when(b["failed"], "FAILED_BEFORE")
        .when(a["failed"], "FAILED_AFTER")
        .when(~known & changed, "CATALOG_CHANGED")
        .when(~b["known"], "CONTRACT_UNKNOWN_BEFORE")
        .when(~a["known"], "CONTRACT_UNKNOWN_AFTER")
        .when(~b["supported"], "NOT_SUPPORTED_BEFORE")
        .when(~a["supported"], "NOT_SUPPORTED_AFTER")
        .when(changed, "CATALOG_CHANGED")
    )
    return sides.withColumn("reason", reason)


def producers(before: DataFrame, after: DataFrame) -> DataFrame:
    """Sides of every producer of either analysis: executions folded to one struct a side."""

    def side(df: DataFrame, name: str) -> DataFrame:
        folded = df.groupBy("producer_id").agg(F.array_sort(F.collect_set("catalog")).alias("catalogs"), F.bool_or(F.col("status") == "FAILED").alias("failed"), F.bool_and("known").alias("known"), F.bool_and(F.col("status") != "UNSUPPORTED").alias("supported"))
        return folded.select("producer_id", F.struct("catalogs", "failed", "known", "supported").alias(name))

    return side(before, "before").join(side(after, "after"), "producer_id", "full_outer")


def same_schema(before: Column, after: Column) -> Column:
    """Whether two sets of catalogs are equal or one of them is empty."""
    return (F.size(before) == 0) | (F.size(after) == 0) | (F.array_sort(F.array_distinct(before)) == F.array_sort(F.array_distinct(after)))


def recorded_pair(analyses: DataFrame, before: str, after: str) -> tuple[str, str]:
    """The latest complete analyses of two commits; a commit without one, or the same commit twice, is refused."""
    if before == after:
        raise ValueError("two commits are needed")
    found = {r.commit: r.analysis_id for r in latest_complete(analyses.where(F.col("commit").isin(before, after))).collect()}  # two rows at most
    for commit in (before, after):
        if commit not in found:
            raise ValueError(f"commit {commit} has no complete analysis")
    return found[before], found[after]


def commit_impact(before: DataFrame, after: DataFrame, slot: list[str] = ["subject", "relation"], value: str = "object") -> DataFrame:  # noqa: B006
    """category, subject, relation, object, before: what a change introduced, removed or modified, in the order of the category.

    A slot with one removed and one added value is modified; all other identities of one
    side alone are introduced or removed. Sides: subject, relation, object.
    """
    keys = [*slot, value]
    gone, new = only(before, after, keys), only(after, before, keys)
    changed = pair_modified(gone, new, slot, value)
    rest = lambda side, name: side.join(changed.select(*slot), slot, "left_anti").select(F.lit(name).alias("category"), *slot, value, F.lit(None).cast("string").alias("before"))
    modified = changed.select(F.lit("MODIFIED").alias("category"), *slot, F.col("after").alias(value), "before")
    return impact_order(modified.unionByName(rest(new, "INTRODUCED")).unionByName(rest(gone, "REMOVED")))


def impact_order(changes: DataFrame) -> DataFrame:
    first = F.when(F.col("category") == "MODIFIED", 0).when(F.col("category") == "INTRODUCED", 1).otherwise(2)
    return changes.orderBy(first, "subject", "relation", "object")


def latest_complete(analyses: DataFrame) -> DataFrame:
    """Of each commit the latest complete analysis, by time and then id; max_by of a struct, so no sort."""
    done = analyses.where("state = 'COMPLETE'")
    return done.groupBy("commit").agg(F.max_by("analysis_id", F.struct("created_at", "analysis_id")).alias("analysis_id"))


def merge_tiles(tiles: DataFrame) -> DataFrame:
    """Nodes of several tiles once each, at their smallest level."""
    return tiles.groupBy("reference").agg(F.min("level").alias("level"))
