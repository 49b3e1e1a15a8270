"""What an analysis knows of itself, and verdicts on claims: "not found" is never "false"."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.facts import covers, unread

#: Relations of which a subject has one object: another established object refutes (fixed values).
EXCLUSIVE = ("AUTHORED_BY", "WRITTEN_IN")


def present_languages(facts: DataFrame) -> DataFrame:
    """Languages that WRITTEN_IN facts name, sorted."""
    return facts.where((F.col("relation") == "WRITTEN_IN") & F.startswith("object", F.lit("language:"))).select("object").distinct().orderBy("object")


def combined_reads(executions: DataFrame) -> DataFrame:
    """Of each producer what its executions read in common: one contract, or UNKNOWN if they differ. reads: ANY, LANGUAGES or UNKNOWN with languages."""
    contract = F.struct("reads", F.array_sort(F.coalesce("languages", F.array().cast("array<string>"))).alias("languages"))
    return executions.groupBy("producer_id").agg(F.countDistinct(contract).alias("n"), F.min(contract).alias("c")).select("producer_id", F.when(F.col("n") == 1, F.col("c.reads")).otherwise("UNKNOWN").alias("reads"), F.when(F.col("n") == 1, F.col("c.languages")).otherwise(F.array().cast("array<string>")).alias("languages"))


def reads_present(reads: Column, languages: Column, present: Column) -> Column:
    return (reads == "ANY") | F.coalesce(F.arrays_overlap(languages, present), F.lit(False))


def unread_languages(present: DataFrame, readers: DataFrame) -> DataFrame:
    """Present languages that no reader reads; none at all if any reader is independent of languages. present: language; readers: reads, languages."""
    free = readers.where("reads = 'ANY'").select(F.lit(True).alias("free")).limit(1)
    read = readers.select(F.explode("languages").alias("language")).distinct()
    left = present.select("language").distinct().join(read, "language", "left_anti")
    return left.join(F.broadcast(free), F.lit(True), "left_anti")


def languages_complete(inventory: DataFrame) -> DataFrame:
    """Whether an inventory read everything: it succeeded and has no unread coverage. Columns status, coverage_type."""
    return inventory.agg((F.coalesce(F.bool_and(F.col("status") == "SUCCESS"), F.lit(False)) & ~F.coalesce(F.bool_or(unread()), F.lit(False))).alias("complete"))


def _is_container(scope: Column) -> Column:
    return F.substring_index(scope, ":", 1).isin("repository", "directory")


def analyzers_of(claims: DataFrame, analyzers: DataFrame, coverage: DataFrame | None = None) -> DataFrame:
    """Claims with every analyzer whose catalog has the relation, and whether it covers the subject.

    claims: claim_id, subject, relation, object, needed (languages or null). analyzers: analyzer_id,
    relations, failed, unsupported, reads, languages: a row for each producer of an analysis,
    so they are broadcast. coverage: analyzer_id, coverage_type, subject, include, exclude,
    of any size, or an array of these in a column of analyzers. Coverage of single
    references is joined by reference; only scopes that hold others (repositories and
    directories, or with exclusions), which analyzers declare by hand, are gathered.
    """
    if coverage is None:
        coverage = analyzers.select("analyzer_id", F.inline("coverage"))
    analysed = coverage.where("coverage_type = 'ANALYSED'")
    wide = F.exists("include", _is_container) | (F.coalesce(F.size("exclude"), F.lit(0)) > 0)
    single = analysed.where(~F.coalesce(wide, F.lit(False))).select("analyzer_id", F.explode("include").alias("subject")).distinct().withColumn("named", F.lit(True))
    scopes = analysed.where(wide).groupBy("analyzer_id").agg(F.collect_set(F.struct("include", "exclude")).alias("scopes"))
    some = analysed.select("analyzer_id").distinct().withColumn("has_analysed", F.lit(True))
    blind = coverage.where(unread()).select("analyzer_id", F.col("subject").alias("seen")).distinct()

    able = analyzers.select("analyzer_id", "failed", "unsupported", "reads", "languages", F.explode("relations").alias("relation")).join(scopes, "analyzer_id", "left").join(some, "analyzer_id", "left")
    rows = claims.join(F.broadcast(able), "relation", "left").join(single, ["analyzer_id", "subject"], "left")
    for side in ("subject", "object"):
        rows = rows.join(blind.select("analyzer_id", F.col("seen").alias(side), F.lit(True).alias(f"blind_{side}")), ["analyzer_id", side], "left")
    inside = F.exists("scopes", lambda c: covers(c["include"], c["exclude"], F.col("subject")))
    rows = rows.withColumn("has_analysed", F.coalesce("has_analysed", F.lit(False))).withColumn("covered", F.coalesce("named", F.lit(False)) | F.coalesce(inside, F.lit(False)))
    capable = F.col("analyzer_id").isNotNull() & (F.col("failed") | ~F.col("has_analysed") | F.col("covered"))
    return rows.withColumn("capable", capable).withColumn("blind", capable & (F.col("failed") | F.col("blind_subject").isNotNull() | F.col("blind_object").isNotNull()))


def verdicts(claims: DataFrame, established: DataFrame, analyzers: DataFrame, present: list[str], complete: bool, coverage: DataFrame | None = None) -> DataFrame:
    """claim_id, verdict and reason. Analyzers and coverage are those of analyzers_of().

    CONFIRMED: the same object is established. REFUTED: another one is, for an exclusive
    relation. Else NOT_PROVEN with the first reason that holds: nobody could state it
    (NOT_ANALYSED), somebody couldn't read it (NOT_INTERPRETED), no successful reader
    reached it or its languages (NOT_ANALYSED), and only then NOT_FOUND_IN_ANALYSED_SCOPE.
    """
    known = F.array(*map(F.lit, present)).cast("array<string>")
    facts = established.select("subject", "relation", F.col("object").alias("stated"), F.lit(True).alias("there")).distinct()
    joined = claims.join(facts, ["subject", "relation"], "left").groupBy("claim_id").agg(
        F.coalesce(F.bool_or(F.col("there") & F.col("stated").eqNullSafe(F.col("object"))), F.lit(False)).alias("same"),
        F.coalesce(F.bool_or(F.col("object").isNotNull() & F.col("stated").isNotNull() & (F.col("stated") != F.col("object")) & F.col("relation").isin(*EXCLUSIVE)), F.lit(False)).alias("other"),
    )
    rows = analyzers_of(claims, analyzers, coverage)
    reaching = F.col("analyzer_id").isNotNull() & ~F.col("failed") & ~F.col("unsupported") & F.col("covered") & reads_present(F.col("reads"), F.col("languages"), known)
    flags = rows.withColumn("reaching", F.coalesce(reaching, F.lit(False))).groupBy("claim_id", F.to_json("needed").alias("_n")).agg(
        F.any_value("needed").alias("needed"),
        F.coalesce(F.bool_or("capable"), F.lit(False)).alias("capable"),
        F.coalesce(F.bool_or("blind"), F.lit(False)).alias("blind"),
        F.bool_or("reaching").alias("reached"),
        F.coalesce(F.bool_or(F.col("reaching") & (F.col("reads") == "ANY")), F.lit(False)).alias("free"),
        F.flatten(F.collect_list(F.when(F.col("reaching"), F.col("languages")))).alias("read"),
    )
    missing = ~F.col("free") & (F.size(F.array_except(F.coalesce("needed", known), "read")) > 0)
    unknown = F.col("needed").isNull() & F.lit(not complete) & ~F.col("free")
    reason = F.when(~F.col("capable"), "NOT_ANALYSED").when(F.col("blind"), "NOT_INTERPRETED").when(~F.col("reached") | missing | unknown, "NOT_ANALYSED").otherwise("NOT_FOUND_IN_ANALYSED_SCOPE")
    verdict = F.when(F.col("same"), "CONFIRMED").when(F.col("other"), "REFUTED").otherwise("NOT_PROVEN")
    return joined.join(flags, "claim_id").select("claim_id", verdict.alias("verdict"), F.when(verdict == "NOT_PROVEN", reason).alias("reason"))


#: Buckets that the objects of a subject and relation are dealt to, so a large one isn't in one task; a power of two.
BUCKETS = 16


def known_objects(claims: DataFrame, established: DataFrame, most: int = 10, parts: int | None = None) -> DataFrame:
    """Of each claim's subject and relation up to `most` established objects, the asked one first, and how many more there are.

    parts: partitions that a large table of facts is dealt to, where copies meet. Objects are
    listed once for each subject and relation; claims meet these short lists, and look up
    whether the asked object is among all.
    """
    pair = ["subject", "relation"]
    deal = lambda x, *keys: x if parts is None else x.repartition(parts, *keys)
    rows = established.select(*pair, "object", F.xxhash64("object").bitwiseAND(F.lit(BUCKETS - 1)).alias("bucket"))
    rows = deal(rows, "subject", "bucket").distinct()  # not by relation: where that is constant Spark would shuffle again
    counts = rows.groupBy(*pair).agg(F.count(F.lit(1)).alias("n"))
    # the first rows of a bucket stay, so few of a large pair are shuffled
    best = lambda x, *keys: x.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("object"))).where(F.col("place") <= most)
    first = best(deal(best(rows, *pair, "bucket").select(*pair, "object"), "subject"), *pair)
    listed = first.groupBy(*pair).agg(F.array_sort(F.collect_list(F.struct("place", "object"))).alias("all")).join(counts, pair)
    asked = claims.select("claim_id", *pair, F.col("object").alias("asked"))
    same = [asked[c] == rows[c] for c in pair]
    held = asked.join(rows, [*same, asked["asked"].eqNullSafe(rows["object"])]).select("claim_id", F.lit(True).alias("held"))
    names = F.transform("all", lambda x: x["object"])
    led = F.when(F.col("held"), F.concat(F.array("asked"), F.filter(names, lambda o: ~o.eqNullSafe(F.col("asked"))))).otherwise(names)
    out = asked.join(listed, pair).join(held, "claim_id", "left")
    return out.select("claim_id", F.slice(led, 1, most).alias("objects"), F.greatest(F.col("n") - most, F.lit(0)).cast("int").alias("more"))


def limited_claims(facts: DataFrame, limits: DataFrame, decisive: tuple[str, ...] = EXCLUSIVE) -> DataFrame:
    """Limits (subject, relation, limit) that hold for the asked facts (subject, relation): those of the relation or of the subject as a whole (null relation); for a relation that is decisive by itself those of the subject are dropped."""
    asked = facts.select("subject", "relation").distinct()
    own = limits.where("relation is not null").select("subject", "relation", "limit")
    whole = limits.where("relation is null").select("subject", "limit")
    return asked.join(own, ["subject", "relation"]).unionByName(asked.where(~F.col("relation").isin(*decisive)).join(whole, "subject")).distinct()


def claim_order(facts: DataFrame, asked: str) -> DataFrame:
    """Facts of a claim, the asked object first, then by object."""
    return facts.orderBy(~F.col("object").eqNullSafe(F.lit(asked)), "object")


def outside(references: DataFrame, repository: str) -> DataFrame:
    """OUT_OF_SCOPE rows for references (subject) to other repositories than the analysed one."""
    return references.where(F.startswith("subject", F.lit("repository:")) & (F.col("subject") != f"repository:{repository}")).select("subject", F.lit("OUT_OF_SCOPE").alias("coverage_type"))


def coverage_report(coverage: DataFrame, by: str) -> DataFrame:
    """Analysed and unread subjects by a column."""
    return coverage.groupBy(by).agg(F.countDistinct(F.when(unread(), F.col("subject"))).alias("not_interpreted"), F.countDistinct(F.when(F.col("coverage_type") == "ANALYSED", F.col("subject"))).alias("analysed"))


def envelope_coverage(coverage: DataFrame, subjects: DataFrame) -> DataFrame:
    """Coverage of the subjects, with a NOT_ANALYSED row for those that have none: never empty for a subject."""
    return subjects.select("subject").distinct().join(coverage.select("subject", "coverage_type"), "subject", "left").withColumn("coverage_type", F.coalesce("coverage_type", F.lit("NOT_ANALYSED")))
