"""Selecting facts: the conjunctive query, exact spelling, evidence, coverage, identities and ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.canonical import flat_identity, utf16_key
from factloom.functions.names import key_of, kind_of, normal_form
from factloom.session import cut

#: Coverage types of what wasn't read (fixed values).
UNREAD = ("NOT_INTERPRETED", "READ_ERROR")


def spelled(facts: DataFrame, field: str, value: str) -> Column:
    """Rows whose field was submitted with exactly this spelling.

    Identities hold normal form C; raw_identity (JSON, null if nothing differs) the
    submitted spelling. The canonical column narrows, and can be pushed down; the raw one decides.
    """
    import unicodedata

    canonical = unicodedata.normalize("NFC", value)
    narrow = F.col(field) == canonical
    if "raw_identity" not in facts.columns:
        return narrow if canonical == value else F.lit(False)
    raw = F.get_json_object("raw_identity", f"$.{field}")
    return narrow & ((F.col("raw_identity").isNull() & F.lit(canonical == value)) | (raw == value))


def find_facts(facts: DataFrame, *, producer: str | None = None, kind: str | None = None, subject: str | None = None, relation: str | None = None, object: str | None = None) -> DataFrame:
    """The facts that meet all of the given conditions; references by spelling, the producer by the machine's id or else the human's."""
    out = facts
    if producer is not None:
        human = F.col("human_producer_id") if "human_producer_id" in facts.columns else F.lit(None)
        out = out.where(F.coalesce("producer_id", human) == producer)
    if kind is not None:
        out = out.where(F.col("kind") == kind)
    for field, value in (("subject", subject), ("relation", relation), ("object", object)):
        if value is not None:
            out = out.where(spelled(facts, field, value) if field != "relation" else F.col("relation") == value)
    return out


def named(facts: DataFrame, reference: str) -> DataFrame:
    """Whether any fact names the reference: one row, found."""
    return facts.where((F.col("subject") == reference) | (F.col("object") == reference)).limit(1).agg((F.count(F.lit(1)) > 0).alias("found"))


def occurrence(facts: DataFrame, key: str) -> DataFrame:
    """The occurrence of a numeric key of at most 19 digits; none for any other key."""
    return facts.where(F.col("occ_id") == int(key)) if key.isascii() and key.isdigit() and len(key) <= 19 and int(key) < 2**63 else facts.limit(0)


def unread(coverage_type: Column | str = "coverage_type") -> Column:
    return (F.col(coverage_type) if isinstance(coverage_type, str) else coverage_type).isin(*UNREAD)


def coverage_of(coverage: DataFrame, references: DataFrame) -> DataFrame:
    """Coverage rows of the given references (a column reference), unread ones first."""
    return coverage.join(references.select(F.col("reference").alias("subject")).distinct(), "subject", "left_semi").orderBy(unread().desc(), "subject", "coverage_type")


def contains(scope: Column, reference: Column) -> Column:
    """Whether a scope holds a reference: a repository all but other repositories, a directory what its path begins, any other itself. A path may hold colons: a kind ends at the first."""
    kind = F.substring_index(scope, ":", 1)
    folder = F.concat(F.rtrim(key_of(scope), F.lit("/")), F.lit("/"))
    inside = F.startswith(key_of(reference), folder) & kind_of(reference).isin("directory", "file")
    return F.when(scope == reference, True).when(kind == "repository", ~F.startswith(reference, F.lit("repository:"))).when(kind == "directory", inside).otherwise(False)


def covers(include: Column, exclude: Column, reference: Column) -> Column:
    """Any included scope holds the reference and no excluded one does; null lists are empty."""
    return F.coalesce(F.exists(include, lambda s: contains(s, reference)), F.lit(False)) & ~F.coalesce(F.exists(exclude, lambda s: contains(s, reference)), F.lit(False))


def without_evidence(facts: DataFrame) -> DataFrame:
    """Facts with the number of their pieces of evidence in place of these."""
    return facts.withColumn("evidence_count", F.coalesce(F.size("evidence"), F.lit(0))).drop("evidence")


def evidence_summary(evidence: Column) -> Column:
    """Of each piece its place alone: path, lines, symbol."""
    return F.transform(evidence, lambda e: F.struct(*[e[f].alias(f) for f in ("path", "line_start", "line_end", "symbol", "method")]))


EVIDENCE = "array<struct<repository:string,commit:string,method:string,path:string,content_hash:string,line_start:int,line_end:int,symbol:string>>"


def evidence_of(facts: DataFrame, asked: DataFrame) -> DataFrame:
    """occ_id, position and the parts of each piece of evidence of the asked occurrences (occ_id). Facts carry it in details (JSON); one without evidence has no row."""
    own = facts.join(asked.select("occ_id").distinct(), "occ_id", "left_semi")
    pieces = F.from_json(F.get_json_object("details", "$.evidence"), EVIDENCE)
    return own.select("occ_id", F.posexplode(pieces).alias("position", "e")).select("occ_id", "position", "e.*")


def entry_points(facts: DataFrame, annotations: list[str]) -> DataFrame:
    """reference, why: what runs from outside: handlers of routes (ROUTE), methods with one of the entry annotations (ANNOTATION), and main methods (MAIN)."""
    handled = facts.where("relation = 'HANDLED_BY'").select(F.col("object").alias("reference"), F.lit("ROUTE").alias("why"))
    marked = facts.where((F.col("relation") == "ANNOTATED_WITH") & F.substring_index("object", ":", -1).isin(*annotations)).select(F.col("subject").alias("reference"), F.lit("ANNOTATION").alias("why"))
    held = facts.where("relation = 'CONTAINS'").select(F.col("object").alias("reference"), F.lit("MAIN").alias("why")).where(F.endswith("reference", F.lit("#main(String[])")))
    return handled.unionByName(marked).unionByName(held).distinct()


def identities(facts: DataFrame) -> DataFrame:
    """identity_hash and occurrences of assertions without qualifiers; a hash aggregate with partial sums, so copies meet before the shuffle."""
    return facts.groupBy("kind", "subject", "relation", "object").agg(F.count(F.lit(1)).alias("occurrences")).withColumn("identity_hash", flat_identity(F.col("kind"), F.col("subject"), F.col("relation"), F.col("object")))


def distinct_objects(facts: DataFrame, relation: str) -> DataFrame:
    return facts.where(F.col("relation") == relation).select("object").distinct().orderBy("object")


def adjacency_rank(edges: DataFrame, anchor: str, neighbour: str, *ties: str, relation: str = "relation", normalize: bool = False) -> DataFrame:
    """Dense places 1..n of an anchor's neighbours within a relation, in the order of UTF-16 code units of their normal form, then of the ties.

    An anchor with very many neighbours is one window group; ranks_of_large splits it first.
    """
    shown = normal_form(F.col(neighbour)) if normalize else F.col(neighbour)
    keys = [c for c in (anchor, relation) if c in edges.columns]
    return edges.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(utf16_key(shown), *ties)))


#: Neighbours of an anchor from which its ranks are made by ranges.
LARGE = 1_000_000


def ranks_of_large(edges: DataFrame, anchor: str, neighbour: str, *ties: str, relation: str = "relation", large: int | None = None) -> DataFrame:
    """The same ranks without a large anchor's whole adjacency in one task.

    Anchors of more than `large` neighbours (LARGE) are dealt by sampled ranges of (anchor,
    neighbour); a place is the rank within a range plus the numbers of those before, of
    which there is a row for each anchor and range. All other anchors are one window group each.
    """
    keys, large = [c for c in (anchor, relation) if c in edges.columns], large or LARGE
    order = [utf16_key(F.col(neighbour)), *map(F.col, ties)]
    rows = cut(edges, "edges")
    hot = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > large).select(*keys)
    window = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    if hot.isEmpty():
        return rows.withColumn("rank", window)
    some = rows.join(hot, keys, "left_semi").withColumn("_key", order[0])
    dealt = cut(some.repartitionByRange(*keys, "_key").withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inner = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy("_key", *ties))
    placed = dealt.withColumn("_inner", inner).join(before, [*keys, "_range"]).withColumn("rank", (F.col("_inner") + F.col("_before")).cast("int"))
    return rows.join(hot, keys, "left_anti").withColumn("rank", window).unionByName(placed.drop("_key", "_range", "_inner", "_before"))


def rerank(ranked: DataFrame, batch: DataFrame, anchor: str, neighbour: str, *ties: str, relation: str = "relation") -> DataFrame:
    """Ranks after a batch of edges: only adjacencies that the batch touches are ordered anew, large ones by ranges."""
    keys = [c for c in (anchor, relation) if c in ranked.columns]
    touched = batch.select(*keys).distinct()
    stay = ranked.join(touched, keys, "left_anti")
    again = ranked.drop("rank").join(touched, keys, "left_semi").unionByName(batch)
    return stay.unionByName(ranks_of_large(again, anchor, neighbour, *ties, relation=relation))


def neighbours(ranked: DataFrame, anchor: str, reference: str, after: int = 0, limit: int = 20) -> DataFrame:
    """A page of an adjacency: up to `limit` rows behind a rank."""
    return ranked.where((F.col(anchor) == reference) & (F.col("rank") > after)).orderBy("rank").limit(limit)


def revision(facts: DataFrame) -> DataFrame:
    """The generation of an analysis: its largest occurrence id, 0 without any."""
    return facts.agg(F.coalesce(F.max("occ_id"), F.lit(0)).alias("revision"))


def site_ranks(sites: DataFrame, position: list[str], *ties: str) -> DataFrame:
    """Among sites at one position, how many stand before each."""
    return sites.withColumn("copy", F.row_number().over(Window.partitionBy(*position).orderBy(*ties)) - 1)
