"""Checking facts: vocabulary, structure and coherence as columns, one issue a broken rule; no value is ever repeated in a message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds of references (fixed values).
REFERENCE_TYPES = ("repository", "module", "directory", "file", "symbol", "endpoint", "route-pattern", "technology", "language", "annotation", "role", "permission", "policy-rule", "commit", "person", "application")
#: Relations with the kinds of their subjects and objects (none: an object isn't a reference) and their statuses (fixed values).
RELATIONS = {
    "CONTAINS": ("repository module file symbol", "module file symbol", "OBSERVED INFERRED"),
    "WRITTEN_IN": ("file", "language", "OBSERVED"),
    "USES_TECHNOLOGY": ("repository module", "technology", "OBSERVED"),
    "DECLARED_BY": ("technology", "file", "OBSERVED"),
    "ANNOTATED_WITH": ("symbol", "annotation", "OBSERVED"),
    "CALLS": ("symbol", "symbol", "INFERRED"),
    "WRITES_CALL": ("symbol", "", "OBSERVED"),
    "IMPLEMENTS": ("symbol", "symbol", "OBSERVED INFERRED"),
    "EXTENDS": ("symbol", "symbol", "OBSERVED"),
    "TYPED_AS": ("symbol", "symbol", "OBSERVED"),
    "TYPE_ARGUMENT": ("symbol", "symbol", "OBSERVED"),
    "DISPATCHES_TO": ("symbol", "symbol", "INFERRED"),
    "HANDLED_BY": ("endpoint", "symbol", "OBSERVED"),
    "ACCEPTS": ("endpoint", "symbol", "OBSERVED"),
    "RETURNS": ("endpoint", "symbol", "OBSERVED"),
    "PERMITS_ALL": ("route-pattern", "", "OBSERVED"),
    "AUTHORIZED_BY": ("route-pattern symbol", "symbol", "OBSERVED"),
    "MATCHED_BY": ("endpoint", "route-pattern", "INFERRED"),
    "PROTECTED_BY": ("endpoint", "symbol policy-rule", "INFERRED HUMAN_VALIDATED"),
    "CONFIGURES": ("symbol", "policy-rule", "OBSERVED"),
    "HAS_COMMIT": ("repository", "commit", "OBSERVED"),
    "AUTHORED_BY": ("commit", "person", "OBSERVED"),
    "CHILD_OF": ("commit", "commit", "OBSERVED"),
    "CHANGES": ("commit", "file", "OBSERVED"),
    "DEPENDS_ON": ("module", "module", "OBSERVED"),
    "BUILT_FROM": ("application", "module", "OBSERVED"),
    "SERVED_BY": ("endpoint", "application", "INFERRED"),
}
#: What may hold what (fixed values).
HOLDS = {"repository": ("module", "file"), "module": ("module", "file"), "file": ("symbol",), "symbol": ("symbol",)}
#: Which producers may give a status (fixed values).
PRODUCERS = {"OBSERVED": ("EVALUATOR",), "INFERRED": ("EVALUATOR", "PROJECTION"), "HUMAN_VALIDATED": ("HUMAN",)}
KINDS = ("ASSERTION", "ABSENCE", "COVERAGE")
STATUSES = ("OBSERVED", "INFERRED", "HUMAN_VALIDATED")
VALIDITIES = ("VALID", "STALE", "REVALIDATION_REQUIRED")
COVERAGE_TYPES = ("ANALYSED", "RECOGNIZED", "NOT_INTERPRETED", "OUT_OF_SCOPE", "READ_ERROR")

_REFERENCE = rf"^(?:{'|'.join(REFERENCE_TYPES)}):\S(?:.*\S)?$"
_COMMIT = r"^(?:[0-9a-f]{40}|[0-9a-f]{64})$"
_DIGEST = r"^sha256:[0-9a-f]{64}$"

FACT = """
kind string, status string, validity string, subject string, relation string, object string, qualifiers string, coverage_type string, reason string,
scope struct<include:array<string>,exclude:array<string>>, pattern struct<type:string,value:string>, method string,
snapshot struct<repository:string,commit:string,mode:string,content_fingerprint:string>,
produced_by struct<producer_type:string,producer_id:string,producer_version:string,execution_id:string,catalog_id:string,catalog_version:string>,
evidence array<struct<repository:string,commit:string,method:string,path:string,content_hash:string,line_start:int,line_end:int,symbol:string,column_start:int,column_end:int,role:string,object:string>>,
derivation struct<premises:array<string>,rule:string,counter_examples_checked:array<string>,known_gaps:array<string>>,
validation struct<validated_at:string,statement:string,anchors:array<struct<symbol:string,content_hash:string>>>
"""


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """Fact documents, one a line; what doesn't fit the schema fails the read."""
    return spark.read.schema(FACT).option("mode", "FAILFAST").json(path)


def is_reference(c: Column) -> Column:
    return F.coalesce(F.rlike(c, F.lit(_REFERENCE)), F.lit(False))


def blank(c: Column) -> Column:
    return c.isNull() | (F.length(F.trim(c)) == 0)


def rules() -> dict[str, Column]:
    """Code -> a condition that is true where a fact breaks the rule."""
    kind, status, evidence = F.col("kind"), F.col("status"), F.coalesce("evidence", F.array().cast("array<struct<repository:string,commit:string,method:string,path:string,content_hash:string,line_start:int,line_end:int,symbol:string,column_start:int,column_end:int,role:string,object:string>>"))
    producer = F.col("produced_by.producer_type")
    key = F.substring_index("relation", ":", 1)
    head = lambda c: F.substring_index(c, ":", 1)
    some = lambda test: F.coalesce(F.exists(evidence, test), F.lit(False))
    assertion, covered = kind == "ASSERTION", kind == "COVERAGE"
    among = lambda part: F.try_element_at(F.create_map(*[x for r, told in RELATIONS.items() for x in (F.lit(r), F.array(*map(F.lit, told[part].split())).cast("array<string>"))]), F.col("relation"))
    given = F.try_element_at(F.create_map(*[x for s, ps in PRODUCERS.items() for x in (F.lit(s), F.array(*map(F.lit, ps)))]), status)
    pair = F.lit(False)
    for holder, held in HOLDS.items():
        pair = pair | ((head("subject") == holder) & head("object").isin(*held))
    return {
        "KIND": kind.isNull() | ~kind.isin(*KINDS),
        "STATUS": status.isNull() | ~status.isin(*STATUSES),
        "VALIDITY": F.col("validity").isNull() | ~F.col("validity").isin(*VALIDITIES),
        "RELATION": assertion & (F.col("relation").isNull() | ~F.col("relation").isin(*RELATIONS)),
        "SUBJECT": (assertion | covered) & ~is_reference(F.col("subject")),
        "OBJECT": assertion & F.col("object").isNotNull() & F.contains("object", F.lit(":")) & head("object").isin(*REFERENCE_TYPES) & ~is_reference(F.col("object")),
        "SUBJECT_KIND": F.coalesce(assertion & ~F.array_contains(among(0), head("subject")), F.lit(False)),
        "OBJECT_KIND": F.coalesce(assertion & F.when(F.size(among(1)) == 0, F.col("object").isNotNull()).otherwise(F.col("object").isNull() | ~F.array_contains(among(1), head("object"))), F.lit(False)),
        "RELATION_STATUS": F.coalesce(assertion & ~F.array_contains(among(2), status), F.lit(False)),
        "CONTAINS_PAIR": F.coalesce(assertion & (key == "CONTAINS") & ~pair, F.lit(False)),
        "COVERAGE_TYPE": covered & (F.col("coverage_type").isNull() | ~F.col("coverage_type").isin(*COVERAGE_TYPES)),
        "SCOPE": (kind != "ASSERTION") & (F.col("scope").isNull() | (F.coalesce(F.size("scope.include"), F.lit(0)) < 1)),
        "REASON": covered & (F.col("coverage_type") != "ANALYSED") & blank(F.col("reason")),
        "PATTERN": (kind == "ABSENCE") & (blank(F.col("pattern.value")) | blank(F.col("method"))),
        "SNAPSHOT": F.col("snapshot").isNull() | ~F.coalesce(F.rlike("snapshot.commit", F.lit(_COMMIT)), F.lit(False)) | ~F.coalesce(F.col("snapshot.mode").isin("COMMIT", "WORKING_TREE"), F.lit(False)),
        "PRODUCER": producer.isNull() | blank(F.col("produced_by.producer_id")) | ~F.coalesce(F.array_contains(given, producer), F.lit(False)),
        "EVIDENCE": assertion & (status == "OBSERVED") & (F.size(evidence) < 1),
        "EVIDENCE_SNAPSHOT": some(lambda e: ~e["commit"].eqNullSafe(F.col("snapshot.commit")) | ~e["repository"].eqNullSafe(F.col("snapshot.repository"))),
        "EVIDENCE_HASH": some(lambda e: e["path"].isNotNull() & ~F.coalesce(F.rlike(e["content_hash"], F.lit(_DIGEST)), F.lit(False))),
        "EVIDENCE_LINES": some(lambda e: (e["line_start"].isNull() != e["line_end"].isNull()) | F.coalesce((e["line_start"] < 1) | (e["line_end"] < e["line_start"]), F.lit(False))),
        "DERIVATION": (status == "INFERRED") & (F.col("derivation").isNull() | (F.coalesce(F.size("derivation.premises"), F.lit(0)) < 1) | blank(F.col("derivation.rule"))),
        "VALIDATION": (status == "HUMAN_VALIDATED") & (F.col("validation").isNull() | (F.coalesce(F.size("validation.anchors"), F.lit(0)) < 1)),
        "CONFIDENCE": F.coalesce(F.rlike("qualifiers", F.lit(r'(?i)"(confidence|certainty|probability|score)"\s*:')), F.lit(False)),
    }


def issues(facts: DataFrame) -> DataFrame:
    """The facts with the codes of the rules that they break, in the rules' order; an empty array for a valid fact."""
    return facts.withColumn("issues", F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(code)) for code, broken in rules().items()])))


def output_issues(facts: DataFrame, catalog: DataFrame) -> DataFrame:
    """Of a producer's output: NO_COVERAGE if it states none, and codes that its catalog doesn't declare. catalog: producer_id, code (relations and coverage types)."""
    said = facts.select("producer_id", F.coalesce("relation", "coverage_type").alias("code")).distinct()
    undeclared = said.join(catalog, ["producer_id", "code"], "left_anti").select("producer_id", F.lit("UNDECLARED").alias("issue"), "code")
    none = facts.groupBy("producer_id").agg(F.count_if(F.col("kind") == "COVERAGE").alias("n")).where("n = 0").select("producer_id", F.lit("NO_COVERAGE").alias("issue"), F.lit(None).cast("string").alias("code"))
    return undeclared.unionByName(none)


def orphans(occurrences: DataFrame, executions: DataFrame) -> DataFrame:
    """Occurrences whose execution isn't recorded, or is one of another producer: must be empty before a write."""
    return occurrences.join(executions.select("analysis_id", "execution_id", "producer_id"), ["analysis_id", "execution_id", "producer_id"], "left_anti")


def engine_coverage(executions: DataFrame, repository: str) -> DataFrame:
    """Coverage that the engine itself states: an unsupported execution covers nothing (OUT_OF_SCOPE), a failed one read nothing (NOT_INTERPRETED)."""
    kind = F.when(F.col("status") == "UNSUPPORTED", "OUT_OF_SCOPE").when(F.col("status") == "FAILED", "NOT_INTERPRETED")
    return executions.withColumn("coverage_type", kind).where("coverage_type is not null").select(F.lit("COVERAGE").alias("kind"), F.lit(f"repository:{repository}").alias("subject"), "coverage_type", "producer_id", F.lower("status").alias("reason"))
