"""Resolving written calls: type hierarchies, unique declarations, implementations, constants, loading."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.graph import closure_with_paths, nearest_single, reach
from factloom.session import cut

#: Why a call isn't resolved, by category (fixed values).
CATEGORIES = {
    "RECEIVER_TYPE_UNKNOWN": "UNKNOWN",
    "RECEIVER_TYPE_AMBIGUOUS": "AMBIGUOUS",
    "OVERLOAD_AMBIGUOUS": "AMBIGUOUS",
    "NO_MATCHING_DECLARATION": "UNKNOWN",
    "TARGET_DECLARATION_OUTSIDE_SNAPSHOT": "UNKNOWN",
    "TARGET_TYPE_OUTSIDE_SNAPSHOT": "UNKNOWN",
    "SUPER_TYPE_UNRESOLVED": "UNKNOWN",
    "UNSUPPORTED_CALL_FORM": "UNSUPPORTED",
    "RECEIVER_KIND_DEFERRED": "UNSUPPORTED",
    "LAMBDA_OR_LOCAL_CONTEXT": "UNSUPPORTED",
    "PARSE_ERROR": "UNKNOWN",
}


def written_calls(sites: DataFrame) -> DataFrame:
    """One row for each caller and written call, with the places of all of its sites: caller, method, receiver, arity, path, line."""
    place = F.struct("path", "line")
    return sites.groupBy("caller", "receiver", "method", "arity").agg(F.array_sort(F.collect_set(place)).alias("evidence"))


def hierarchy(extends: DataFrame, types: DataFrame) -> DataFrame:
    """type, reference, level: every supertype of each type and its distance, itself at 0. extends: type, super.

    All types climb together, a join a level, until a level finds nothing; repeated pairs
    keep their smallest level.
    """
    pairs = front = types.select("type", F.col("type").alias("reference"), F.lit(0).alias("level"))
    level = 0
    while True:
        level += 1
        up = front.join(extends.select(F.col("type").alias("reference"), "super"), "reference").select("type", F.col("super").alias("reference")).distinct()
        front = cut(up.join(pairs.select("type", "reference"), ["type", "reference"], "left_anti").withColumn("level", F.lit(level)), "hierarchy")
        if front.isEmpty():
            return pairs
        pairs = pairs.unionByName(front)


def resolve(sites: DataFrame, supers: DataFrame, declared: DataFrame, external: DataFrame) -> DataFrame:
    """site_id, target, reason: the only declaration of the name and number of arguments at the nearest level.

    sites: site_id, receiver_type, method, arity; supers: from hierarchy(); declared: type, method,
    arity, symbol; external: type. A hierarchy with a type outside of the sources proves nothing.
    Each call that is written anywhere is resolved once, and of the declarations that share a
    name at most two are looked at, as two tell that there are several; sites only look up the answer.
    """
    call = ["receiver_type", "method", "arity"]
    own = supers.withColumnRenamed("type", "receiver_type")
    ends = declared.groupBy(F.col("type").alias("reference"), "method", "arity").agg(F.min("symbol").alias("first"), F.max("symbol").alias("last"))
    few = ends.select("reference", "method", "arity", F.explode(F.array_distinct(F.array("first", "last"))).alias("candidate"))
    best = nearest_single(sites.select(*call).distinct().join(own, "receiver_type").join(few, ["reference", "method", "arity"]), call)
    outside = own.join(external.select(F.col("type").alias("reference")), "reference", "left_semi").select("receiver_type").distinct().withColumn("outside", F.lit(True))
    rows = sites.select("site_id", *call).join(best, call, "left").join(outside, "receiver_type", "left")
    reason = F.when(F.col("receiver_type").isNull(), "RECEIVER_TYPE_UNKNOWN").when(F.col("outside"), "TARGET_TYPE_OUTSIDE_SNAPSHOT").when(F.col("reason") == "AMBIGUOUS", "OVERLOAD_AMBIGUOUS").when(F.col("candidate").isNull(), "NO_MATCHING_DECLARATION")
    return rows.select("site_id", F.when(reason.isNull(), F.col("candidate")).alias("target"), reason.alias("reason"))


def categories(frontier: DataFrame) -> DataFrame:
    """Reasons with their category; a reason without one is an error, never a guess."""
    named = F.create_map(*[F.lit(x) for pair in CATEGORIES.items() for x in pair])
    category = F.try_element_at(named, F.col("reason"))
    return frontier.withColumn("category", F.when(F.col("reason").isNull() | category.isNotNull(), category).otherwise(F.raise_error(F.lit("unknown reason")).cast("string")))


def implementations(methods: DataFrame, interfaces: DataFrame, implements: DataFrame) -> DataFrame:
    """Class methods with the interface methods of their signature: methods and interfaces (type, signature, symbol), implements (type, interface)."""
    wanted = implements.join(interfaces.select(F.col("type").alias("interface"), "signature", F.col("symbol").alias("declares")), "interface")
    return wanted.join(methods.select("type", "signature", "symbol"), ["type", "signature"]).select("symbol", "declares").distinct()


def constants(literal: DataFrame, names: DataFrame) -> DataFrame:
    """name, value of string constants: literals (name, value) and names that stand for other names (name, other), until a round finds nothing."""
    known = literal.select("name", "value")
    while True:
        found = names.join(known.withColumnRenamed("name", "other"), "other").select("name", "value").join(known, "name", "left_anti")
        new = cut(found.groupBy("name").agg(F.min("value").alias("value"), F.countDistinct("value").alias("n")).where("n = 1").drop("n"), "constants")
        if new.isEmpty():
            return known
        known = known.unionByName(new)


def runtime_classpath(dependencies: DataFrame, applications: DataFrame, configurations: list[str]) -> DataFrame:
    """Modules that applications see at run time, with a path to each: dependencies (module, target, configuration), applications (module)."""
    edges = dependencies.where(F.col("configuration").isin(*configurations)).select(F.col("module").alias("src"), F.col("target").alias("dst"))
    return closure_with_paths(edges, applications.select(F.col("module").alias("reference")))


def loading(imports: DataFrame, conditions: DataFrame, roots: DataFrame) -> DataFrame:
    """type, state: LOADED if imports lead to it from a root without conditions, MAYBE if only with some. imports (src, dst), conditions (type), roots (reference)."""
    free = imports.join(conditions.select(F.col("type").alias("dst")).distinct(), "dst", "left_anti")
    sure, any_way = reach(free.select("src", "dst"), roots), reach(imports, roots)
    return any_way.select("reference").join(sure.select("reference", F.lit("LOADED").alias("state")), "reference", "left").select(F.col("reference").alias("type"), F.coalesce("state", F.lit("MAYBE")).alias("state"))
