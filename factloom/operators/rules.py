"""Path patterns and access rules: how a pattern meets a route, the first rule that decides, the chain that applies."""

from __future__ import annotations

import functools
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A pattern meets none, some or all requests of a route.
NONE, SOME, ALL = 0, 1, 2
_variable = re.compile(r"\{[^{}]+\}").fullmatch
_open = re.compile(r"\{\*[^{}]+\}").fullmatch


@functools.lru_cache(maxsize=4096)
def _segment(pattern: str):
    """A segment's wildcards: a star for any characters, a question mark for one."""
    wild = {"*": ".*", "?": "."}
    return re.compile("".join(wild.get(t, re.escape(t)) for t in re.split(r"([*?])", pattern)), re.DOTALL).fullmatch


def meets(pattern: str, route: str) -> int:
    """NONE, SOME or ALL. Rows of a table over (segments of the pattern, segments of the route), from the ends on."""
    want, have = ([s for s in x.split("/") if s] for x in (pattern, route))
    below = [ALL if j == len(have) else NONE for j in range(len(have) + 1)]
    for p in reversed(want):
        row = [NONE] * (len(have) + 1)
        if p == "**":
            best = NONE
            for j in range(len(have), -1, -1):
                best = max(best, below[j])
                row[j] = best
        else:
            for j, s in enumerate(have):
                if _open(s):
                    row[j] = SOME
                elif p == "*" or _variable(p):
                    row[j] = below[j + 1]
                elif _variable(s):
                    row[j] = min(below[j + 1], SOME)
                elif _segment(p)(s):
                    row[j] = below[j + 1]
        below = row
    return below[0]


#: Segments that meets() compares: two stars, a variable, or text with single stars and question marks.
_known = r"\*\*|\{[^/{}]+\}|(?:\*?[^/*{}\[\]])*\*?"
_whole_path = re.compile(rf"(?:/(?:{_known}))+").fullmatch


def readable(pattern: str) -> bool:
    """Whether a pattern holds nothing that meets() can't compare."""
    return bool(_whole_path(pattern))


@F.pandas_udf(T.IntegerType())
def path_match(patterns: pd.Series, routes: pd.Series) -> pd.Series:
    return pd.Series([None if p is None or r is None else meets(p, r) for p, r in zip(patterns, routes, strict=True)], dtype="Int32")


def verb_match(rule_verb: Column, verb: Column) -> Column:
    """A rule without a verb meets all; one with a verb meets some requests of an endpoint that takes any."""
    open_, same = rule_verb.isNull(), rule_verb == verb
    return F.when(open_ | same, F.when(~open_ & (verb == "ANY"), SOME).otherwise(ALL)).otherwise(F.when(verb == "ANY", SOME).otherwise(NONE))


#: What restricts in an access expression: words, and calls that take quoted names (fixed values).
RESTRICTIONS = ("isAuthenticated()", "isFullyAuthenticated()", "denyAll")
RESTRICTING_CALLS = ("hasRole", "hasAnyRole", "hasAuthority", "hasAnyAuthority", "hasIpAddress")


def restrictive(expression: Column) -> Column:
    """Whether an access expression can only restrict: one restriction, or several joined by `and`. Null expressions don't."""
    # names become empty quotes, so that what they hold neither joins nor closes anything
    plain = F.regexp_replace(F.trim(expression), "'[^'()]+'", "''")
    parts = F.split(plain, r"\s+and\s+")

    def is_call(part: Column) -> Column:
        names = F.split(F.regexp_extract(part, r"^\w+\((.*)\)$", 1), ",")
        return F.substring_index(part, "(", 1).isin(*RESTRICTING_CALLS) & F.forall(names, lambda n: F.trim(n) == "''")

    return F.coalesce(F.forall(parts, lambda p: p.isin(*RESTRICTIONS) | is_call(p)), F.lit(False))


#: Distinct patterns that one set of rules holds at most: they are written by hand, and each reaches every task.
MOST_PATTERNS = 10_000


def met_patterns(routes: DataFrame, patterns: DataFrame) -> DataFrame:
    """route, pattern, outcome of every pair that meets at least in part: routes (route), of any number; patterns (pattern), MOST_PATTERNS at most, or it is refused.

    Each route and pattern is looked at once. Pairs are made by the first segment where
    both have a plain one; only patterns or routes that begin with a wildcard or a variable
    are paired with all of the other side's, by a broadcast of the patterns.
    """
    head = lambda c: F.get(F.filter(F.split(c, "/"), lambda s: s != ""), F.lit(0))
    loose = lambda c: F.coalesce(F.rlike(head(c), F.lit(r"[*?{}]")), F.lit(True))
    left = routes.select("route").where("route is not null").distinct().select("route", head(F.col("route")).alias("_head"), loose(F.col("route")).alias("_loose"))
    right = patterns.select("pattern").where("pattern is not null").distinct().select("pattern", head(F.col("pattern")).alias("_head"), loose(F.col("pattern")).alias("_any"))
    if right.limit(MOST_PATTERNS + 1).count() > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} patterns")
    plain = F.broadcast(right.where("not _any").drop("_any"))
    pairs = left.where("not _loose").join(plain, "_head").select("route", "pattern")
    pairs = pairs.unionByName(left.where("_loose").select("route").join(F.broadcast(right.where("not _any").select("pattern")), F.lit(True)))
    pairs = pairs.unionByName(left.select("route").join(F.broadcast(right.where("_any").select("pattern")), F.lit(True)))
    return pairs.withColumn("outcome", path_match(F.col("pattern"), F.col("route"))).where(F.col("outcome") > NONE)


def outcomes(endpoints: DataFrame, rules: DataFrame) -> DataFrame:
    """Endpoints with every rule of their chain and how it meets them. endpoints: endpoint, chain, verb, route; rules: chain, place, verb, pattern, readable, never, and more.

    Rules are joined by chain; a chain's rules are written by hand, so a key has few of
    them. Paths are compared once for each route and pattern.
    """
    told = rules.withColumnsRenamed({"verb": "rule_verb"})
    paths = met_patterns(endpoints, rules.where("readable and not never")).withColumnRenamed("outcome", "_path")
    met = F.when(F.col("never"), NONE).when(~F.col("readable"), SOME).otherwise(F.least(verb_match(F.col("rule_verb"), F.col("verb")), F.coalesce("_path", F.lit(NONE))))
    each = endpoints.join(told, "chain").join(paths, ["route", "pattern"], "left").withColumn("outcome", met)
    return each.groupBy(*endpoints.columns, "place").agg(F.max("outcome").alias("outcome"), F.first("pattern").alias("pattern"))


def first_match(met: DataFrame) -> DataFrame:
    """endpoint, place, reason: the first rule that meets ALL requests, if only rules that meet none stand before it; a rule that meets some before leaves it NOT_INTERPRETED, and without any rule it is NOT_MATCHED."""
    before = Window.partitionBy("endpoint").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    rows = met.withColumn("before", F.coalesce(F.max("outcome").over(before), F.lit(NONE)))
    first = rows.groupBy("endpoint").agg(F.min(F.when(F.col("outcome") > NONE, F.struct("place", "outcome", "before"))).alias("x"))
    return first.select("endpoint", F.when(F.col("x.outcome") == ALL, F.col("x.place")).alias("place"), F.when(F.col("x").isNull(), "NOT_MATCHED").when(F.col("x.outcome") == SOME, "NOT_INTERPRETED").alias("reason"))


def chosen_chain(applies: DataFrame) -> DataFrame:
    """endpoint, chain, reason: the only chain whose scope covers all of its requests; none, several or a partial one leave it open. applies: endpoint, chain, outcome."""
    found = applies.groupBy("endpoint").agg(F.count_if(F.col("outcome") == ALL).alias("all"), F.count_if(F.col("outcome") == SOME).alias("some"), F.min(F.when(F.col("outcome") == ALL, F.col("chain"))).alias("chain"))
    clear = (F.col("all") == 1) & (F.col("some") == 0)
    return found.select("endpoint", F.when(clear, F.col("chain")).alias("chain"), F.when(~clear, "NOT_INTERPRETED").alias("reason"))


def excluded(endpoints: DataFrame, ignored: DataFrame) -> DataFrame:
    """Endpoints that an ignored pattern may meet: those are gaps, never matched further."""
    return endpoints.join(met_patterns(endpoints, ignored).select("route").distinct(), "route", "left_semi").select(*endpoints.columns)


def endpoints(mappings: DataFrame) -> DataFrame:
    """Endpoints of handlers: every prefix with every path and every verb. mappings: handler, prefixes, paths, verbs (arrays)."""
    one = lambda c, d: F.explode(F.when(F.coalesce(F.size(c), F.lit(0)) > 0, F.col(c)).otherwise(F.array(F.lit(d))))
    rows = mappings.select("handler", one("prefixes", "").alias("prefix"), "paths", "verbs").select("handler", "prefix", one("paths", "").alias("path"), "verbs").select("handler", "prefix", "path", one("verbs", "ANY").alias("verb"))
    route = F.regexp_replace(F.concat(F.lit("/"), "prefix", F.lit("/"), "path"), "/+", "/")
    return rows.select("handler", "verb", route.alias("route"), F.concat(F.lit("endpoint:"), "verb", F.lit(" "), route).alias("endpoint"))


def guards(methods: DataFrame, annotations: DataFrame) -> DataFrame:
    """symbol, expression: the guard of each method, its own or else that of its type. methods (symbol, type), annotations (target, expression)."""
    own = annotations.groupBy(F.col("target").alias("symbol")).agg(F.min("expression").alias("own"))
    of_type = annotations.groupBy(F.col("target").alias("type")).agg(F.min("expression").alias("of_type"))
    rows = methods.join(own, "symbol", "left").join(of_type, "type", "left")
    return rows.select("symbol", F.coalesce("own", "of_type").alias("expression")).where("expression is not null")


def home_made(types: DataFrame, bases: list[str]) -> DataFrame:
    """Types that extend or implement one of the base types of access mechanisms: each is a gap, as what it does isn't interpreted. types (type, supers array)."""
    return types.where(F.arrays_overlap("supers", F.array(*map(F.lit, bases)))).select(F.concat(F.lit("symbol:"), "type").alias("subject"), F.lit("NOT_INTERPRETED").alias("coverage_type"))
