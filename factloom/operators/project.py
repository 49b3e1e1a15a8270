"""Commits: log order, selection by request; routes with what is attached to them; line links."""

from __future__ import annotations

import bisect
import contextlib
from graphlib import CycleError, TopologicalSorter

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.dates import Request, in_period


def ordered(commits: dict[str, float], parents: dict[str, list[str]]) -> list[str]:
    """Children before parents; of what is free the newest first, then the smaller id. Unknown parents are ignored; commits of a cycle, and what only they lead to, are left out."""
    graph = TopologicalSorter({c: () for c in commits})
    for child in commits:
        for parent in set(parents.get(child, ())) & commits.keys():
            graph.add(parent, child)
    with contextlib.suppress(CycleError):
        graph.prepare()
    free: list[tuple[float, str]] = []
    out = []
    while graph.is_active():
        for commit in graph.get_ready():
            bisect.insort(free, (-commits[commit], commit))
        out.append(free.pop(0)[1])
        graph.done(out[-1])
    return out


def log_order(history: DataFrame) -> DataFrame:
    """repository, sha, place: the order of each repository's log. history: repository, sha, moment (seconds), parents.

    The order is sequential by nature, so a repository's commits (ids, times and parents
    only) meet in one task; repositories are independent of each other.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        order = ordered(dict(zip(group.sha, group.moment, strict=True)), {s: list(p) if p is not None else [] for s, p in zip(group.sha, group.parents, strict=True)})
        return pd.DataFrame({"repository": group.repository.iloc[0], "sha": order, "place": range(len(order))})

    return history.select("repository", "sha", "moment", "parents").groupBy("repository").applyInPandas(run, "repository string, sha string, place long")


def select_commits(placed: DataFrame, request: Request) -> DataFrame:
    """Commits that a request asks for, in log order. placed: sha, place, authored_at. GLOBAL and ambiguous or unknown ids select none."""
    if request.kind == "COMMIT":
        found = placed.where(F.startswith("sha", F.lit(request.commit)))
        return found.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))).where("n = 1").drop("n") if request.commit else placed.limit(0)
    if request.kind == "GLOBAL":
        return placed.limit(0)
    found = placed.where(in_period(F.col("authored_at"), request.since, request.until)).orderBy("place")
    return found.limit(request.count) if request.kind == "LATEST" else found


def by_prefix(commits: DataFrame, prefix: str, column: str = "sha") -> DataFrame:
    """NOT_FOUND, SELECTED or AMBIGUOUS, and how many commits begin so."""
    return commits.where(F.startswith(column, F.lit(prefix))).agg(F.count(F.lit(1)).alias("n")).select(F.when(F.col("n") == 0, "NOT_FOUND").when(F.col("n") == 1, "SELECTED").otherwise("AMBIGUOUS").alias("status"), "n")


def attached(commits: DataFrame, facts: DataFrame) -> DataFrame:
    """Commits with the number of facts of each relation that have them as subject."""
    counts = facts.where(F.startswith("subject", F.lit("commit:"))).groupBy(F.substr("subject", F.lit(8)).alias("sha"), "relation").agg(F.count(F.lit(1)).alias("n"))
    return commits.join(counts.groupBy("sha").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("relation", "n")))).alias("facts")), "sha", "left")


def routes(handled: DataFrame, served: DataFrame, matched: DataFrame, rules: DataFrame, guards: DataFrame) -> DataFrame:
    """A row for each endpoint and handler with its applications, rules and guards.

    handled: endpoint, handler; served: endpoint, application; matched: endpoint, pattern, filter_chain;
    rules: pattern, filter_chain, authority; guards: symbol (method or owner type), authority.
    Each side is folded to one row a key before it is joined, so no join multiplies rows.
    """
    owner = F.substring_index("handler", "#", 1)
    apps = served.groupBy("endpoint").agg(F.array_sort(F.collect_set("application")).alias("applications"))
    told = matched.join(rules, ["pattern", "filter_chain"], "left").groupBy("endpoint").agg(F.array_sort(F.collect_set(F.struct("pattern", "filter_chain", "authority"))).alias("rules"))
    held = guards.groupBy("symbol").agg(F.array_sort(F.collect_set("authority")).alias("guards"))
    own = held.select(F.col("symbol").alias("handler"), F.col("guards").alias("method_guards"))
    of_type = held.select(F.col("symbol").alias("owner"), F.col("guards").alias("type_guards"))
    rows = handled.withColumn("owner", owner).join(apps, "endpoint", "left").join(told, "endpoint", "left").join(own, "handler", "left").join(of_type, "owner", "left")
    verb, path = F.substring_index(F.substr("endpoint", F.lit(10)), " ", 1), F.substring_index("endpoint", " ", -1)
    out = rows.select("endpoint", "handler", "applications", "rules", F.coalesce("method_guards", "type_guards").alias("guards"), verb.alias("verb"), path.alias("path"))
    return out.orderBy("path", "verb")


def linked_lines(facts: DataFrame, lines: DataFrame) -> DataFrame:
    """Facts whose evidence spans a changed line: facts (fact_id, path, line_start, line_end), lines (path, line).

    The overlap is an equality on (path, bin of lines): a span is dealt to the bins that it
    touches, a line to its own, so hot paths spread over their bins and nothing is crossed.
    """
    width = 64
    spans = facts.select("*", F.explode(F.sequence(F.floor(F.col("line_start") / width), F.floor(F.col("line_end") / width))).alias("_bin"))
    changed = lines.select("path", "line").distinct().withColumn("_bin", F.floor(F.col("line") / width))
    return spans.join(changed, ["path", "_bin"]).where("line between line_start and line_end").groupBy(*[c for c in facts.columns]).agg(F.count(F.lit(1)).alias("changed_lines"))


def evidence_gaps(proofs: DataFrame, gaps: DataFrame) -> DataFrame:
    """Nodes whose evidence lies in a file with a coverage gap: proofs (node, path), gaps (subject file:path, reason)."""
    return proofs.select("node", F.concat(F.lit("file:"), F.col("path")).alias("subject")).distinct().join(gaps, "subject")


def history_facts(log: DataFrame, repository: str) -> DataFrame:
    """HAS_COMMIT, AUTHORED_BY, CHILD_OF and CHANGES of commits: sha, author_name, author_email, parents, changes (array of change, path, old_path)."""
    commit = F.concat(F.lit("commit:"), F.col("sha"))
    none = F.lit(None).cast("string")
    fact = lambda df, s, rel, o, q: df.select(F.lit("ASSERTION").alias("kind"), s.alias("subject"), F.lit(rel).alias("relation"), o.alias("object"), q.alias("qualifiers"))
    has = fact(log, F.lit(f"repository:{repository}"), "HAS_COMMIT", commit, none)
    by = fact(log, commit, "AUTHORED_BY", F.concat(F.lit("person:"), F.lower("author_email")), F.to_json(F.struct(F.col("author_name").alias("name"))))
    child = fact(log.select("sha", F.posexplode("parents").alias("position", "parent")), commit, "CHILD_OF", F.concat(F.lit("commit:"), F.col("parent")), F.to_json(F.struct("position")))
    changed = fact(log.select("sha", F.explode("changes").alias("c")), commit, "CHANGES", F.concat(F.lit("file:"), F.col("c.path")), F.to_json(F.struct("c.change", "c.old_path")))
    return has.unionByName(by).unionByName(child).unionByName(changed)


def within_budget(log: DataFrame, most: int = 50_000) -> DataFrame:
    """A coverage row that says how many commits beyond the budget were left uninterpreted; none within it."""
    return log.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(F.lit("COVERAGE").alias("kind"), F.lit("NOT_INTERPRETED").alias("coverage_type"), (F.col("n") - most).alias("left_out"))

