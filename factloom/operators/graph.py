"""Walking the fact graph: reach, bounded tiles with budgets and frontiers, cursors, closures and climbs.

A tile's budgets bound what a level can need, so each level is one join of its
frontier with ranked edges, of at most max_edges + 1 rows an adjacency, and the
order-dependent part (budgets, revisits, cuts) runs over these bounded rows.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.session import cut


@dataclass(frozen=True)
class Step:
    """A relation, followed from subject to object (OUT) or back (IN)."""

    relation: str
    direction: str = "OUT"


def both_ways(relations: list[str]) -> list[Step]:
    return [Step(r, d) for r in relations for d in ("OUT", "IN")]


#: Declared walks: the kinds of anchor that each allows, its depth and its steps (fixed values).
PROFILES = {
    "method-context/1": (("symbol",), 1, [Step("CONTAINS", "IN"), Step("ANNOTATED_WITH"), Step("CALLS"), Step("CALLS", "IN"), Step("IMPLEMENTS"), Step("IMPLEMENTS", "IN")]),
    "calls/1": (("endpoint", "symbol"), 2, [Step("HANDLED_BY"), Step("CALLS"), Step("DISPATCHES_TO")]),
    "structure/1": (("module", "application"), 1, [Step("CONTAINS"), Step("DEPENDS_ON"), Step("BUILT_FROM")]),
    "security/2": (("endpoint",), 2, [Step("HANDLED_BY"), Step("SERVED_BY"), Step("MATCHED_BY"), Step("AUTHORIZED_BY")]),
}


@dataclass(frozen=True)
class Limits:
    nodes: int = 200
    edges: int = 200
    work: int = 2_000
    bytes: int = 32_000


@dataclass(frozen=True)
class Cursor:
    """Where an adjacency goes on: node, number of the step, rank of the last occurrence looked at."""

    node: str
    step: int = 0
    after: int = 0


@dataclass
class Tile:
    nodes: dict[str, dict] = field(default_factory=dict)
    elements: list[dict] = field(default_factory=list)
    cuts: list[dict] = field(default_factory=list)
    stop: dict | None = None
    work: int = 0


def both_directions(edges: DataFrame) -> DataFrame:
    """Edges from both of their ends: anchor, direction, relation, far, occ_id. edges: occ_id, subject, relation, object."""
    ends = [F.struct(F.col(a).alias("anchor"), F.lit(d).alias("direction"), F.col(b).alias("far")) for a, d, b in (("subject", "OUT", "object"), ("object", "IN", "subject"))]
    both = edges.select("relation", "occ_id", F.inline(F.array(*ends)))  # in one pass, whatever made the edges
    return both.where("direction = 'OUT' or anchor is not null").select("anchor", "direction", "relation", "far", "occ_id")


def ranked_both(edges: DataFrame) -> DataFrame:
    """The same with ranks, to be stored: a walk over them reads ranks rather than makes them."""
    return both_directions(edges).withColumn("rank", F.row_number().over(Window.partitionBy("anchor", "direction", "relation").orderBy(F.encode("far", "UTF-16BE"), "occ_id")))


def _adjacencies(edges: DataFrame, wanted: list[tuple[str, int]], steps: list[Step], most: int, start: Cursor) -> dict[tuple[str, int], list]:
    """The first rows of each wanted adjacency; at most `most` rows each, so the result is bounded by the request.

    edges: both directions, with stored ranks or without. Without, only wanted adjacencies
    are ordered, and each task keeps as many rows of one as can be asked for.
    """
    spark = edges.table.spark if hasattr(edges, "edges_of") else edges.sparkSession
    rows = [(node, k, steps[k].relation, steps[k].direction, start.after if (node, k) == (start.node, start.step) else 0) for node, k in wanted]
    asked = spark.createDataFrame(rows, "anchor string, step int, relation string, direction string, after int")
    if hasattr(edges, "edges_of"):
        edges = edges.edges_of(sorted({node for node, _ in wanted}))
    own = edges.where(F.col("relation").isin(*{s.relation for s in steps})).join(F.broadcast(asked), ["anchor", "relation", "direction"])  # a row for each node of a level, which budgets bound
    if "rank" not in edges.columns:
        order = Window.partitionBy("anchor", "direction", "relation", "step").orderBy(F.encode("far", "UTF-16BE"), "occ_id")
        own = own.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(r[-1] for r in rows) + most)
    found = own.where((F.col("rank") > F.col("after")) & (F.col("rank") <= F.col("after") + most))
    out: dict[tuple[str, int], list] = {}
    for r in found.select("anchor", "step", "rank", "far", "occ_id").collect():
        out.setdefault((r.anchor, r.step), []).append((r.rank, r.far, r.occ_id))
    for rows in out.values():
        rows.sort()
    return out


class _Stop(Exception):
    """A budget refused: the whole tile ends here."""


def tile(edges: DataFrame, root: str, steps: list[Step], depth: int, limits: Limits = Limits(), fanout: int | None = None, capable: set[str] | None = None, start: Cursor | None = None, size=None, is_node=lambda far: far is not None and ":" in far) -> Tile:
    """Breadth first, node by node, step by step, in rank order; the first budget that refuses ends the tile, a full fan-out only its node. edges: from both_directions() or ranked_both(), or stored ones (sources.adjacency), of which only files with asked nodes are read.

    An occurrence is shown once, a node entered once; a node met again is marked as a
    revisit. capable: relations that some producer can state; others are skipped without
    a read. size: bytes of an element as shown. A literal far end is shown, not entered.
    """
    own, start = Tile(), start or Cursor(root)
    own.nodes[root] = {"level": 0, "by": None, "parents": 0, "expanded": False}
    shown: set = set()
    used = 0
    size = size or (lambda e: len(json.dumps(e, ensure_ascii=False, separators=(",", ":")).encode()))
    able = lambda s: capable is None or s.relation in capable

    def stop(node: str, k: int, after: int, why: str, seen: bool) -> None:
        own.stop = {"node": node, "step": k, "after": after, "reason": why, "found": seen}
        raise _Stop

    def visit(node: str, rows: dict) -> list[str]:
        nonlocal used
        fresh, given, level = [], 0, own.nodes[node]["level"]
        first = start.step if node == root else 0
        for k in range(first, len(steps)):
            after = start.after if (node, k) == (start.node, start.step) else 0
            left = iter(rows.get((node, k), []))
            while True:
                if own.work >= limits.work:
                    stop(node, k, after, "WORK", False)
                if len(own.elements) >= limits.edges:
                    stop(node, k, after, "EDGES", False)
                if not able(steps[k]):
                    break
                room = limits.edges - len(own.elements)
                if fanout is not None:
                    if given == fanout:
                        own.cuts.append({"node": node, "step": k, "after": after, "reason": "FANOUT", "found": False})
                        return fresh
                    room = min(room, fanout - given)
                own.work += 1
                batch = [x for _, x in zip(range(room + 1), left, strict=False)]
                for rank, far, occ in batch:
                    if occ in shown:
                        after = rank
                        continue
                    if fanout is not None and given >= fanout:
                        own.cuts.append({"node": node, "step": k, "after": after, "reason": "FANOUT", "found": True})
                        return fresh
                    enters = is_node(far)
                    new = enters and far not in own.nodes
                    if len(own.elements) >= limits.edges:
                        stop(node, k, after, "EDGES", True)
                    if new and len(own.nodes) >= limits.nodes:
                        stop(node, k, after, "NODES", True)
                    element = {"occ_id": occ, "node": node, "step": k, "level": level + 1, "far": far, "rank": rank, "revisit": enters and not new}
                    if used + size(element) > limits.bytes:
                        stop(node, k, after, "BYTES", True)
                    used += size(element)
                    own.elements.append(element)
                    shown.add(occ)
                    if new:
                        own.nodes[far] = {"level": level + 1, "by": len(own.elements) - 1, "parents": 1, "expanded": False}
                        fresh.append(far)
                    elif enters:
                        own.nodes[far]["parents"] += 1
                    after, given = rank, given + 1
                if len(batch) <= room:
                    break
        own.nodes[node]["expanded"] = True
        return fresh

    frontier = [root]
    try:
        for _ in range(depth):
            wanted = [(n, k) for n in frontier for k, s in enumerate(steps) if able(s)]
            rows = _adjacencies(edges, wanted, steps, limits.edges + 1, start) if wanted else {}
            frontier = [f for n in frontier for f in visit(n, rows)]
            if not frontier:
                break
    except _Stop:
        pass
    return own


def profiled(edges: DataFrame, root: str, profile: str, **more) -> Tile:
    """The tile of a declared walk; an anchor of another kind is refused."""
    anchors, depth, steps = PROFILES[profile]
    if root.partition(":")[0] not in anchors:
        raise ValueError(f"{profile} starts from {', '.join(anchors)}")
    return tile(edges, root, steps, more.pop("depth", depth), **more)


def unexpanded(own: Tile, depth: int) -> list[tuple[str, str]]:
    """Nodes that were neither expanded nor cut: DEPTH, or NOT_REACHED for those behind a stop."""
    cut = {c["node"] for c in own.cuts} | ({own.stop["node"]} if own.stop else set())
    return [(n, "DEPTH" if v["level"] >= depth else "NOT_REACHED") for n, v in own.nodes.items() if not v["expanded"] and n not in cut]


def paths(own: Tile) -> dict[str, list]:
    """Of each node the occurrences that led to it, from the root on."""
    out: dict[str, list] = {}
    for n, v in own.nodes.items():  # a node stands behind the one that it was found from
        out[n] = [] if v["by"] is None else [*out[own.elements[v["by"]]["node"]], own.elements[v["by"]]["occ_id"]]
    return out


def elements_frame(spark, own: Tile) -> DataFrame:
    schema = "seq int, occ_id long, node string, step int, level int, far string, rank int, revisit boolean"
    return spark.createDataFrame([(i, e["occ_id"], e["node"], e["step"], e["level"], e["far"], e["rank"], e["revisit"]) for i, e in enumerate(own.elements)], schema)


def guarded(facts: DataFrame, walk: Callable[[], Tile]) -> Tile:
    """The tile of a walk over facts (occ_id) whose generation didn't change meanwhile; else it is refused."""
    latest = lambda: facts.agg(F.coalesce(F.max("occ_id"), F.lit(0))).first()[0]
    before = latest()
    own = walk()
    if latest() != before:
        raise ValueError("facts were added during the walk")
    return own


def cursor_token(cursor: Cursor, snapshot: str, parameters: dict, revision: int, version: int = 2) -> str:
    """An opaque continuation, bound to snapshot and fact generation, and to the parameters: all of them, or, in version 1, those that version 1 had (depth and steps)."""
    if version not in (1, 2):
        raise ValueError("unknown version of a continuation")
    own = parameters if version == 2 else {k: v for k, v in parameters.items() if k in ("depth", "steps")}
    bound = hashlib.sha256(json.dumps([version, snapshot, own, revision], sort_keys=True).encode()).hexdigest()[:16]
    return base64.urlsafe_b64encode(json.dumps([version, bound, cursor.node, cursor.step, cursor.after]).encode()).decode().rstrip("=")


def read_cursor(token: str, snapshot: str, parameters: dict, revision: int) -> Cursor:
    """The cursor of a token; one made for anything else is refused."""
    try:
        version, bound, node, step, after = json.loads(base64.urlsafe_b64decode(token + "=" * (-len(token) % 4)))
    except ValueError:
        raise ValueError("not a continuation") from None
    if token != cursor_token(Cursor(node, step, after), snapshot, parameters, revision, version):
        raise ValueError("the continuation belongs to another request or generation")
    return Cursor(node, step, after)


def reach(edges: DataFrame, start: DataFrame, depth: int | None = None, *, guard: str | None = None) -> DataFrame:
    """reference, level: what edges (src, dst) lead to within `depth` steps (None: any), at the smallest level. start: reference.

    One join a level of the new nodes only; visited nodes are taken off by an anti-join,
    and each level is written, so it is computed once and has no lineage. It ends when a
    level finds nothing. guard: a condition on edges.
    """
    steps = (edges.where(guard) if guard else edges).select("src", "dst")
    seen = start.select("reference").distinct().withColumn("level", F.lit(0))
    front, level = seen, 0
    while depth is None or level < depth:
        level += 1
        found = front.join(steps, front["reference"] == steps["src"]).select(F.col("dst").alias("reference")).distinct()
        front = cut(found.join(seen.select("reference"), "reference", "left_anti").withColumn("level", F.lit(level)), "reach")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def closure_with_paths(edges: DataFrame, start: DataFrame) -> DataFrame:
    """reference, path: everything that edges lead to, each with one shortest path, the smallest of equals; ends when a round finds nothing, however long paths are."""
    seen = front = start.select("reference", F.array("reference").alias("path"))
    while True:
        found = front.join(edges.select("src", "dst"), F.col("reference") == F.col("src")).select(F.col("dst").alias("reference"), F.concat("path", F.array("dst")).alias("path"))
        front = cut(found.groupBy("reference").agg(F.min("path").alias("path")).join(seen.select("reference"), "reference", "left_anti"), "closure")
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)


def climb(holders: DataFrame, start: DataFrame, kind: str = "file", most: int = 8) -> DataFrame:
    """reference, holder: up the unique CONTAINS holder until one of the kind, at most `most` levels; null where a level has none or several.

    holders: subject (holder), object (held).
    """
    single = holders.groupBy(F.col("object").alias("at")).agg(F.min("subject").alias("up"), F.countDistinct("subject").alias("n")).where("n = 1").drop("n")
    now = start.select("reference", F.col("reference").alias("at"))
    for _ in range(most):
        done = F.startswith("at", F.lit(f"{kind}:"))
        now = now.join(single, "at", "left").select("reference", F.when(done, F.col("at")).otherwise(F.col("up")).alias("at"))
    return now.select("reference", F.when(F.startswith("at", F.lit(f"{kind}:")), F.col("at")).alias("holder"))


def nearest_single(candidates: DataFrame, keys: list[str], parts: int | None = None) -> DataFrame:
    """Of each key the candidate of the nearest level, if that level has just one.

    parts: partitions that the rows are dealt to by key, for a large table; then they are
    grouped where they are, without another shuffle.
    """
    dealt = candidates if parts is None else candidates.repartition(parts, *keys)
    levels = dealt.groupBy(*keys, "level").agg(F.min("candidate").alias("candidate"), F.max("candidate").alias("last"))
    best = levels.groupBy(*keys).agg(F.min(F.struct("level", "candidate", "last")).alias("x"))
    return best.select(*keys, F.when(F.col("x.candidate") == F.col("x.last"), F.col("x.candidate")).alias("candidate"), F.when(F.col("x.candidate") != F.col("x.last"), "AMBIGUOUS").alias("reason"))


def analysis_frontier(steps: list[Step], catalogs: DataFrame, executions: DataFrame, unread: DataFrame) -> DataFrame:
    """Why a walk may lack edges as a whole: CONTEXT for a relation that no successful producer states, KNOWLEDGE for a language that its producers don't read.

    catalogs: producer_id, relation; executions: producer_id, status; unread: producer_id, language.
    """
    spark = catalogs.sparkSession
    asked = spark.createDataFrame([(r,) for r in dict.fromkeys(s.relation for s in steps)], "relation string")
    able = catalogs.join(executions.where("status = 'SUCCESS'").select("producer_id").distinct(), "producer_id")
    context = asked.join(able.select("relation").distinct(), "relation", "left_anti").select("relation", F.lit("CONTEXT").alias("kind"), F.lit(None).cast("string").alias("language"))
    gaps = able.join(F.broadcast(asked), "relation").join(unread, "producer_id").select("relation", F.lit("KNOWLEDGE").alias("kind"), "language").distinct()
    return context.unionByName(gaps)


def local_frontier(nodes: DataFrame, proofs: DataFrame, gaps: DataFrame, most: int = 2_000) -> DataFrame:
    """Coverage gaps (subject, reason) of a tile's nodes (reference) and of the files that prove its edges (path): at most `most` references, which is the tile's own bound."""
    asked = nodes.select(F.col("reference").alias("subject")).unionByName(proofs.select(F.concat(F.lit("file:"), F.col("path")).alias("subject"))).distinct().orderBy("subject").limit(most)
    return gaps.join(F.broadcast(asked), "subject", "left_semi").orderBy("subject", "reason")


def call_paths(edges: DataFrame, endpoint: str, depth: int = 4, methods: int = 30) -> Tile:
    """The walk of a route: its handlers, then what these call."""
    return tile(edges, endpoint, [Step("HANDLED_BY"), Step("CALLS")], depth, Limits(nodes=methods + 1, edges=1_000, bytes=1_000_000))


def rules_of_chains(matched: DataFrame, validated: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules of the matched patterns of an endpoint's validated chains: matched (endpoint, pattern, filter_chain), validated (endpoint, filter_chain), rules (pattern, filter_chain, authority)."""
    return matched.join(validated, ["endpoint", "filter_chain"]).join(rules, ["pattern", "filter_chain"])


def tile_view(own: Tile, fields: tuple[str, ...] = ("node", "far", "level", "revisit")) -> list[dict]:
    """A tile's elements with the listed fields alone."""
    return [{f: e[f] for f in fields} for e in own.elements]
