"""Tiles of many roots at once: the walk of graph.tile(), level by level for all roots in Spark.

A level's visits (node, step) and the occurrences that they find are put in the order in
which a single walk would meet them. Budgets are running sums over that order, revisits
and repeated occurrences are found by joins and windows, and the first refusal of a root is
a minimum. Windows belong to one root and level, whose rows the budgets bound.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.graph import Limits, Step
from factloom.session import cut

_ELEMENTS = "root string, seq int, occ_id long, node string, step int, level int, far string, rank int, revisit boolean"
_NODES = "root string, node string, level int, pos int, by int, expanded boolean"
_CUTS = "root string, node string, step int, after int, reason string, found boolean"


@dataclass
class Tiles:
    """elements (in order of seq), nodes (by: seq of the element that led there), cuts (full fan-outs), stops (the first refusal of a root), all keyed by root."""

    elements: DataFrame
    nodes: DataFrame
    cuts: DataFrame
    stops: DataFrame


def _key(rank: Column | str, order: int = 0) -> Column:
    """A place in a root's order: what it compares by first is the node, then the step, then the rank."""
    return F.struct(F.col("pos").alias("pos"), F.col("step").alias("step"), (F.col(rank) if isinstance(rank, str) else rank).cast("int").alias("rank"), F.lit(order).alias("order"))


def _repeats(rows: DataFrame, fanout: int | None) -> DataFrame:
    """With `repeated`: whether an occurrence was shown at an earlier level, or earlier in this one by a node whose fan-out wasn't full.

    What a node shows depends on nodes before it alone, so rounds that start from the
    earlier levels come to rest; each settles one node more at least, mostly all.
    """
    node, same = Window.partitionBy("root", "pos").orderBy("step", "rank"), Window.partitionBy("root", "occ_id")
    rows = cut(rows.withColumn("repeated", F.col("shown")), "tile")
    while True:
        given = F.sum((~F.col("repeated")).cast("int")).over(node)
        shows = ~F.col("repeated") & (F.lit(True) if fanout is None else given <= fanout)
        rated = rows.withColumn("_shows", shows).withColumn("_first", F.min(F.when(F.col("_shows"), _key("rank"))).over(same))
        again = rated.withColumn("_now", F.col("shown") | F.coalesce(F.col("_first") < _key("rank"), F.lit(False)))
        again = cut(again, "tile")
        settled = again.where("_now <> repeated").isEmpty()
        rows = again.withColumn("repeated", F.col("_now")).drop("_shows", "_first", "_now")
        if settled:
            return rows


def _reads(rows: Column, room: Column) -> Column:
    """How a visit's rows are read when some were shown before: `reads`, and `full`, the rank after which room was used up with nothing read beyond (null: not so).

    A read takes one row more than there is room for. If all rows are new the last one finds
    the budget full; with one repeated row in it the budget is full behind the last; with
    more the walk reads again.
    """
    start = F.struct(room.cast("int").alias("room"), F.lit(0).alias("n"), F.lit(0).alias("old"), F.lit(1).alias("reads"), F.lit(None).cast("int").alias("full"))

    def step(a: Column, row: Column) -> Column:
        n, old = a["n"] + 1, a["old"] + row["repeated"].cast("int")
        ends = (n == a["room"] + 1) & a["full"].isNull() & (old > 0)
        more = ends & (old > 1)
        return F.struct(
            F.when(more, old - 1).otherwise(a["room"]).alias("room"),
            F.when(more, 0).otherwise(n).alias("n"),
            F.when(more, 0).otherwise(old).alias("old"),
            (a["reads"] + more.cast("int")).alias("reads"),
            F.when(ends & (old == 1), row["rank"]).otherwise(a["full"]).alias("full"),
        )

    return F.aggregate(rows, start, step)


def tiles(edges: DataFrame, roots: DataFrame, steps: list[Step], depth: int, limits: Limits = Limits(), fanout: int | None = None, capable: set[str] | None = None) -> Tiles:
    """The tiles that graph.tile() gives for each root (column root, distinct, not null), of edges with ranks (ranked_both(), or stored ones).

    One difference: a budget of reads that runs out between two reads of one adjacency (only
    where occurrences repeat) ends the tile at the next visit. Levels end when no root has
    nodes to enter.
    """
    spark = edges.sparkSession
    able = [capable is None or s.relation in capable for s in steps]
    many = len({s.relation for s in steps}) < len(steps)
    most = limits.edges + 1 if many or fanout is None else min(limits.edges, fanout) + 1
    own = edges.where(F.col("relation").isin(*{s.relation for s in steps}) & (F.col("rank") <= most)).select("direction", "anchor", "relation", "rank", "far", "occ_id")
    plan = F.array(*(F.struct(F.lit(k).alias("step"), F.lit(s.relation).alias("relation"), F.lit(s.direction).alias("direction"), F.lit(a).alias("able")) for k, (s, a) in enumerate(zip(steps, able, strict=True))))

    roots = roots.select("root").where("root is not null").distinct()
    front = cut(roots.select("root", F.col("root").alias("node"), F.lit(0).alias("pos")), "tile")
    totals = cut(roots.select("root", F.lit(1).alias("n_nodes"), F.lit(0).alias("n_elements"), F.lit(0).cast("long").alias("n_bytes"), F.lit(0).alias("n_work")), "tile")
    seen = cut(front.select("root", "node"), "tile")
    elements, cuts, stops = (spark.createDataFrame([], s) for s in (_ELEMENTS, _CUTS, _CUTS))
    nodes = front.select("root", "node", F.lit(0).alias("level"), "pos", F.lit(None).cast("int").alias("by"), F.lit(False).alias("expanded"))
    in_node = Window.partitionBy("root", "pos").orderBy("step", "rank")
    in_root = Window.partitionBy("root").orderBy("pos", "step", "rank")
    for level in range(depth):
        visits = front.select("root", "node", "pos", F.inline(plan))
        met = visits.where("able").join(own.withColumnRenamed("anchor", "node"), ["node", "relation", "direction"])
        if many:
            before = elements.select("root", "occ_id", F.lit(True).alias("shown"))
            rows = _repeats(met.join(before, ["root", "occ_id"], "left").fillna(False, ["shown"]), fanout)
        else:
            rows = met.withColumn("repeated", F.lit(False))
        given = F.sum((~F.col("repeated")).cast("int")).over(in_node)
        rows = cut(rows.withColumn("given", given).withColumn("fits", ~F.col("repeated") & (F.lit(True) if fanout is None else F.col("given") <= fanout)), "tile")

        # budgets over the rows that a node's fan-out lets through
        known = seen.select("root", F.col("node").alias("far"), F.lit(True).alias("known"))
        through = rows.where("fits").join(known, ["root", "far"], "left")
        enters = F.coalesce(F.contains("far", F.lit(":")), F.lit(False))
        first = F.row_number().over(Window.partitionBy("root", "far").orderBy("pos", "step", "rank")) == 1
        through = through.withColumn("new", enters & F.col("known").isNull() & first).withColumn("revisit", enters & ~F.col("new"))
        shape = F.struct("occ_id", "node", "step", F.lit(level + 1).alias("level"), "far", "rank", "revisit")
        through = through.withColumn("size", F.octet_length(F.to_json(shape, {"ignoreNullFields": "false"}))).join(totals, "root")
        counted = through.withColumns({"e": F.col("n_elements") + F.row_number().over(in_root), "n": F.col("n_nodes") + F.sum(F.col("new").cast("int")).over(in_root), "b": F.col("n_bytes") + F.sum("size").over(in_root)})
        reason = F.when(F.col("e") > limits.edges, "EDGES").when(F.col("new") & (F.col("n") > limits.nodes), "NODES").when(F.col("b") > limits.bytes, "BYTES")
        counted = cut(counted.withColumn("reason", reason), "tile")
        refused = counted.where("reason is not null").select("root", _key("rank").alias("key"), "node", "step", (F.col("rank") - 1).alias("after"), "reason", F.lit(True).alias("found"))

        # visits: what their nodes and roots had shown when they began
        full = F.lit(None).cast("int") if fanout is None else F.min(F.when(~F.col("repeated") & (F.col("given") == fanout + 1), F.col("rank")))
        by_visit = rows.groupBy("root", "pos", "step").agg(F.count_if("fits").cast("int").alias("shown_here"), full.alias("beyond"), F.array_sort(F.collect_list(F.struct("rank", "repeated"))).alias("read"))
        begun = visits.join(by_visit, ["root", "pos", "step"], "left").fillna(0, ["shown_here"]).join(totals, "root")
        earlier = Window.partitionBy("root", "pos").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
        former = Window.partitionBy("root").orderBy("pos", "step").rowsBetween(Window.unboundedPreceding, -1)
        none = lambda c: F.coalesce(c, F.lit(0))
        begun = begun.withColumns({"node_had": none(F.sum("shown_here").over(earlier)), "root_had": F.col("n_elements") + none(F.sum("shown_here").over(former))})
        filled = F.lit(False) if fanout is None else F.col("able") & (F.col("node_had") >= fanout)
        begun = begun.withColumn("filled", filled)
        if many:
            room = F.lit(limits.edges) - F.col("root_had")
            room = room if fanout is None else F.least(room, F.lit(fanout) - F.col("node_had"))
            begun = begun.withColumn("went", _reads(F.coalesce("read", F.array().cast("array<struct<rank:int,repeated:boolean>>")), room))
            begun = begun.withColumn("full_at", F.col("went.full")).withColumn("reads", F.col("went.reads"))
        else:
            begun = begun.withColumn("full_at", F.lit(None).cast("int")).withColumn("reads", F.lit(1))
        by_edges = F.lit(True) if fanout is None else F.lit(limits.edges) - F.col("root_had") <= F.lit(fanout) - F.col("node_had")
        over = F.col("filled") | F.col("beyond").isNotNull() | (F.col("full_at").isNotNull() & ~by_edges)
        begun = begun.withColumn("over", over).withColumn("reached", ~F.coalesce(F.max("over").over(earlier), F.lit(False)))
        reads = F.when(F.col("reached") & F.col("able") & ~F.col("filled"), F.col("reads")).otherwise(0)
        begun = cut(begun.withColumn("worked", F.col("n_work") + none(F.sum(reads).over(former))).withColumn("will_read", reads).withColumn("by_edges", by_edges), "tile")
        begun = begun.where("reached")
        why = F.when(F.col("worked") >= limits.work, "WORK").when(F.col("root_had") >= limits.edges, "EDGES")
        at_start = begun.withColumn("reason", why).where("reason is not null").select("root", _key(F.lit(0)).alias("key"), "node", "step", F.lit(0).alias("after"), "reason", F.lit(False).alias("found"))
        between = begun.where("full_at is not null and by_edges and able").select("root", _key("full_at", 1).alias("key"), "node", "step", F.col("full_at").alias("after"), F.lit("EDGES").alias("reason"), F.lit(False).alias("found"))
        ends = refused.unionByName(at_start).unionByName(between).groupBy("root").agg(F.min_by(F.struct("node", "step", "after", "reason", "found"), "key").alias("end"), F.min("key").alias("stop"))
        ends = cut(ends, "tile")

        # fan-outs that were full: before a visit, behind a repeated row, or at one row more
        quiet = F.col("full_at").isNotNull() & ~F.col("by_edges")
        cut_key = F.when(F.col("filled"), _key(F.lit(0))).when(quiet, _key("full_at", 1)).when(F.col("beyond").isNotNull(), _key("beyond"))
        cut_after = F.when(F.col("filled"), 0).when(quiet, F.col("full_at")).otherwise(F.col("beyond") - 1)
        made = begun.withColumn("key", cut_key).where("key is not null").select("root", "key", "pos", "node", "step", cut_after.cast("int").alias("after"), F.lit("FANOUT").alias("reason"), (~F.col("filled") & ~quiet).alias("found"))
        made = cut(made.join(ends.select("root", "stop"), "root", "left").where("stop is null or key < stop"), "tile")

        kept = counted.withColumn("key", _key("rank")).join(ends.select("root", "stop"), "root", "left").where("stop is null or key < stop")
        kept = cut(kept.select("root", (F.col("e") - 1).alias("seq"), "occ_id", "node", "step", F.lit(level + 1).alias("level"), "far", "rank", "revisit", "new", "size"), "tile")
        done = front.join(made.select("root", "pos").distinct().withColumn("cut", F.lit(True)), ["root", "pos"], "left").join(ends.select("root", "stop"), "root", "left")
        done = done.where("cut is null and (stop is null or stop.pos > pos)").select("root", "node", F.lit(True).alias("done"))
        entered = kept.where("new").select("root", F.col("far").alias("node"), F.lit(level + 1).alias("level"), F.col("seq").alias("pos"), F.col("seq").alias("by"), F.lit(False).alias("expanded"))
        nodes = nodes.join(done, ["root", "node"], "left").withColumn("expanded", F.col("expanded") | F.coalesce("done", F.lit(False))).drop("done").unionByName(entered)
        nodes = cut(nodes.select("root", "node", "level", "pos", "by", "expanded"), "tile")
        elements = elements.unionByName(kept.drop("new", "size"))
        cuts = cuts.unionByName(made.select("root", "node", "step", "after", "reason", "found"))
        stops = stops.unionByName(ends.select("root", "end.*"))

        spent = kept.groupBy("root").agg(F.count_if("new").cast("int").alias("a"), F.count(F.lit(1)).cast("int").alias("c"), F.sum("size").alias("d"))
        worked = begun.groupBy("root").agg(F.sum("will_read").cast("int").alias("w"))
        totals = totals.join(ends.select("root"), "root", "left_anti").join(spent, "root", "left").join(worked, "root", "left").fillna(0, ["a", "c", "d", "w"])
        totals = cut(totals.select("root", (F.col("n_nodes") + F.col("a")).alias("n_nodes"), (F.col("n_elements") + F.col("c")).alias("n_elements"), (F.col("n_bytes") + F.col("d")).alias("n_bytes"), (F.col("n_work") + F.col("w")).alias("n_work")), "tile")
        seen = nodes.select("root", "node")
        front = cut(nodes.where(F.col("level") == level + 1).join(totals.select("root"), "root", "left_semi").select("root", "node", "pos"), "tile")
        if front.isEmpty():
            break
    return Tiles(elements, nodes, cuts, stops)


def paths(found: Tiles) -> DataFrame:
    """root, node, path: of each node the occurrences that led to it, from the root on."""
    led = found.elements.select("root", F.col("seq").alias("by"), F.col("node").alias("parent"), "occ_id")
    steps = cut(found.nodes.join(led, ["root", "by"], "left").select("root", "node", "level", "parent", "occ_id"), "paths")
    out = steps.where("level = 0").select("root", "node", F.array().cast("array<long>").alias("path"))
    front, level = out, 0
    while True:
        level += 1
        own = steps.where(F.col("level") == level).join(front.select("root", F.col("node").alias("parent"), "path"), ["root", "parent"])
        front = cut(own.select("root", "node", F.concat("path", F.array("occ_id")).alias("path")), "paths")
        if front.isEmpty():
            return out
        out = out.unionByName(front)


def unexpanded(found: Tiles, depth: int) -> DataFrame:
    """root, node, why: nodes that were neither expanded nor cut: DEPTH, or NOT_REACHED for those behind a stop."""
    ended = found.cuts.select("root", "node").unionByName(found.stops.select("root", "node")).distinct()
    left = found.nodes.where("not expanded").join(ended, ["root", "node"], "left_anti")
    return left.select("root", "node", F.when(F.col("level") >= depth, "DEPTH").otherwise("NOT_REACHED").alias("why"))
