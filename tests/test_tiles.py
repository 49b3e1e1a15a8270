"""Tiles of many roots against the walk of one."""

import random

import pytest

from factloom.operators import graph, tiles
from factloom.operators.graph import Limits, Step


@pytest.fixture(scope="module")
def ranked(spark):
    rng = random.Random(11)
    rows = [(i, f"n:{int(rng.random() ** 2 * 30):02d}", rng.choice("RST"), rng.choice([f"n:{rng.randint(0, 30):02d}", f"literal {i % 9}", None]) if rng.random() < 0.2 else f"n:{int(rng.random() ** 2 * 30):02d}") for i in range(260)]
    out = graph.ranked_both(spark.createDataFrame(rows, "occ_id long, subject string, relation string, object string"))
    return out.cache()


ROOTS = ["n:00", "n:07", "n:29", "none:1"]
ONE_WAY = [Step("R"), Step("S", "IN"), Step("T")]
TWO_WAY = [Step("R"), Step("R", "IN"), Step("S", "IN"), Step("S")]


@pytest.mark.parametrize(
    ("steps", "depth", "limits", "fanout", "capable"),
    [
        (ONE_WAY, 3, Limits(nodes=12, edges=40), 4, None),
        (ONE_WAY, 2, Limits(edges=9), 3, {"R", "T"}),
        (ONE_WAY, 2, Limits(bytes=900), None, None),
        (ONE_WAY, 3, Limits(work=5), 2, None),
        (TWO_WAY, 3, Limits(nodes=25, edges=60), 5, None),
        (TWO_WAY, 2, Limits(edges=17), None, None),
        (TWO_WAY, 3, Limits(edges=33), 4, {"R"}),
    ],
)
def test_many_roots_as_one_by_one(spark, ranked, steps, depth, limits, fanout, capable):
    found = tiles.tiles(ranked, spark.createDataFrame([(r,) for r in ROOTS], "root string"), steps, depth, limits, fanout, capable)
    rows = {name: [r.asDict() for r in getattr(found, name).collect()] for name in ("elements", "nodes", "cuts", "stops")}
    paths = {(r.root, r.node): list(r.path) for r in tiles.paths(found).collect()}
    left = {(r.root, r.node): r.why for r in tiles.unexpanded(found, depth).collect()}
    for root in ROOTS:
        own = graph.tile(ranked, root, steps, depth, limits, fanout, capable)
        of = lambda name: [{k: v for k, v in r.items() if k != "root"} for r in rows[name] if r["root"] == root]  # noqa: E731, B023
        assert [{k: v for k, v in e.items() if k != "seq"} for e in sorted(of("elements"), key=lambda e: e["seq"])] == own.elements, root
        assert {n["node"]: (n["level"], n["by"], n["expanded"]) for n in of("nodes")} == {n: (v["level"], v["by"], v["expanded"]) for n, v in own.nodes.items()}, root
        key = lambda c: (c["node"], c["step"])
        assert sorted(of("cuts"), key=key) == sorted(own.cuts, key=key), root
        assert of("stops") == ([own.stop] if own.stop else []), root
        assert {n: p for (r, n), p in paths.items() if r == root} == graph.paths(own)
        assert sorted((n, w) for (r, n), w in left.items() if r == root) == sorted(graph.unexpanded(own, depth))


def test_no_roots(spark, ranked):
    found = tiles.tiles(ranked, spark.createDataFrame([(None,)], "root string"), ONE_WAY, 3)
    assert found.elements.count() == found.nodes.count() == found.cuts.count() == found.stops.count() == 0
