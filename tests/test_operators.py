from collections import deque

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factloom.operators import budget, calls, compare, facts, graph, knowledge, project, rules, summaries, validate
from factloom.sources import manifests, snapshot
from factloom.sources.store import FactStore
from factloom.streaming import journal

EDGES = st.lists(st.tuples(st.integers(0, 5), st.sampled_from(["R", "S"]), st.integers(0, 5)), max_size=14)


class Local:
    """Ranked edges as plain rows, so that many small graphs need no jobs."""

    def __init__(self, edges):
        self.rows = []
        for direction, a, b in (("OUT", 0, 2), ("IN", 2, 0)):
            groups = {}
            for occ, e in enumerate(edges):
                groups.setdefault((f"n:{e[a]}", e[1]), []).append((f"n:{e[b]}", occ))
            for (anchor, relation), rows in groups.items():
                self.rows += [(anchor, relation, direction, rank, far, occ) for rank, (far, occ) in enumerate(sorted(rows), 1)]

    def read(self, _, wanted, steps, most, start):
        out = {}
        for node, k in wanted:
            after = start.after if (node, k) == (start.node, start.step) else 0
            out[node, k] = [(r, f, o) for n, rel, d, r, f, o in self.rows if (n, rel, d) == (node, steps[k].relation, steps[k].direction) and after < r <= after + most]
        return out


def walk(edges, steps, depth):
    """What an unlimited walk shows, in order."""
    local, shown, seen, out, queue = Local(edges), set(), {"n:0"}, [], deque([("n:0", 0)])
    while queue:
        node, level = queue.popleft()
        for s in steps:
            for _, far, occ in sorted((r, f, o) for n, rel, d, r, f, o in local.rows if (n, rel, d) == (node, s.relation, s.direction)):
                if occ in shown:
                    continue
                shown.add(occ)
                out.append((occ, node, far))
                if far not in seen:
                    seen.add(far)
                    if level + 1 < depth:
                        queue.append((far, level + 1))
    return out


@settings(deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(EDGES, st.integers(1, 3), st.integers(1, 8), st.integers(1, 8), st.integers(1, 20), st.none() | st.integers(1, 3))
def test_tiles_are_prefixes_of_the_whole_walk(monkeypatch, edges, depth, nodes, most, work, fanout):
    monkeypatch.setattr(graph, "_adjacencies", Local(edges).read)
    steps = graph.both_ways(["R", "S"])
    whole = walk(edges, steps, depth)
    free = graph.tile(None, "n:0", steps, depth, graph.Limits(1000, 1000, 1000, 10**6))
    assert [(e["occ_id"], e["node"], e["far"]) for e in free.elements] == whole and free.stop is None
    own = graph.tile(None, "n:0", steps, depth, graph.Limits(nodes, most, work, 10**6))
    assert [(e["occ_id"], e["node"], e["far"]) for e in own.elements] == whole[: len(own.elements)]
    assert len(own.nodes) <= nodes and len(own.elements) <= most and own.work <= work
    assert own.stop is not None or len(own.elements) == len(whole)
    larger = graph.tile(None, "n:0", steps, depth, graph.Limits(nodes + 2, most + 2, work + 2, 10**6))
    assert own.elements == larger.elements[: len(own.elements)]
    fan = graph.tile(None, "n:0", steps, depth, graph.Limits(1000, 1000, 1000, 10**6), fanout=fanout)
    if fanout:
        assert all(sum(e["node"] == n for e in fan.elements) <= fanout for n in fan.nodes)
    assert set(graph.paths(free)) == set(free.nodes)


@settings(deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(EDGES, st.integers(1, 3))
def test_cursors_go_on_where_a_tile_stopped(monkeypatch, edges, most):
    monkeypatch.setattr(graph, "_adjacencies", Local(edges).read)
    steps, cursor, found = [graph.Step("R"), graph.Step("S")], graph.Cursor("n:0"), []
    for _ in range(40):
        own = graph.tile(None, "n:0", steps, 1, graph.Limits(1000, most, 1000, 10**6), start=cursor)
        found += [e["occ_id"] for e in own.elements]
        if own.stop is None:
            break
        cursor = graph.Cursor(own.stop["node"], own.stop["step"], own.stop["after"])
    assert found == [o for o, *_ in walk(edges, steps, 1)]


def test_cursor_tokens_are_bound():
    token = graph.cursor_token(graph.Cursor("n:1", 2, 3), "s", {"depth": 1}, 7)
    assert graph.read_cursor(token, "s", {"depth": 1}, 7) == graph.Cursor("n:1", 2, 3)
    old = graph.cursor_token(graph.Cursor("n:1"), "s", {"depth": 1, "fanout": 3}, 7, version=1)
    assert graph.read_cursor(old, "s", {"depth": 1, "fanout": 9}, 7) == graph.Cursor("n:1")  # version 1 doesn't know fan-out
    with pytest.raises(ValueError):
        graph.read_cursor(graph.cursor_token(graph.Cursor("n:1"), "s", {"depth": 1, "fanout": 3}, 7), "s", {"depth": 1, "fanout": 9}, 7)
    for other in (("s", {"depth": 1}, 8), ("t", {"depth": 1}, 7), ("s", {"depth": 2}, 7)):
        with pytest.raises(ValueError):
            graph.read_cursor(token, *other)
    with pytest.raises(ValueError):
        graph.read_cursor("!!", "s", {}, 1)


def test_tile_over_frames(spark):
    edges = [(0, "R", 1), (0, "R", 2), (1, "S", 2), (2, "R", 0)]
    frame = spark.createDataFrame([(i, f"n:{a}", r, f"n:{b}") for i, (a, r, b) in enumerate(edges)], "occ_id long, subject string, relation string, object string")
    for sides in (graph.ranked_both(frame), graph.both_directions(frame)):
        own = graph.tile(sides, "n:0", graph.both_ways(["R", "S"]), 2)
        assert [(e["occ_id"], e["node"], e["far"]) for e in own.elements] == walk(edges, graph.both_ways(["R", "S"]), 2)
    wide = spark.createDataFrame([(i, "n:0", "R", f"n:{i}") for i in range(1, 60)], "occ_id long, subject string, relation string, object string")
    page = graph.tile(graph.both_directions(wide), "n:0", [graph.Step("R")], 1, graph.Limits(edges=10), start=graph.Cursor("n:0", 0, 20))
    assert [e["rank"] for e in page.elements] == list(range(21, 31)) and page.stop["after"] == 30
    assert graph.unexpanded(own, 2) == []


def test_reach_and_climb(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    start = spark.createDataFrame([("a",)], "reference string")
    assert {(r.reference, r.level) for r in graph.reach(edges, start, 2).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert {r.reference: r.path for r in graph.closure_with_paths(edges, start).collect()}["d"] == ["a", "b", "c", "d"]
    chain = spark.createDataFrame([(str(k), str(k + 1)) for k in range(9)], "src string, dst string")
    origin = spark.createDataFrame([("0",)], "reference string")
    assert {int(r.reference): r.level for r in graph.reach(chain, origin).collect()} == {k: k for k in range(10)}
    assert max(len(r.path) for r in graph.closure_with_paths(chain, origin).collect()) == 10
    holders = spark.createDataFrame([("file:x", "symbol:T"), ("symbol:T", "symbol:m"), ("file:y", "symbol:U"), ("file:z", "symbol:U")], "subject string, object string")
    got = graph.climb(holders, spark.createDataFrame([("symbol:m",), ("symbol:U",)], "reference string")).collect()
    assert {r.reference: r.holder for r in got} == {"symbol:m": "file:x", "symbol:U": None}


def test_ranks(spark):
    rows = [("a", "R", x) for x in ("\ufb33", "\U0001f600", "z", "aa", "ab")]
    frame = spark.createDataFrame(rows, "s string, relation string, o string")
    one = {r.o: r["rank"] for r in facts.adjacency_rank(frame, "s", "o").collect()}
    assert one == {"aa": 1, "ab": 2, "z": 3, "\U0001f600": 4, "\ufb33": 5}
    assert one == {r.o: r["rank"] for r in facts.ranks_of_large(frame, "s", "o").collect()}
    many = spark.createDataFrame([("hot", "R", f"n:{k * 7919 % 500}") for k in range(500)] + [("cold", "R", "x"), ("cold", "S", "y")], "s string, relation string, o string")
    by_ranges, whole = (sorted(map(tuple, df.select("s", "relation", "o", "rank").collect())) for df in (facts.ranks_of_large(many.repartition(3), "s", "o", large=100), facts.adjacency_rank(many, "s", "o")))
    assert by_ranges == whole


def test_spelled(spark):
    frame = spark.createDataFrame([("file:\u00e9", None), ("file:\u00e9", '{"subject":"file:e\u0301"}')], "subject string, raw_identity string")
    assert frame.where(facts.spelled(frame, "subject", "file:\u00e9")).count() == 1
    assert frame.where(facts.spelled(frame, "subject", "file:e\u0301")).first().raw_identity
    assert facts.occurrence(frame.withColumn("occ_id", F.lit(5)), "5").count() == 2
    assert facts.occurrence(frame.withColumn("occ_id", F.lit(5)), "x5").count() == 0


@pytest.mark.parametrize(("scope", "ref", "inside"), [("repository:r", "file:a", True), ("repository:r", "repository:s", False), ("directory:a", "file:a/b", True), ("directory:a", "file:ab", False), ("directory:a/", "symbol:a/b", False), ("file:a", "file:a", True), ("module:m", "file:m/x", False)])
def test_scopes(spark, scope, ref, inside):
    frame = spark.createDataFrame([(scope, ref)], "s string, r string")
    assert frame.select(facts.contains(F.col("s"), F.col("r"))).first()[0] is inside


@pytest.mark.parametrize(
    ("pattern", "route", "out"),
    [("/**", "/a/b", 2), ("/a/**", "/a", 2), ("/a/**/c", "/a/b/c", 2), ("/a/*", "/a/b", 2), ("/a/*", "/a", 0), ("/a/{x}", "/a/{id}", 2), ("/a/b", "/a/{id}", 1), ("/a/b?", "/a/bc", 2), ("/a", "/b", 0), ("/a/**", "/{*rest}", 1), ("/", "/", 2), ("/**/x", "/{id}", 1)],
)
def test_patterns(pattern, route, out):
    assert rules.meets(pattern, route) == out


def test_rules(spark):
    ends = spark.createDataFrame([("e1", "c", "GET", "/a/b"), ("e2", "c", "ANY", "/a/b"), ("e3", "c", "GET", "/z")], "endpoint string, chain string, verb string, route string")
    told = spark.createDataFrame([("c", 1, None, "/q", True, False), ("c", 2, "GET", "/a/**", True, False), ("c", 3, None, "/a/**", True, False)], "chain string, place int, verb string, pattern string, readable boolean, never boolean")
    got = {r.endpoint: (r.place, r.reason) for r in rules.first_match(rules.outcomes(ends, told)).collect()}
    assert got == {"e1": (2, None), "e2": (None, "NOT_INTERPRETED"), "e3": (None, "NOT_MATCHED")}
    assert [r.endpoint for r in rules.excluded(ends, spark.createDataFrame([("/z",)], "pattern string")).collect()] == ["e3"]
    made = rules.endpoints(spark.createDataFrame([("h", ["/a", "/b"], ["/x"], ["GET", "PUT"]), ("i", [], [], [])], "handler string, prefixes array<string>, paths array<string>, verbs array<string>"))
    assert {r.endpoint for r in made.collect()} == {"endpoint:GET /a/x", "endpoint:PUT /a/x", "endpoint:GET /b/x", "endpoint:PUT /b/x", "endpoint:ANY /"}
    told = [("hasRole('A') and isAuthenticated()", True), ("hasRole('A') or permitAll", False), (None, False), ("hasAnyRole( 'A and B' , 'C' )  and denyAll", True), ("hasRole(role)", False), ("hasRole('A') andalso denyAll", False), ("permitAll", False), ("", False), ("hasRole('A'", False), (" denyAll ", True)]
    seen = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(told)], "i int, x string").select("i", rules.restrictive(F.col("x")).alias("r")).orderBy("i").collect()
    assert [r.r for r in seen] == [x for _, x in told]
    verbs = [(None, "GET", 2), (None, "ANY", 2), ("GET", "GET", 2), ("GET", "PUT", 0), ("GET", "ANY", 1)]
    assert [r[0] for r in spark.createDataFrame([(a, b) for a, b, _ in verbs], "a string, b string").select(rules.verb_match(F.col("a"), F.col("b"))).collect()] == [v for *_, v in verbs]


def test_met_patterns_are_all_pairs(spark):
    patterns = ["/**", "/a/*", "/a/b", "/{x}/b", "/*b/**", "/", "/c?/d", None]
    routes = ["/a/b", "/a", "/", "/{id}/b", "/ab/x", "/c1/d", "/{*rest}", None, "/a/b"]
    found = rules.met_patterns(spark.createDataFrame([(r,) for r in routes], "route string"), spark.createDataFrame([(p,) for p in patterns], "pattern string"))
    assert sorted(map(tuple, found.collect())) == sorted((r, p, rules.meets(p, r)) for r in set(routes) - {None} for p in patterns if p and rules.meets(p, r))
    with pytest.raises(ValueError, match="patterns"):
        rules.met_patterns(spark.createDataFrame([("/a",)], "route string"), spark.range(rules.MOST_PATTERNS + 1).select(F.concat(F.lit("/"), "id").alias("pattern")))


def test_compare_with_itself(spark):
    rows = spark.createDataFrame([("h1", "p", "OBSERVED", "VALID", "e", ""), ("h1", "p", "INFERRED", "VALID", "e", ""), ("h2", "p", "OBSERVED", "VALID", None, "")], "identity_hash string, producer_id string, status string, validity string, evidence string, content string")
    assert {r.category for r in compare.added_removed(rows, rows).collect()} == {"COMMON"}
    assert all(r.signals == [] for r in compare.signals(rows, rows).collect())
    other = rows.withColumn("status", F.when(F.col("identity_hash") == "h2", "INFERRED").otherwise(F.col("status"))).withColumn("evidence", F.when(F.col("identity_hash") == "h2", "f").otherwise(F.col("evidence")))
    assert {r.identity_hash: r.signals for r in compare.signals(rows, other).collect()}["h2"] == ["EVIDENCE_CHANGED", "STATUS_CHANGED"]
    forth, back = (compare.added_removed(a, b).where("category <> 'COMMON'") for a, b in ((rows, rows.limit(0)), (rows.limit(0), rows)))
    assert {r.category for r in forth.collect()} == {"REMOVED"} and {r.category for r in back.collect()} == {"ADDED"}


def test_verdicts(spark):
    claims = spark.createDataFrame([("1", "f:a", "WRITTEN_IN", "l:x", None), ("2", "f:a", "WRITTEN_IN", "l:y", None), ("3", "f:b", "CALLS", "s:z", None), ("4", "f:b", "NOBODY", None, None), ("5", "f:c", "CALLS", None, ["q"]), ("6", "f:d", "CALLS", None, None)], "claim_id string, subject string, relation string, object string, needed array<string>")
    known = spark.createDataFrame([("f:a", "WRITTEN_IN", "l:x")], "subject string, relation string, object string")
    schema = "analyzer_id string, relations array<string>, failed boolean, unsupported boolean, reads string, languages array<string>, coverage array<struct<coverage_type:string,subject:string,include:array<string>,exclude:array<string>>>"
    cover = [("ANALYSED", "repository:r", ["repository:r"], []), ("READ_ERROR", "f:d", [], [])]
    who = spark.createDataFrame([("a", ["CALLS", "WRITTEN_IN"], False, False, "LANGUAGES", ["p"], cover)], schema)
    got = {r.claim_id: (r.verdict, r.reason) for r in knowledge.verdicts(claims, known, who, ["p"], True).collect()}
    assert got == {"1": ("CONFIRMED", None), "2": ("REFUTED", None), "3": ("NOT_PROVEN", "NOT_FOUND_IN_ANALYSED_SCOPE"), "4": ("NOT_PROVEN", "NOT_ANALYSED"), "5": ("NOT_PROVEN", "NOT_ANALYSED"), "6": ("NOT_PROVEN", "NOT_INTERPRETED")}
    partial = {r.claim_id: r.reason for r in knowledge.verdicts(claims, known, who, ["p"], False).collect()}
    assert partial["3"] == "NOT_ANALYSED"


def test_log_order():
    assert project.ordered({"a": 1.0, "b": 2.0, "c": 3.0, "d": 3.0}, {"d": ["b", "gone"], "c": ["b", "a"], "b": ["a"]}) == ["c", "d", "b", "a"]
    assert project.ordered({"x": 0.0, "y": 0.0}, {}) == ["x", "y"]
    assert project.ordered({"c:10": 0.0, "c:1": 0.0, "c:2": 1.0}, {"c:2": ["c:1"]}) == ["c:2", "c:1", "c:10"]
    assert project.ordered({"a": 1.0, "b": 2.0, "c": 0.0}, {"a": ["b"], "b": ["a"]}) == ["c"]  # a cycle has no order


def test_routes(spark):
    handled = spark.createDataFrame([("endpoint:GET /b", "symbol:C#m"), ("endpoint:GET /a", "symbol:C#n")], "endpoint string, handler string")
    served = spark.createDataFrame([("endpoint:GET /b", "application:x")], "endpoint string, application string")
    matched = spark.createDataFrame([("endpoint:GET /b", "route-pattern:/**", "f")], "endpoint string, pattern string, filter_chain string")
    told = spark.createDataFrame([("route-pattern:/**", "f", "role:A")], "pattern string, filter_chain string, authority string")
    guards = spark.createDataFrame([("symbol:C", "role:T"), ("symbol:C#m", "role:M")], "symbol string, authority string")
    got = project.routes(handled, served, matched, told, guards).collect()
    assert [(r.path, r.guards, r.applications) for r in got] == [("/a", ["role:T"], None), ("/b", ["role:M"], ["application:x"])]
    assert got[1].rules[0].authority == "role:A"


def test_calls(spark):
    extends = spark.createDataFrame([("A", "B"), ("B", "C"), ("X", "Y")], "type string, super string")
    types = spark.createDataFrame([("A",), ("B",), ("C",), ("X",)], "type string")
    supers = calls.hierarchy(extends, types)
    assert {(r.type, r.reference, r.level) for r in supers.collect()} >= {("A", "A", 0), ("A", "B", 1), ("A", "C", 2)}
    sites = spark.createDataFrame([(1, "A", "m", 0), (2, "A", "n", 0), (3, None, "m", 0), (4, "X", "m", 0), (5, "A", "two", 0)], "site_id int, receiver_type string, method string, arity int")
    declared = spark.createDataFrame([("B", "m", 0, "B#m"), ("C", "m", 0, "C#m"), ("C", "two", 0, "C#two1"), ("C", "two", 0, "C#two2")], "type string, method string, arity int, symbol string")
    external = spark.createDataFrame([("Y",)], "type string")
    out = calls.categories(calls.resolve(sites, supers, declared, external))
    assert {r.site_id: (r.target, r.reason, r.category) for r in out.collect()} == {1: ("B#m", None, None), 2: (None, "NO_MATCHING_DECLARATION", "UNKNOWN"), 3: (None, "RECEIVER_TYPE_UNKNOWN", "UNKNOWN"), 4: (None, "TARGET_TYPE_OUTSIDE_SNAPSHOT", "UNKNOWN"), 5: (None, "OVERLOAD_AMBIGUOUS", "AMBIGUOUS")}
    values = calls.constants(spark.createDataFrame([("a", "1")], "name string, value string"), spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "x")], "name string, other string"))
    assert {r.name: r.value for r in values.collect()} == {"a": "1", "b": "1", "c": "1"}
    state = calls.loading(spark.createDataFrame([("r", "a"), ("a", "b"), ("r", "c")], "src string, dst string"), spark.createDataFrame([("b",)], "type string"), spark.createDataFrame([("r",)], "reference string"))
    assert {r.type: r.state for r in state.collect()} == {"r": "LOADED", "a": "LOADED", "c": "LOADED", "b": "MAYBE"}
    impl = calls.implementations(spark.createDataFrame([("A", "m()", "A#m")], "type string, signature string, symbol string"), spark.createDataFrame([("I", "m()", "I#m")], "type string, signature string, symbol string"), spark.createDataFrame([("A", "I")], "type string, interface string"))
    assert [tuple(r) for r in impl.collect()] == [("A#m", "I#m")]


def test_calls_are_resolved_once(spark):
    declared = spark.range(3_000).select(F.lit("A").alias("type"), F.lit("m").alias("method"), F.lit(0).alias("arity"), F.concat(F.lit("A#"), "id").alias("symbol"))
    declared = declared.unionByName(spark.createDataFrame([("A", "one", 0, "A#one"), ("A", "one", 0, "A#one")], declared.schema))
    supers = spark.createDataFrame([("A", "A", 0)], "type string, reference string, level int")
    sites = spark.range(40_000).select(F.when(F.col("id") > 0, F.col("id")).alias("site_id"), F.lit("A").alias("receiver_type"), F.when(F.col("id") % 2 == 0, "m").otherwise("one").alias("method"), F.lit(0).alias("arity"))
    repeated = sites.unionByName(spark.createDataFrame([(1, "A", "m", 0)], sites.schema))
    out = calls.resolve(repeated, supers, declared, spark.createDataFrame([], "type string"))
    rows = out.groupBy("target", "reason").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("site_id").isNull()).alias("unnamed"))
    # a row for each site, without an id and with a repeated one too
    assert {tuple(r) for r in rows.collect()} == {(None, "OVERLOAD_AMBIGUOUS", 20_001, 1), ("A#one", None, 20_000, 0)}


def test_summaries(spark):
    sites = spark.createDataFrame([("UNKNOWN",), ("UNKNOWN",), ("AMBIGUOUS",), (None,)], "category string")
    assert {(r.category, r.precision, r.n) for r in summaries.diagnostic_counts(sites, False).collect()} == {("UNKNOWN", "EXACT", 2), ("AMBIGUOUS", "EXACT", 1)}
    assert {r.category: r.n for r in summaries.diagnostic_counts(sites, True).collect()} == {"UNKNOWN": 2, "AMBIGUOUS": 1, "UNSUPPORTED": 0, "OUT_OF_SCOPE": 0}
    cover = spark.createDataFrame([("a", "ANALYSED", 5, 3, 2, ["x"]), ("b", "READ_ERROR", 1, 1, 0, ["y", "x", "y"])], "subject string, coverage_type string, sites_seen int, sites_listed int, sites_proven int, reasons array<string>")
    assert tuple(summaries.restitution(cover).first()) == (2, 2, 2, 1)
    assert summaries.unread_reasons(cover).first().reasons == ["x", "y"]


def test_budgets(spark):
    rows = spark.range(100).select(F.col("id"), (F.col("id") % 7).alias("size"))
    total, kept = 0, 0
    for i in range(100):
        total += i % 7
        if total <= 120:
            kept += 1
    assert tuple(budget.counted_prefix(rows, ["id"], F.col("size"), 120).first()) == (kept, 100 - kept)
    named = rows.withColumn("name", F.lpad(F.col("id").cast("string"), 3, "0"))  # an order column of text
    assert tuple(budget.counted_prefix(named, ["name"], F.col("size"), 120).first()) == (kept, 100 - kept)
    short = budget.short_references(spark.createDataFrame([("b", 5), ("a", 2), ("b", 1), ("c", 2)], "k string, seq int"), "k")
    assert {r.k: r.short for r in short.collect()} == {"b": "F1", "a": "F2", "c": "F3"}
    lines = spark.createDataFrame([(["a", "b", "", "c"],)], "l array<string>")
    assert lines.select(budget.source_piece(F.col("l"), 1, 3)).first()[0] == "a\nb"
    assert lines.select(budget.source_piece(F.col("l"), 2, 200)).first()[0] == "b\n\nc"


def good_fact(**more):
    commit = "a" * 40
    return {"kind": "ASSERTION", "status": "OBSERVED", "validity": "VALID", "subject": "file:a", "relation": "CONTAINS", "object": "symbol:b", "snapshot": {"repository": "r", "commit": commit, "mode": "COMMIT"}, "produced_by": {"producer_type": "EVALUATOR", "producer_id": "p"}, "evidence": [{"repository": "r", "commit": commit, "method": "m", "path": "a", "content_hash": "sha256:" + "0" * 64, "line_start": 1, "line_end": 2}], **more}


@pytest.mark.parametrize(
    ("more", "codes"),
    [
        ({}, []),
        ({"relation": "KNOWS"}, ["RELATION"]),
        ({"subject": "thing:a"}, ["SUBJECT", "SUBJECT_KIND", "CONTAINS_PAIR"]),
        ({"object": "repository:x"}, ["OBJECT_KIND", "CONTAINS_PAIR"]),
        ({"relation": "CALLS", "subject": "symbol:a"}, ["RELATION_STATUS"]),
        ({"relation": "WRITES_CALL", "subject": "symbol:a", "object": None}, []),
        ({"evidence": []}, ["EVIDENCE"]),
        ({"status": "INFERRED"}, ["DERIVATION"]),
        ({"status": "HUMAN_VALIDATED"}, ["RELATION_STATUS", "PRODUCER", "VALIDATION"]),
        ({"qualifiers": '{"confidence": 1}'}, ["CONFIDENCE"]),
        ({"kind": "COVERAGE", "relation": None, "coverage_type": "NOT_INTERPRETED", "scope": {"include": ["file:a"], "exclude": []}}, ["REASON"]),
        ({"kind": "COVERAGE", "relation": None, "coverage_type": "ANALYSED", "scope": {"include": [], "exclude": []}}, ["SCOPE"]),
        ({"snapshot": {"repository": "r", "commit": "b" * 40, "mode": "COMMIT"}}, ["EVIDENCE_SNAPSHOT"]),
    ],
)
def test_issues(spark, more, codes):
    frame = spark.createDataFrame([good_fact(**more)], validate.FACT)
    assert validate.issues(frame).first().issues == codes


def test_store(spark, tmp_path):
    import datetime as dt

    store = FactStore(spark, str(tmp_path / "store"))
    assert store.analyses().count() == 0 and store.facts().count() == 0
    rows = spark.createDataFrame([("ASSERTION", "file:a", "CONTAINS", "symbol:b", "p", "x1")] * 2 + [("ASSERTION", "file:a", "CONTAINS", "symbol:c", "p", "x1")], "kind string, subject string, relation string, object string, producer_id string, execution_id string")
    runs = spark.createDataFrame([("A", "x1", "p", "SUCCESS", "c/1")], "analysis_id string, execution_id string, producer_id string, status string, catalog string")
    store.record_execution(runs)
    store.record_execution(runs)
    with pytest.raises(ValueError):
        store.record_execution(runs.withColumn("status", F.lit("FAILED")))
    assert store.add("A", "c1", dt.datetime(2024, 1, 1), rows) == 3
    with pytest.raises(ValueError):
        store.add("A", "c1", dt.datetime(2024, 1, 1), rows)
    store.add("B", "c2", dt.datetime(2024, 1, 2), rows.limit(1))
    assert [r.analysis_id for r in store.analyses().collect()] == ["B", "A"]
    assert store.identities().count() == 2 and store.facts("A").count() == 3
    assert sorted(r.occ_id for r in store.facts("A").collect()) == [1, 2, 3]
    assert facts.revision(store.facts("A")).first().revision == 3
    plan = store.facts("A")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(analysis_id" in plan
    new = FactStore(spark, str(tmp_path / "new"))
    assert not store.migrate(str(tmp_path / "new"), 3, most=2) and new.analyses().count() == new.facts().count() == 0
    assert not store.migrate(str(tmp_path / "new"), 3, most=1) and store.migrate(str(tmp_path / "new"), 3) and store.migrate(str(tmp_path / "new"), 3)
    assert new.facts("A").count() == 3 and {r.layout for r in new.analyses().collect()} == {3}
    shown = lambda df: sorted(map(str, df.collect()))
    assert shown(new.facts()) == shown(store.facts()) and shown(new.identities()) == shown(store.identities())
    assert shown(new.edges("A").edges()) == shown(store.edges("A").edges())
    assert [r.reference for r in new.references.by_prefix("", limit=9).collect()] == [r.reference for r in store.references.by_prefix("", limit=9).collect()] == ["file:a", "symbol:b", "symbol:c"]
    assert [(r.rank, r.far) for r in store.edges("A").page("file:a", "CONTAINS").collect()] == [(1, "symbol:b"), (2, "symbol:b"), (3, "symbol:c")]


FACT = "kind string, subject string, relation string, object string, producer_id string, execution_id string, qualifiers string, coverage_type string, scope string"


def test_store_identities(spark, tmp_path):
    import datetime as dt
    import json
    import threading

    from factloom.functions import canonical

    store = FactStore(spark, str(tmp_path / "store"))
    pair = lambda s, r, o, q=None: ("ASSERTION", s, r, o, "p", "x", q, None, None)
    cover = lambda s, t, scope, p="p": ("COVERAGE", s, None, None, p, "x", None, t, scope)
    rows = [
        pair("commit:a", "CHILD_OF", "commit:b", '{"position": 0}'), pair("commit:a", "CHILD_OF", "commit:b", '{"position": 1}'), pair("commit:a", "CHILD_OF", "commit:b"),
        pair("a|R|b", "R", "c"), pair("a", "R", "b|R|c"), pair("file:caf\u00e9", "R", "x:1"), pair("file:cafe\u0301", "R", "x:1"), pair('q:"', "R", "b:\\"), pair("x:1", "R", None),
        cover("file:a", "ANALYSED", '{"include": ["b", "a"]}'), cover("file:a", "ANALYSED", '{"include": ["a", "b", "a"]}'), cover("file:a", "READ_ERROR", '{"include": ["a", "b"]}'), cover("file:a", "ANALYSED", '{"include": ["a", "b"]}', "q"),
    ]
    frame = spark.createDataFrame(rows, FACT)
    names = [c.split()[0] for c in FACT.split(", ")]
    facts_ = [{k: json.loads(v) if k in ("qualifiers", "scope") else v for k, v in zip(names, r, strict=True) if v is not None} for r in rows]
    expected = {canonical.identity_hash(f) for f in facts_}
    assert store.add("A", "c", dt.datetime(2024, 1, 1), frame) == len(rows)
    assert len(expected) == 11 == store.identities().count() and {r.identity_hash for r in store.identities().collect()} == expected
    assert {r.identity_hash for r in store.facts("A").collect()} == expected
    assert {r.qualifiers for r in store.facts("A").where("relation = 'CHILD_OF'").collect()} == {None, '{"position": 0}', '{"position": 1}'}
    with pytest.raises(ValueError, match="canonical"):
        store.add("B", "c", None, spark.createDataFrame([pair("a:1", "R", "b:1", '{"n": 1, "n": 2}')], FACT))
    more = spark.createDataFrame([pair("new:1", "R", "new:2"), *rows[:2]], FACT)
    threads = [threading.Thread(target=lambda k=k: store.add(f"T{k}", "c", None, more)) for k in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert store.identities().count() == 12 and sorted(r.analysis_id for r in store.analyses().collect()) == ["A", "T0", "T1"]


def test_pushdown(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_orderkey", "l_suppkey").where("l_suppkey = 7")
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(l_suppkey,7)" in plan and "ReadSchema: struct<l_orderkey:bigint,l_suppkey:bigint>" in plan


def test_manifests(spark):
    files = spark.createDataFrame([
        ("requirements.txt", "Flask==1\n# no\nrequests>=2 ; x\n"),
        ("web/package.json", '{"name":"w","dependencies":{"a":"1"},"devDependencies":{"b":"file:../b"}}'),
        ("core/pom.xml", "<project><groupId>g</groupId><artifactId>core</artifactId><modules><module>x</module></modules><dependencies><dependency><groupId>g</groupId><artifactId>y</artifactId><scope>test</scope></dependency></dependencies></project>"),
        ("build.gradle", "dependencies { implementation project(':core:api') // project(':no')\n testImplementation(project(\":t\")) }"),
        ("settings.gradle", "include ':core:api', ':t'\n"),
        ("compose.yaml", "services:\n  web:\n    build: ./web\n  db:\n    image: x\n  api:\n    build:\n      context: api\nvolumes:\n  v:\n"),
        ("py/pyproject.toml", 'x = { path = "../y" }'),
    ], "path string, text string")
    assert {r.name for r in manifests.requirements(files).collect()} == {"flask", "requests"}
    assert {(r.module, r.name, r.version) for r in manifests.packages(files).collect()} == {("web", "a", "1"), ("web", "b", "file:../b")}
    assert [tuple(r) for r in manifests.maven(files).collect()] == [("core", "g", "y", "test")]
    assert [tuple(r) for r in manifests.maven_modules(files).collect()] == [("core", "g", "core", "x")]
    assert {tuple(r) for r in manifests.gradle(files).collect()} == {(".", "implementation", "core/api"), (".", "testImplementation", "t")}
    assert {r.child for r in manifests.gradle_includes(files).collect()} == {"core/api", "t"}
    assert {(r.service, r.context) for r in manifests.compose(files).collect()} == {("web", "web"), ("api", "api")}
    assert [tuple(r) for r in manifests.python_modules(files).collect()] == [("py", True)]
    told, gaps = manifests.structure(spark.createDataFrame([("a",), ("b",)], "module string"), spark.createDataFrame([("a", "b"), ("a", "z")], "module string, target string"), "r")
    assert told.count() == 3 and [r.target for r in gaps.collect()] == ["z"]


def test_git_sources(spark, tmp_path):
    import subprocess

    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=Ada", "-c", "user.email=Ada@Example.org", *a], check=True, capture_output=True)
    git("init", "-q")
    (tmp_path / "src").mkdir()
    (tmp_path / "src/A.java").write_text("class A {}\n")
    (tmp_path / ".env").write_text("SECRET=1\n")
    git("add", "-A")
    git("commit", "-qm", "one")
    git("mv", "src/A.java", "src/B.java")
    git("commit", "-qm", "two")
    snapshot.register(spark)
    log = spark.read.format("git-log").option("path", str(tmp_path)).load()
    rows = {r.subject: r for r in log.collect()}
    assert rows["two"].parents == [rows["one"].sha] and rows["two"].changes[0].old_path == "src/A.java"
    tree = spark.read.format("git-tree").option("path", str(tmp_path)).load().collect()
    assert [(r.path, bytes(r.content)) for r in tree] == [("src/B.java", b"class A {}\n")]
    told = {(r.relation, r.object) for r in project.history_facts(log, "r").collect()}
    assert ("AUTHORED_BY", "person:ada@example.org") in told and ("CHANGES", "file:src/B.java") in told
    files = snapshot.working_tree(spark, str(tmp_path))
    assert [r.path for r in files.collect()] == ["src/B.java"]
    assert len(snapshot.fingerprint(files).first()[0]) == 64
    assert ("WRITTEN_IN", "language:Java") in {(r.relation, r.object) for r in snapshot.inventory(files, "r").collect()}
    assert [r.author_name for r in snapshot.authors(log).collect()] == ["Ada"]
    with pytest.raises(ValueError):
        snapshot.recent(log, 0)


def test_git_filters_and_stream(spark, tmp_path):
    import subprocess

    root = tmp_path / "repo"
    root.mkdir()
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=Ada", "-c", "user.email=a@b.org", *a], check=True, capture_output=True, text=True).stdout
    git("init", "-q")
    log = lambda reader: reader.format("git-log").option("path", str(root)).load()
    snapshot.register(spark)
    out, place = str(tmp_path / "out"), str(tmp_path / "place")

    def batch():
        query = log(spark.readStream).select("sha", "subject").writeStream.format("parquet").option("checkpointLocation", place).trigger(availableNow=True).start(out)
        query.awaitTermination(120)
        return [r.subject for r in spark.read.schema("sha string, subject string").parquet(out).collect()]

    for k in range(7):
        (root / f"f{k}.txt").write_text("x" * k)
        (root / "big.bin").write_text("b" * (100 + k))
        git("add", "-A")
        git("commit", "-qm", f"c{k}")
        if k == 3:
            assert sorted(batch()) == ["c0", "c1", "c2", "c3"]
    assert sorted(batch()) == [f"c{k}" for k in range(7)] == sorted(batch())

    tree = spark.read.format("git-tree").option("path", str(root)).load()
    assert [(r.path, bytes(r.content)) for r in tree.where("path = 'f3.txt'").collect()] == [("f3.txt", b"xxx")]
    some = tree.where("path like 'f%' and size > 4")
    assert sorted(r.path for r in some.collect()) == ["f5.txt", "f6.txt"]
    assert sorted(r.path for r in tree.where("path in ('f1.txt', 'big.bin') and size <= 100").collect()) == ["f1.txt"]
    oid = git("rev-parse", "HEAD:f2.txt").strip()
    assert [r.path for r in tree.where(F.col("oid") == oid).collect()] == ["f2.txt"] and tree.where("path = ''").collect() == []
    from pyspark.sql.datasource import EqualTo, StringContains

    reader = snapshot.GitTreeReader({"path": str(root)})
    left = list(reader.pushFilters([EqualTo(("path",), "f3.txt"), StringContains(("path",), "3")]))
    assert len(left) == 1 and [p.rows for p in reader.partitions()] == [[("f3.txt", git("rev-parse", "HEAD:f3.txt").strip(), 3)]]  # one blob is read
    shas = git("rev-list", "HEAD").split()
    assert [r.subject for r in log(spark.read).where(F.col("sha") == shas[2]).collect()] == ["c4"]
    assert sorted(r.subject for r in log(spark.read).where(F.col("sha").isin(shas[0], shas[6], "0" * 40)).collect()) == ["c0", "c6"]
    assert len(snapshot.GitLogReader({"path": str(root)}).partitions()) == 4 and log(spark.read).count() == 7


def test_journal_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "progress", "a", None), (1, 2, "done", "b", None), (2, 3, "progress", "c", None)], "job_id long, event_id long, type string, data string, ts timestamp")
    rows.write.parquet(str(tmp_path / "events"))
    out = journal.job_states(journal.journal_stream(spark, str(tmp_path / "events"))).writeStream.format("memory").queryName("states").outputMode("complete").trigger(availableNow=True).start()
    out.awaitTermination()
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(spark.table("states")) == key(journal.job_states(rows))
    assert [r.event_id for r in journal.follow(rows, 1).collect()] == [2, 3]
    shown = journal.frames(rows.orderBy("event_id")).collect()
    assert journal.parse_frames(": beat\n\n" + shown[0].frame) == [{"id": "1", "event": "progress", "data": "a"}]


def test_answers_in_pieces(spark, tmp_path):
    whole = '{"x": 1, "answer": "a\\n\\u00e9\\ud83d\\ude00 \\"b\\" end", "y": "z"}'
    last = ""
    for k in range(len(whole) + 1):
        now = journal.answer_so_far(whole[:k])
        assert now.startswith(last)
        last = now
    assert last == 'a\n\u00e9\U0001f600 "b" end'
    for k, piece in enumerate((whole[:20], whole[20:40], whole[40:])):
        spark.createDataFrame([(1, k, piece)], "job_id long, event_id long, data string").coalesce(1).write.mode("append").parquet(str(tmp_path / "pieces"))
    stream = spark.readStream.schema("job_id long, event_id long, data string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "pieces"))
    run = journal.answers(stream).writeStream.format("memory").queryName("answers").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    assert "".join(r.added for r in spark.table("answers").collect()) == last


def test_fold_over_a_stream(spark, tmp_path):
    rows = [(1, 1, 0), (1, 2, 0), (1, 3, 1), (2, 4, 5)]
    for k, part in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(part, "job_id long, event_id long, expected long").coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema("job_id long, event_id long, expected long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    run = journal.fold(stream).writeStream.format("memory").queryName("folded").outputMode("update").trigger(availableNow=True).start()
    run.awaitTermination()
    last = {r.job_id: (r.revision, r.conflicts) for r in spark.table("folded").orderBy("revision", "conflicts").collect()}
    batch = journal.revisions(spark.createDataFrame(rows, "job_id long, event_id long, expected long"))
    assert last == {r.job_id: (r.revision, r.conflicts) for r in batch.collect()} == {1: (2, 1), 2: (0, 1)}


def test_revisions(spark):
    rows = spark.createDataFrame([(1, 1, 0), (1, 2, 0), (1, 3, 1)], "job_id long, event_id long, expected long")
    assert tuple(journal.revisions(rows).first()) == (1, 2, 1)


def test_frontiers(spark):
    steps = [graph.Step("CALLS"), graph.Step("EXTENDS")]
    catalogs = spark.createDataFrame([("p", "CALLS"), ("q", "EXTENDS")], "producer_id string, relation string")
    runs = spark.createDataFrame([("p", "SUCCESS"), ("q", "FAILED")], "producer_id string, status string")
    unread = spark.createDataFrame([("p", "kotlin")], "producer_id string, language string")
    assert {tuple(r) for r in graph.analysis_frontier(steps, catalogs, runs, unread).collect()} == {("EXTENDS", "CONTEXT", None), ("CALLS", "KNOWLEDGE", "kotlin")}
    gaps = spark.createDataFrame([("file:a", "r"), ("n", "s"), ("m", "t")], "subject string, reason string")
    found = graph.local_frontier(spark.createDataFrame([("n",)], "reference string"), spark.createDataFrame([("a",)], "path string"), gaps)
    assert [r.subject for r in found.collect()] == ["file:a", "n"]


def test_call_paths(spark):
    edges = [("endpoint:GET /a", "HANDLED_BY", "symbol:C#m"), ("symbol:C#m", "CALLS", "symbol:S#n"), ("symbol:S#n", "CALLS", "symbol:R#o")]
    frame = spark.createDataFrame([(i, *e) for i, e in enumerate(edges)], "occ_id long, subject string, relation string, object string")
    own = graph.call_paths(graph.ranked_both(frame), "endpoint:GET /a")
    assert [e["far"] for e in graph.tile_view(own)] == ["symbol:C#m", "symbol:S#n", "symbol:R#o"]
    assert graph.paths(own)["symbol:R#o"] == [0, 1, 2]
    assert [e["far"] for e in graph.profiled(graph.ranked_both(frame), "endpoint:GET /a", "calls/1").elements] == ["symbol:C#m", "symbol:S#n"]
    with pytest.raises(ValueError):
        graph.profiled(None, "file:x", "calls/1")


def test_guards_and_gaps(spark):
    methods = spark.createDataFrame([("C#m", "C"), ("C#n", "C"), ("D#x", "D")], "symbol string, type string")
    notes = spark.createDataFrame([("C", "T"), ("C#m", "M")], "target string, expression string")
    assert {tuple(r) for r in rules.guards(methods, notes).collect()} == {("C#m", "M"), ("C#n", "T")}
    assert [r.subject for r in rules.home_made(spark.createDataFrame([("F", ["Filter"]), ("G", [])], "type string, supers array<string>"), ["Filter"]).collect()] == ["symbol:F"]
    runs = spark.createDataFrame([("p", "FAILED"), ("q", "UNSUPPORTED"), ("r", "SUCCESS")], "producer_id string, status string")
    assert {(r.producer_id, r.coverage_type) for r in validate.engine_coverage(runs, "r").collect()} == {("p", "NOT_INTERPRETED"), ("q", "OUT_OF_SCOPE")}


def test_evidence_and_entry_points(spark):
    rows = [(1, "endpoint:GET /a", "HANDLED_BY", "symbol:C#m()", '{"evidence":[{"path":"a","line_start":1},{"path":"b"}]}'), (2, "symbol:J#run()", "ANNOTATED_WITH", "annotation:Scheduled", "{}"), (3, "symbol:M", "CONTAINS", "symbol:M#main(String[])", None), (4, "symbol:M", "CONTAINS", "symbol:M#x()", '{"evidence":[]}')]
    frame = spark.createDataFrame(rows, "occ_id long, subject string, relation string, object string, details string")
    asked = spark.createDataFrame([(1,), (1,), (2,), (3,), (9,)], "occ_id long")
    assert sorted((r.occ_id, r.position, r.path, r.line_start) for r in facts.evidence_of(frame, asked).collect()) == [(1, 0, "a", 1), (1, 1, "b", None)]
    assert {tuple(r) for r in facts.entry_points(frame, ["Scheduled"]).collect()} == {("symbol:C#m()", "ROUTE"), ("symbol:J#run()", "ANNOTATION"), ("symbol:M#main(String[])", "MAIN")}


def test_commit_impact(spark):
    rows = lambda *xs: spark.createDataFrame(list(xs), "subject string, relation string, object string")
    got = compare.commit_impact(rows(("a", "R", "1"), ("b", "R", "1"), ("c", "R", "1"), ("c", "R", "2")), rows(("a", "R", "2"), ("b", "R", "1"), ("c", "R", "3"), ("d", "S", "x"))).collect()
    assert [tuple(r) for r in got] == [("MODIFIED", "a", "R", "2", "1"), ("INTRODUCED", "c", "R", "3", None), ("INTRODUCED", "d", "S", "x", None), ("REMOVED", "c", "R", "1", None), ("REMOVED", "c", "R", "2", None)]
    runs = spark.createDataFrame([("x", "A1", 1, "COMPLETE"), ("x", "A2", 2, "COMPLETE"), ("y", "B1", 1, "COMPLETE"), ("z", "C1", 1, "FAILED")], "commit string, analysis_id string, created_at int, state string")
    assert compare.recorded_pair(runs, "x", "y") == ("A2", "B1")
    for pair in (("x", "x"), ("x", "z")):
        with pytest.raises(ValueError):
            compare.recorded_pair(runs, *pair)


def test_sizes_include_themselves(spark):
    import json

    texts = ["{}", *('{"a":"' + "é" * n + 'x"}' for n in range(0, 60)), *('{"a":"' + "y" * n + '"}' for n in range(970, 990))]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select(budget.with_size(F.col("t")).alias("s")).collect():
        assert json.loads(r.s)["bytes"] == len(r.s.encode())


def test_java_sources(spark):
    from factloom.functions import sources

    rows = spark.createDataFrame([("A.java", bytearray(b"class A {}")), ("B.java", bytearray(b"\xff\xfe")), ("C.java", bytearray(b"x" * 50)), ("d.txt", bytearray(b"x"))], "path string, content binary")
    read, left = sources.java_sources(rows, 40)
    assert [tuple(r) for r in read.collect()] == [("A.java", "class A {}")]
    assert {tuple(r) for r in left.collect()} == {("B.java", "NOT_UTF8"), ("C.java", "TOO_LARGE")}


def test_walks_are_guarded(spark):
    frame = spark.createDataFrame([(1,)], "occ_id long")
    assert graph.guarded(frame, graph.Tile).elements == []
    state = [frame]

    class Moving:
        def agg(self, *a):
            return state[0].agg(*a)

    def walk():
        state[0] = frame.unionByName(spark.createDataFrame([(2,)], "occ_id long"))
        return graph.Tile()

    with pytest.raises(ValueError, match="during the walk"):
        graph.guarded(Moving(), walk)


def test_compact_form_is_exact(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "b", "x")], "id int, p string, q string")
    short, common = budget.compact(rows, ["p", "q"])
    assert common.count() == 2 and sorted(map(tuple, budget.expand(short, common).select("id", "p", "q").collect())) == sorted(map(tuple, rows.collect()))
    assert budget.briefing(rows, ["id"], F.lit(10), 20).count() == 2


def test_output_issues(spark):
    told = spark.createDataFrame([("p", "ASSERTION", "CALLS", None), ("q", "COVERAGE", None, "ANALYSED")], "producer_id string, kind string, relation string, coverage_type string")
    catalog = spark.createDataFrame([("q", "ANALYSED")], "producer_id string, code string")
    assert {tuple(r) for r in validate.output_issues(told, catalog).collect()} == {("p", "UNDECLARED", "CALLS"), ("p", "NO_COVERAGE", None)}


@pytest.mark.parametrize("parts", [None, 9])
def test_known_objects_of_large_tables(spark, parts):
    """Rows are dealt to as many partitions as were asked for, objects of one subject to several."""
    facts_ = spark.range(4_000).select(F.concat(F.lit("s:"), F.col("id") % 2 * (F.col("id") % 3)).alias("subject"), F.lit("R").alias("relation"), F.when(F.col("id") > 5, F.concat(F.lit("o:"), F.col("id") % 500)).alias("object"))
    claims = spark.createDataFrame([("a", "s:0", "R", "o:77"), ("b", "s:0", "R", "none"), ("c", "s:1", "R", "o:1"), ("d", "s:0", "R", None), ("e", "s:9", "R", "o:1")], "claim_id string, subject string, relation string, object string")
    held = {}
    for r in facts_.distinct().collect():
        held.setdefault(r.subject, []).append(r.object)
    out = knowledge.known_objects(claims, facts_, 3, parts)
    expected = {}
    for c in claims.collect():
        if c.subject in held:
            ordered = sorted(held[c.subject], key=lambda o: (o != c.object, o is not None, o or ""))
            expected[c.claim_id] = (ordered[:3], max(0, len(ordered) - 3))
    assert {r.claim_id: (r.objects, r.more) for r in out.collect()} == expected and len(expected) == 4


def test_nearest_of_a_large_table_is_shuffled_once(spark):
    rows = spark.createDataFrame([(7, 3, 5), (7, 1, 6), (7, 1, 6), (8, 2, 1), (8, 2, 2)], "k int, level int, candidate int")
    best = graph.nearest_single(rows, ["k"], 9)
    assert best._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    assert {tuple(r) for r in best.collect()} == {(7, 6, None), (8, None, "AMBIGUOUS")}
