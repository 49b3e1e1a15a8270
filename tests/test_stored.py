"""Logs, tables in key order, the reference index and stored adjacencies."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from factloom.functions import names
from factloom.operators import facts, graph, references
from factloom.sources.adjacency import RankedEdges
from factloom.sources.commits import CommitLog, Conflict
from factloom.sources.reference_index import ReferenceIndex
from factloom.sources.sorted_files import SortedFiles


def test_log(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "log"))
    assert log.last() == (0, None) and log.entries() == []
    assert log.append(0, {"a": "é"}) and not log.append(0, {"a": 2}) and log.append(1, {"a": 3})
    assert log.last() == (2, {"a": 3}) and log.entries(1) == [(2, {"a": 3})] and log.read(1) == {"a": "é"}
    assert not [p for p in (tmp_path / "log").iterdir() if p.name.startswith("draft")]


def test_of_two_writers_at_once_one_is_accepted(spark, tmp_path):
    log, accepted, together = CommitLog(spark, str(tmp_path / "log")), [], threading.Barrier(4)

    def write(k):
        together.wait()
        accepted.append(log.append(0, {"by": k}))

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(accepted) == [False, False, False, True]
    threads = [threading.Thread(target=lambda k=k: log.commit(lambda n, last: {"by": k, "after": n})) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert [e["after"] for _, e in log.entries(1)] == [1, 2, 3, 4]
    with pytest.raises(Conflict):
        log.commit(lambda n, last: log.append(n, {}) and {}, tries=3)


@pytest.fixture
def numbers(spark, tmp_path):
    table = SortedFiles(spark, str(tmp_path / "numbers"), "k string, n int, v string", ["k", "n"], rows_per_file=50)
    rows = [(f"k{i // 7:03d}", i % 7, "old") for i in range(0, 1400)]
    made = table.merge(spark.createDataFrame(rows, "k string, n int, v string"))
    assert made["kept"] == made["rewritten"] == 0 and made["written"] > 20
    return table, rows


def test_sorted_files_hold_ranges_that_dont_overlap(spark, numbers):
    table, rows = numbers
    listed = table.files().orderBy("low").collect()
    assert all(tuple(a.high) < tuple(b.low) for a, b in zip(listed, listed[1:])) and sum(r["rows"] for r in listed) == len(rows)
    assert sorted(tuple(r) for r in table.all().collect()) == rows


def test_a_page_opens_few_files(spark, numbers):
    table, rows = numbers
    for low, high, after, n in ((("k050",), ("k060",), None, 20), (None, None, ("k199", 3), 50), (("k010",), None, ("k077", 6), 1), (("zzz",), None, None, 5), (("k010", 2), ("k010", 5), None, 9), (None, None, None, 120)):
        expected = [r for r in rows if (low is None or r[: len(low)] >= low) and (high is None or r[: len(high)] < high) and (after is None or r[:2] > after)][:n]
        got = table.first(n, low, high, after)
        assert [tuple(r) for r in got.collect()] == expected and len(table.opened) <= 2 + n // 20
        odd = table.first(n, low, high, after, where=F.col("n") == 3)
        assert [tuple(r) for r in odd.collect()] == [r for r in rows if r[1] == 3 and (low is None or r[: len(low)] >= low) and (high is None or r[: len(high)] < high) and (after is None or r[:2] > after)][:n]


def test_a_batch_rewrites_its_files_alone(spark, numbers):
    table, rows = numbers
    before = {r.file for r in table.files().collect()}
    batch = [("k050", 3, "new"), ("k050", 9, "new"), ("k000", -1, "new"), ("k999", 0, "new"), ("k999", 0, "new")]
    made = table.merge(spark.createDataFrame(batch, "k string, n int, v string"))
    after = {r.file for r in table.files().collect()}
    assert made["rewritten"] == 3 == len(before - after) and made["kept"] == len(before & after) == len(before) - 3
    assert sorted(tuple(r) for r in table.all().collect()) == sorted([*rows, *(b for b in set(batch) if b[1] != 3)])
    listed = table.files().orderBy("low").collect()
    assert all(tuple(a.high) < tuple(b.low) for a, b in zip(listed, listed[1:]))
    assert table.merge(spark.createDataFrame([], "k string, n int, v string"))["rewritten"] == 0
    assert sorted(r.k for r in table.missing(spark.createDataFrame([("k050", 3, "x"), ("q", 1, "x"), ("q", 1, "y")], "k string, n int, v string")).collect()) == ["q"]


def test_two_merges_at_once_lose_nothing(spark, numbers):
    table, rows = numbers
    threads = [threading.Thread(target=lambda k=k: table.merge(spark.createDataFrame([("k050", 100 + k, "t")], "k string, n int, v string"))) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert table.all().where("v = 't'").count() == 3 and table.all().count() == len(rows) + 3


def test_no_files(spark, tmp_path):
    table = SortedFiles(spark, str(tmp_path / "none"), "k string", ["k"])
    assert table.all().count() == table.first(5).count() == 0
    assert table.merge(spark.createDataFrame([("a",), ("b",)], "k string").where("k > 'z'")) == {"kept": 0, "rewritten": 0, "written": 0}


def test_successor():
    assert names.successor("ab") == "ac" and names.successor("") is None and names.successor(chr(0x10FFFF)) is None
    assert names.successor("a" + chr(0x10FFFF)) == "b" and names.successor(chr(0xD7FF)) == chr(0xE000)


def test_reference_index(spark, tmp_path):
    rng = random.Random(4)
    spelled = [f"symbol:com.Acme{i % 40}.Größe{rng.randint(0, 99)}#run(int)" for i in range(300)] + [f"file:src/Main{i}.java" for i in range(300)] + ["nation:1", "symbol:straße", "symbol:STRASSE"]
    frame = spark.createDataFrame([(s, "x:1") for s in spelled], "subject string, object string")
    index = references.references(frame)
    stored = ReferenceIndex(spark, str(tmp_path / "index"), rows_per_file=60)
    first = stored.update(index.where("reference < 'symbol:com.Acme2'"))
    assert first["written"] > 2
    stored.update(index)
    again = stored.update(index)
    assert again["rewritten"] == again["written"] == 0 and stored.keyed.all().count() == index.count()
    named = references.name_index(index)
    shown = lambda df: [r.reference for r in df.collect()]
    for text in ("com.acme1", "SRC/main2", "straß", "", "zz"):
        for kind, after in ((None, None), ("file", None), (None, ("com.acme1", ""))):
            assert shown(stored.by_prefix(text, kind, after, 7)) == shown(references.by_prefix(index, text, kind, after, 7)), (text, kind)
    stored.by_prefix("src/main", limit=7)
    assert len(stored.keyed.opened) <= 2
    for text in ("run(int)", "strasse", "Main7.java", "nothing"):
        assert shown(stored.by_name(text, limit=9)) == shown(references.by_name(named, text, limit=9))
    for after in (None, ("com.acme2", "")):
        rows, bound = stored.containing("größe1", after, 5, 100)
        rows2, bound2 = references.containing(index, "größe1", after, 5, 100)
        assert shown(rows) == shown(rows2) and bound.collect() == bound2.collect()


def edges_of(spark, rows):
    return spark.createDataFrame(rows, "occ_id long, subject string, relation string, object string")


def test_stored_ranks(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, f"n:{rng.randint(0, 60):02d}", rng.choice("RS"), rng.choice([f"n:{rng.randint(0, 60):02d}", f"é:{i}", None])) for i in range(900)]
    stored = RankedEdges(spark, str(tmp_path / "edges"), rows_per_file=100)
    stored.add(edges_of(spark, rows[:700]))
    batch = [r for r in rows[700:]]
    stored.add(edges_of(spark, batch))
    stored.add(edges_of(spark, batch[:50]))
    ranked = graph.ranked_both(edges_of(spark, rows))
    columns = ["direction", "anchor", "relation", "rank", "far", "occ_id"]
    assert sorted(map(str, stored.edges().select(*columns).collect())) == sorted(map(str, ranked.select(*columns).collect()))
    few = stored.add(edges_of(spark, [(5000, "n:07", "R", "n:08")]))
    assert few["kept"] > 8 and few["rewritten"] <= 4
    ranked = graph.ranked_both(edges_of(spark, [*rows, (5000, "n:07", "R", "n:08")]))
    for direction in ("OUT", "IN"):
        page = stored.page("n:07", "R", direction, 2, 4)
        assert [r.occ_id for r in page.collect()] == [r.occ_id for r in facts.neighbours(ranked.where(f"direction = '{direction}' and relation = 'R'"), "anchor", "n:07", 2, 4).collect()]
        assert len(stored.table.opened) <= 2
    steps = graph.both_ways(["R", "S"])
    for root in ("n:07", "n:33", "none:1"):
        plain, own = (graph.tile(e, root, steps, 2, graph.Limits(nodes=40, edges=60), fanout=5) for e in (ranked, stored))
        assert own.elements == plain.elements and own.cuts == plain.cuts and own.stop == plain.stop and own.nodes == plain.nodes


@pytest.mark.parametrize("large", [1_000_000, 8])
def test_a_task_of_a_merge_writes_several_files(spark, tmp_path, monkeypatch, large):
    monkeypatch.setattr("factloom.sources.adjacency.LARGE", large)
    stored, rng, known = RankedEdges(spark, str(tmp_path / "edges"), rows_per_file=10), random.Random(7), {}
    monkeypatch.setattr("factloom.sources.sorted_files.TASK_ROWS", 100)
    schema = "occ_id long, subject string, relation string, object string"
    for subjects in (range(12), (1, 2, 3, 9), (5,)):
        rows = [(i, f"s:{rng.choice(subjects)}", rng.choice("RS"), f"o:{rng.choice('ab😀￮')}{rng.randrange(40)}") for i in rng.sample(range(10_000), 200 if len(subjects) == 12 else 25)]
        rows = [r for r in rows if r[0] not in known] + rng.sample(sorted(known.values()), min(len(known), 5))
        known |= {r[0]: r for r in rows}
        stored.add(spark.createDataFrame(rows + rows[:9], schema))
        if len(known) <= 200:
            files = [r.file.rsplit("/", 1)[1] for r in stored.table.files().collect()]
            assert len(files) >= 40 and len({f.split("-")[1] for f in files}) <= 5
        expected, listed = set(), {}
        for occ, s, r, o in known.values():
            for key, far in ((("OUT", s, r), o), (("IN", o, r), s)):
                listed.setdefault(key, []).append((far.encode("utf-16-be"), occ, far))
        for key, fars in listed.items():
            expected |= {(*key, n, far, occ) for n, (_, occ, far) in enumerate(sorted(fars), 1)}
        got = [tuple(x) for x in stored.edges().collect()]
        assert len(got) == len(expected) and set(got) == expected
        bounds = stored.table.files().orderBy("low").collect()
        assert all(tuple(a.high) < tuple(b.low) for a, b in zip(bounds, bounds[1:])) and max(b["rows"] for b in bounds) <= 10
