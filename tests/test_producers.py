"""Runs of producers: the gate, failures that stay alone, checks of what is stated, events, and the store."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from factloom.operators import producers
from factloom.operators.producers import Producer, Registry
from factloom.sources.store import FactStore
from factloom.streaming import journal


def frame(spark, rows):
    return spark.createDataFrame(rows, "kind string, subject string, relation string, object string, coverage_type string")


def inventory(spark, unread=False, languages=("java",)):
    rows = [("ASSERTION", f"file:{k}", "WRITTEN_IN", f"language:{k}", None) for k in languages] + [("COVERAGE", "repository:r", None, None, "NOT_INTERPRETED" if unread else "ANALYSED")]
    return Producer("inventory", lambda inputs, progress: frame(spark, rows), None, frozenset({"WRITTEN_IN", "ANALYSED", "NOT_INTERPRETED"}), "i/1")


def calls(spark, name="calls", languages=frozenset({"java"}), rows=None, codes=frozenset({"CALLS", "ANALYSED"})):
    rows = rows if rows is not None else [("ASSERTION", "symbol:a", "CALLS", "symbol:b", None), ("COVERAGE", "file:java", None, None, "ANALYSED")]

    def run(inputs, progress):
        progress("files", 1, 2)
        return frame(spark, rows)

    return Producer(name, run, languages, codes, f"{name}/1")


def outcome(own):
    return {r.producer_id: r.status for r in own.executions.collect()}


def test_registry(spark):
    own = Registry([calls(spark, "b"), calls(spark, "a")])
    assert [p.producer_id for p in own.all()] == ["a", "b"] and own.get("a").catalog == "a/1"
    with pytest.raises(ValueError):
        own.register(calls(spark, "a"))
    with pytest.raises(ValueError):
        own.register(calls(spark, " "))
    with pytest.raises(KeyError):
        own.get("z")


def test_gate_and_failures(spark):
    def raises(inputs, progress):
        raise OSError("disk\ngone")

    own = producers.run(
        Registry([
            inventory(spark), calls(spark), calls(spark, "cobol", frozenset({"cobol"})), calls(spark, "free", None), Producer("raises", raises, None, frozenset()),
            calls(spark, "silent", rows=[("ASSERTION", "symbol:a", "CALLS", "symbol:b", None)]), calls(spark, "nothing", rows=[]), calls(spark, "undeclared", codes=frozenset({"ANALYSED"})),
            Producer("late", lambda i, p: frame(spark, [("COVERAGE", "x:1", None, None, "ANALYSED")]).withColumn("subject", F.raise_error(F.lit("in a task"))), None, frozenset({"ANALYSED"})),
        ]), None, spark, "r", "A", "inventory",
    )
    assert outcome(own) == {"inventory": "SUCCESS", "calls": "SUCCESS", "free": "SUCCESS", "cobol": "UNSUPPORTED", **dict.fromkeys(("raises", "silent", "nothing", "undeclared", "late"), "FAILED")}
    assert own.reasons["raises"] == "OSError: disk" and "CALLS" in own.reasons["undeclared"]
    by = {}
    for r in own.facts.collect():
        by.setdefault(r.producer_id, []).append(r.relation or r.coverage_type)
        assert r.execution_id == f"A/{r.producer_id}" and (r.status, r.validity) == ("OBSERVED", "VALID")
    assert by["cobol"] == ["OUT_OF_SCOPE"] and sorted(by["calls"]) == ["ANALYSED", "CALLS"] and all(by[k] == ["NOT_INTERPRETED"] for k in ("raises", "silent", "nothing", "undeclared", "late"))
    events = own.events.orderBy("event_id").collect()
    assert [e.event_id for e in events] == list(range(1, len(events) + 1)) and events[0].type == "analysis.started" and events[-1].type == "done"
    kinds = {(e.type, json.loads(e.data).get("producer")) for e in events}
    assert {("producer.progress", "calls"), ("producer.completed", "calls"), ("producer.skipped", "cobol"), ("producer.failed", "late")} <= kinds and ("producer.progress", "cobol") not in kinds
    assert journal.job_states(own.events).first().finished


def test_an_inventory_that_read_not_everything_gates_nobody(spark):
    own = producers.run(Registry([inventory(spark, unread=True), calls(spark, "cobol", frozenset({"cobol"}))]), None, spark, "r", "A", "inventory")
    assert outcome(own) == {"inventory": "SUCCESS", "cobol": "SUCCESS"}


def test_a_failed_inventory_fails_the_run(spark):
    bad = calls(spark, "inventory", rows=[])
    with pytest.raises(producers.RunFailed) as e:
        producers.run(Registry([bad, calls(spark)]), None, spark, "r", "A", "inventory")
    assert outcome(e.value.run) == {"inventory": "FAILED"} and e.value.run.events.orderBy(F.desc("event_id")).first().type == "failed"
    assert [r.coverage_type for r in e.value.run.facts.collect()] == ["NOT_INTERPRETED"]


def test_a_run_is_stored(spark, tmp_path):
    store = FactStore(spark, str(tmp_path / "store"))
    own = producers.run(Registry([inventory(spark), calls(spark)]), None, spark, "r", "A", "inventory")
    assert producers.stored(own, store, "A", "c1", dt.datetime(2024, 1, 1)) == 4
    assert {(r.producer_id, r.catalog) for r in store.facts("A").select("producer_id", "catalog").collect()} == {("inventory", "i/1"), ("calls", "calls/1")}
    assert [r.far for r in store.edges("A").page("symbol:a", "CALLS").collect()] == ["symbol:b"]
    with pytest.raises(ValueError):
        producers.stored(own, store, "B", "c1", dt.datetime(2024, 1, 1))
