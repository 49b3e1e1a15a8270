"""Producers of facts: a registry, and one run of all of them over an analysis.

A producer is a function from inputs to a DataFrame of facts and coverage. What it reads
and may state is declared, so a run can leave out those that have nothing to read and
refuse what they don't declare. One that fails leaves a single coverage row, not half of
its facts, and the others go on.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import knowledge, validate
from factloom.session import cut
from factloom.streaming.journal import JOURNAL

FACTS = "kind string, subject string, relation string, object string, qualifiers string, coverage_type string, scope string, status string, validity string, details string, producer_id string, execution_id string"
EXECUTIONS = "analysis_id string, execution_id string, producer_id string, status string, catalog string"
#: Outcomes of a producer (fixed values).
SUCCESS, FAILED, UNSUPPORTED = "SUCCESS", "FAILED", "UNSUPPORTED"


@dataclass(frozen=True)
class Producer:
    """run(inputs, progress) gives kind, subject, relation, object and what else FACTS has. languages: those that it reads (None: it doesn't depend on any). codes: relations and coverage types that it may state. progress(stage, completed, total) tells how far it is."""

    producer_id: str
    run: Callable[..., DataFrame]
    languages: frozenset[str] | None = None
    codes: frozenset[str] = frozenset()
    catalog: str = ""


class Registry:
    """Producers by id, each id once."""

    def __init__(self, producers: Iterable[Producer] = ()):
        self._own: dict[str, Producer] = {}
        for p in producers:
            self.register(p)

    def register(self, producer: Producer) -> None:
        if not producer.producer_id.strip():
            raise ValueError("a producer needs an id")
        if producer.producer_id in self._own:
            raise ValueError(f"{producer.producer_id} is registered already")
        self._own[producer.producer_id] = producer

    def get(self, producer_id: str) -> Producer:
        if producer_id not in self._own:
            raise KeyError(f"no producer {producer_id}")
        return self._own[producer_id]

    def all(self) -> list[Producer]:
        return [self._own[k] for k in sorted(self._own)]


@dataclass
class Run:
    """facts (coverage among them), executions (a row a producer) and events (a journal) of one analysis."""

    facts: DataFrame
    executions: DataFrame
    events: DataFrame
    reasons: dict[str, str] = field(default_factory=dict)


def _whole(spark: SparkSession, rows: DataFrame, producer_id: str, execution_id: str) -> DataFrame:
    """The rows with every column of FACTS, what is left out being null (OBSERVED and VALID)."""
    given = {"producer_id": F.lit(producer_id), "execution_id": F.lit(execution_id)}
    stand_in = {"status": F.lit("OBSERVED"), "validity": F.lit("VALID")}
    out = []
    for column in (c.split(" ")[0] for c in FACTS.split(", ")):
        value = given.get(column) if column in given else F.col(column) if column in rows.columns else stand_in.get(column, F.lit(None))
        out.append(value.cast("string").alias(column))
    return rows.select(*out)


def _checked(rows: DataFrame, producer: Producer) -> DataFrame:
    """The facts, written; refused without coverage, or with codes that the catalog hasn't."""
    spark = rows.sparkSession
    facts = cut(rows, "produced")
    catalog = spark.createDataFrame([(producer.producer_id, c) for c in sorted(producer.codes)], "producer_id string, code string")
    issues = validate.output_issues(facts, catalog).orderBy("issue", "code").limit(20).collect()
    if facts.isEmpty() or any(r.issue == "NO_COVERAGE" for r in issues):
        raise ValueError("no coverage is stated")
    if issues:
        raise ValueError(f"codes that the catalog doesn't declare: {', '.join(r.code for r in issues)}")
    return facts


def run(registry: Registry, inputs: object, spark: SparkSession, repository: str, analysis_id: str, inventory: str, job: int = 1) -> Run:
    """Runs the inventory, then all other producers.

    The languages that the inventory found gate the others, if it read everything (a
    success without unread coverage): a producer that reads none of them isn't called, and
    its one coverage row is OUT_OF_SCOPE. A producer that fails, by an exception here or in
    a task, or by what it states, has one row NOT_INTERPRETED. If the inventory fails the run
    fails, with an error. Each step is an event; the last one is done or failed.
    """
    events: list[tuple] = []

    def tell(kind: str, **data: object) -> None:
        events.append((job, len(events) + 1, kind, json.dumps(data, sort_keys=True, ensure_ascii=False), dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)))

    kept: list[DataFrame] = []
    executions: list[tuple] = []
    reasons: dict[str, str] = {}

    def one(producer: Producer, present: set[str] | None) -> DataFrame | None:
        execution, status = f"{analysis_id}/{producer.producer_id}", SUCCESS
        tell("producer.started", producer=producer.producer_id)
        found = None
        if present is not None and producer.languages is not None and not producer.languages & present:
            status = UNSUPPORTED
        else:
            progress = lambda stage, completed=None, total=None: tell("producer.progress", producer=producer.producer_id, stage=stage, completed=completed, total=total)
            try:
                found = _checked(_whole(spark, producer.run(inputs, progress), producer.producer_id, execution), producer)
            except Exception as e:  # noqa: BLE001  whatever a producer does, the others go on
                status = FAILED
                reasons[producer.producer_id] = f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"
        executions.append((analysis_id, execution, producer.producer_id, status, producer.catalog))
        if found is None:
            states = spark.createDataFrame([(producer.producer_id, status)], "producer_id string, status string")
            own = validate.engine_coverage(states, repository)
            details = F.to_json(F.struct("reason"))
            scope = F.lit(json.dumps({"include": [f"repository:{repository}"]}))
            found = _whole(spark, own.withColumns({"details": details, "scope": scope}).drop("reason"), producer.producer_id, execution)
            kept.append(found)
            tell("producer.failed" if status == FAILED else "producer.skipped", producer=producer.producer_id, message=reasons.get(producer.producer_id, ""))
            return None
        kept.append(found)
        said = found.groupBy(F.coalesce("relation", "coverage_type").alias("code")).count().orderBy("code")
        tell("producer.completed", producer=producer.producer_id, stated={r.code: r["count"] for r in said.collect()})  # a row a code
        return found

    first = registry.get(inventory)
    tell("analysis.started", analysis=analysis_id)
    base = one(first, None)
    if base is None:
        tell("failed", message=reasons[inventory])
    else:
        present = {r.object.partition(":")[2] for r in knowledge.present_languages(base).collect()}  # a row a language
        complete = knowledge.languages_complete(base.where("kind = 'COVERAGE'").select(F.lit(SUCCESS).alias("status"), "coverage_type")).first().complete
        for producer in registry.all():
            if producer.producer_id != inventory:
                one(producer, present if complete else None)
        tell("done", analysis=analysis_id, languages=sorted(present))
    facts = kept[0]
    for more in kept[1:]:
        facts = facts.unionByName(more)
    out = Run(facts, spark.createDataFrame(executions, EXECUTIONS), spark.createDataFrame(events, JOURNAL), reasons)
    if base is None:
        raise RunFailed(reasons[inventory], out)
    return out


class RunFailed(RuntimeError):
    """The inventory failed; `run` has its coverage row and the events."""

    def __init__(self, message: str, own: Run):
        super().__init__(message)
        self.run = own


def stored(own: Run, store, analysis_id: str, commit: str, created_at: dt.datetime) -> int:
    """Writes a run to a fact store, executions first; an occurrence without its execution is refused."""
    store.record_execution(own.executions)
    facts = own.facts.withColumn("analysis_id", F.lit(analysis_id))
    if not validate.orphans(facts, store.executions()).isEmpty():
        raise ValueError("facts without their execution")
    return store.add(analysis_id, commit, created_at, own.facts)
