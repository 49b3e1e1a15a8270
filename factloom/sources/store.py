"""A store of facts in Parquet: identities shared by all analyses, occurrences by analysis.

What readers see is the latest entry of one log: its analyses and the folders of
identities and executions. A write goes to folders of its own first and is seen whole once
its entry is accepted; of two writers at once the slower one takes up what the other left.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions.canonical import STORED_FIELDS, with_identity
from factloom.operators import references
from factloom.operators.facts import ranks_of_large
from factloom.session import cut
from factloom.sources.adjacency import RankedEdges
from factloom.sources.commits import CommitLog, Conflict
from factloom.sources.reference_index import ReferenceIndex

VERSION = 2
_FIELDS = ", ".join(f"{c} string" for c in STORED_FIELDS)
_ANALYSES = "analysis_id string, commit string, created_at timestamp, state string, batch string, layout int"
_IDENTITIES = f"identity_hash string, {_FIELDS}"
_OCCURRENCES = f"analysis_id string, batch string, occ_id long, identity_hash string, {_FIELDS}, execution_id string, status string, validity string, raw_identity string, details string, out_rank int"
_EXECUTIONS = "analysis_id string, execution_id string, producer_id string, status string, catalog string"
#: Columns of a fact that may be left out, and what stands in for them.
_OPTIONAL = {**dict.fromkeys(("qualifiers", "coverage_type", "scope", "pattern", "method", "raw_identity", "details")), "status": "OBSERVED", "validity": "VALID"}


def _names(schema: str) -> list[str]:
    return [c.split(" ")[0] for c in schema.split(", ")]


class FactStore:
    def __init__(self, spark: SparkSession, path: str, rows_per_file: int = 500_000):
        self.spark, self.path, self.rows_per_file = spark, path.rstrip("/"), rows_per_file
        self.log = CommitLog(spark, f"{self.path}/log")
        #: References of all analyses.
        self.references = ReferenceIndex(spark, f"{self.path}/index", rows_per_file)

    def _state(self) -> tuple[int, dict]:
        number, state = self.log.last()
        return number, state or {"analyses": [], "identities": [], "executions": []}

    def _read(self, folders: list[str], schema: str) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{f}" for f in folders))

    def _analyses(self) -> DataFrame:
        rows = [(a["analysis_id"], a["commit"], a["created_at"] and dt.datetime.fromisoformat(a["created_at"]), "COMPLETE", a["batch"], a["layout"]) for a in self._state()[1]["analyses"]]
        return self.spark.createDataFrame(rows, _ANALYSES)

    def analyses(self) -> DataFrame:
        """Complete analyses only, newest first."""
        return self._analyses().orderBy(F.desc("created_at"), F.desc("analysis_id"))

    def identities(self) -> DataFrame:
        """Each identity once, whichever analyses have it."""
        return self._read(self._state()[1]["identities"], _IDENTITIES)

    def executions(self) -> DataFrame:
        return self._read(self._state()[1]["executions"], _EXECUTIONS)

    def facts(self, analysis_id: str | None = None) -> DataFrame:
        """Occurrences of complete analyses with their executions; the analysis prunes partitions."""
        shown = self._analyses().select("analysis_id", "batch")
        if not self._state()[1]["analyses"]:
            rows = self.spark.createDataFrame([], _OCCURRENCES)
        else:
            rows = self.spark.read.schema(_OCCURRENCES).parquet(f"{self.path}/occurrences")
        if analysis_id is not None:
            rows, shown = rows.where(F.col("analysis_id") == analysis_id), shown.where(F.col("analysis_id") == analysis_id)
        own = self.executions().select("analysis_id", "execution_id", "catalog").dropDuplicates(["analysis_id", "execution_id"])
        return rows.join(shown, ["analysis_id", "batch"], "left_semi").join(own, ["analysis_id", "execution_id"], "left")

    def edges(self, analysis_id: str) -> RankedEdges:
        """Stored edges of an analysis in both directions, with their ranks."""
        batch = next((a["batch"] for a in self._state()[1]["analyses"] if a["analysis_id"] == analysis_id), None)
        if batch is None:
            raise ValueError("no such analysis")
        return RankedEdges(self.spark, f"{self.path}/edges/{batch}", self.rows_per_file)

    def _place(self, analysis_id: str, batch: str) -> str:
        """The partition of an analysis' occurrences: a folder of its own, so that writers don't share one."""
        return f"{self.path}/occurrences/analysis_id={quote(analysis_id, safe='')}/batch={batch}"

    def _occurrences(self, analysis_id: str, batch: str) -> DataFrame:
        rows = self.spark.read.schema(_OCCURRENCES).option("basePath", f"{self.path}/occurrences").parquet(self._place(analysis_id, batch))
        return rows.select(*_names(_OCCURRENCES))

    def _write(self, rows: DataFrame, name: str) -> str:
        folder = f"{name}/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        return folder

    def _commit(self, change: Callable[[dict], dict], tries: int = 20) -> dict:
        """Appends change(state), made anew on the state that another writer left; the state that was accepted."""
        for _ in range(tries):
            number, state = self._state()
            after = change(state)
            if self.log.append(number, after):
                return after
        raise Conflict(f"{self.path}: others were faster {tries} times")

    def record_execution(self, rows: DataFrame) -> None:
        """Adds executions that aren't there; one that is, but differs, is an error."""
        keys = ["analysis_id", "execution_id"]

        def change(state: dict) -> dict:
            have = self._read(state["executions"], _EXECUTIONS)
            clash = rows.alias("n").join(have.alias("h"), keys).where(" or ".join(f"not n.{c} <=> h.{c}" for c in ("producer_id", "status", "catalog")))
            if not clash.isEmpty():
                raise ValueError("an execution is recorded with other values")
            return {**state, "executions": [*state["executions"], self._write(rows.select(*_names(_EXECUTIONS)).join(have, keys, "left_anti"), "executions")]}

        self._commit(change)

    def add(self, analysis_id: str, commit: str, created_at: dt.datetime | None, facts: DataFrame) -> int:
        """Writes the facts of an analysis and returns its revision (the number of its occurrences).

        facts: kind, subject, relation, object, producer_id, execution_id, and optionally
        qualifiers and scope (JSON), coverage_type, pattern, method, status, validity,
        raw_identity, details. Identities are hashes of the canonical form, so qualifiers,
        coverage types and scopes tell facts apart, and spellings with one normal form
        don't; a fact without a canonical form is refused. Occurrence ids are places in the
        order of identity, producer and details, so a repeated write of equal facts gives
        equal ids; they are dealt by ranges of the identity's hash, so no task orders all
        facts. References go to the index, edges with ranks of both directions to edges().
        """
        taken = lambda state: any(a["analysis_id"] == analysis_id for a in state["analyses"])
        if taken(self._state()[1]):
            raise ValueError("the analysis is complete")
        batch = uuid.uuid4().hex
        for name, value in _OPTIONAL.items():
            if name not in facts.columns:
                facts = facts.withColumn(name, F.lit(value).cast("string"))
        rows = cut(with_identity(facts.select(*STORED_FIELDS, "execution_id", "status", "validity", "raw_identity", "details")), "facts")
        if not rows.where("identity_hash is null").isEmpty():
            raise ValueError("a fact has no canonical form")
        rows = rows.withColumn("_range", F.conv(F.substring("identity_hash", 1, 3), 16, 10).cast("int"))
        sizes = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # 4096 rows at most
        before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
        order = Window.partitionBy("_range").orderBy("identity_hash", "producer_id", "execution_id", F.coalesce("details", F.lit("")))
        rows = rows.withColumn("_inner", F.row_number().over(order)).join(F.broadcast(before), "_range").withColumn("occ_id", (F.col("_before") + F.col("_inner")).cast("long"))
        ranked = ranks_of_large(rows, "subject", "object", "identity_hash", "occ_id").withColumnRenamed("rank", "out_rank")
        out = ranked.withColumns({"analysis_id": F.lit(analysis_id), "batch": F.lit(batch)})
        out.select(*_names(_OCCURRENCES)).drop("analysis_id", "batch").write.parquet(self._place(analysis_id, batch))
        written = self._occurrences(analysis_id, batch)

        self.references.update(references.references(written))
        stated = written.where("kind = 'ASSERTION' and subject is not null")
        RankedEdges(self.spark, f"{self.path}/edges/{batch}", self.rows_per_file).add(stated.select("occ_id", "subject", "relation", "object"))

        own = F.when(F.col("kind") == "COVERAGE", F.col("producer_id"))  # of other kinds the producer isn't part of the identity
        claimed = written.withColumn("producer_id", own).select(*_names(_IDENTITIES)).dropDuplicates(["identity_hash"])

        def change(state: dict) -> dict:
            if taken(state):
                raise ValueError("the analysis is complete")
            new = claimed.join(self._read(state["identities"], _IDENTITIES).select("identity_hash"), "identity_hash", "left_anti")
            row = {"analysis_id": analysis_id, "commit": commit, "created_at": created_at and created_at.isoformat(), "batch": batch, "layout": VERSION}
            return {**state, "analyses": [*state["analyses"], row], "identities": [*state["identities"], self._write(new, "identities")]}

        self._commit(change)
        return written.count()

    def migrate(self, to: str, version: int, most: int | None = None) -> bool:
        """Copies the store into a new one, part by part: whether it is complete.

        Parts are the identities, the executions, and each analysis' occurrences and edges.
        A part is copied, its rows and a sum of their hashes are compared with the old ones, and
        its name goes to a log; a run after a stop goes on with parts that aren't in it
        (most: how many of them). The new store shows nothing before all parts are there.
        """
        new, done = FactStore(self.spark, to, self.rows_per_file), CommitLog(self.spark, f"{to.rstrip('/')}/migration")
        _, state = self._state()
        have = {e["part"] for _, e in done.entries()}
        copied = 0
        parts = [("identities", None), ("executions", None), *((a["analysis_id"], a) for a in state["analyses"])]
        for name, analysis in parts:
            part = name if analysis is None else f"analysis {name}"
            if part in have:
                continue
            if most is not None and copied >= most:
                return False
            if analysis is None:
                schema = _IDENTITIES if name == "identities" else _EXECUTIONS
                old, place = self._read(state[name], schema), f"{new.path}/{name}/all"
                old.write.mode("overwrite").parquet(place)
                back = self.spark.read.schema(schema).parquet(place)
            else:
                old = self._occurrences(name, analysis["batch"])
                old.drop("analysis_id", "batch").write.mode("overwrite").parquet(new._place(name, analysis["batch"]))
                back = new._occurrences(name, analysis["batch"])
                new.references.update(references.references(back))
                edges = RankedEdges(self.spark, f"{new.path}/edges/{analysis['batch']}", self.rows_per_file)
                edges.add(back.where("kind = 'ASSERTION' and subject is not null").select("occ_id", "subject", "relation", "object"))
            sums = [_hash_sum(x) for x in (old, back)]
            if sums[0] != sums[1]:
                raise ValueError(f"{part}: the copy differs")
            done.commit(lambda n, last, part=part, rows=sums[0][0], total=str(sums[0][1]): {"part": part, "rows": rows, "sum": total})
            copied += 1
        place = lambda name: [f"{name}/all"] if state[name] else []
        if not new.log.numbers():
            new.log.append(0, {"analyses": [{**a, "layout": version} for a in state["analyses"]], "identities": place("identities"), "executions": place("executions")})
        return True


def _hash_sum(rows: DataFrame) -> tuple:
    """Number of rows and the sum of their hashes: the same whatever the order or the files."""
    return tuple(rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first())
