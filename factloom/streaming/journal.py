"""Event journals as streams: following after an event, jobs' states, retention, answers that come in pieces, folds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

JOURNAL = "job_id long, event_id long, type string, data string, ts timestamp"
#: Event types that end a job (fixed values).
TERMINAL = ("done", "failed")


def follow(events: DataFrame, after: int = 0, job: int | None = None) -> DataFrame:
    """Events behind an id, of one job or all; the same for a table and for a stream, where Spark's checkpoint keeps the place."""
    out = events.where(F.col("event_id") > after)
    return out if job is None else out.where(F.col("job_id") == job)


def journal_stream(spark: SparkSession, path: str, schema: str = JOURNAL, per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def closed(events: DataFrame) -> DataFrame:
    """Events up to the terminal event of their job, which comes last; later ones are none."""
    end = F.min(F.when(F.col("type").isin(*TERMINAL), F.col("event_id"))).over(Window.partitionBy("job_id"))
    return events.withColumn("_end", end).where(F.col("_end").isNull() | (F.col("event_id") <= F.col("_end"))).drop("_end")


def job_states(events: DataFrame, watermark: str | None = None) -> DataFrame:
    """job_id, last_event, finished, events: one aggregation, batch or stream; a watermark lets a stream's state go."""
    rows = events.withWatermark("ts", watermark) if watermark else events
    return rows.groupBy("job_id").agg(F.max("event_id").alias("last_event"), F.max(F.col("type").isin(*TERMINAL)).alias("finished"), F.count(F.lit(1)).alias("events"))


def retained(states: DataFrame, most: int = 50) -> DataFrame:
    """Jobs that stay: all running ones, and of the finished the latest, `most` in all; the oldest finished go first."""
    running = states.where("not finished")
    room = running.agg(F.greatest(F.lit(most) - F.count(F.lit(1)), F.lit(0)).alias("room"))
    latest = states.where("finished").orderBy(F.desc("last_event")).limit(most)
    kept = latest.withColumn("_n", F.row_number().over(Window.orderBy(F.desc("last_event")))).join(F.broadcast(room), F.col("_n") <= F.col("room")).drop("_n", "room")
    return running.unionByName(kept)


def latest_per(events: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """Of each key the latest n events."""
    return events.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where(F.col("_n") <= n).drop("_n")


def frames(events: DataFrame) -> DataFrame:
    """Events as server-sent frames."""
    return events.select("event_id", F.concat(F.lit("id: "), F.col("event_id").cast("string"), F.lit("\nevent: "), "type", F.lit("\ndata: "), F.replace("data", F.lit("\n"), F.lit("\ndata: ")), F.lit("\n\n")).alias("frame"))


def parse_frames(text: str) -> list[dict]:
    """Frames -> events; comments are heartbeats and none of them."""
    out = []
    for frame in text.split("\n\n"):
        event: dict = {}
        for line in frame.split("\n"):
            name, _, value = line.partition(": ")
            if name == "data" and "data" in event:
                event["data"] += "\n" + value
            elif name in ("id", "event", "data"):
                event[name] = value
        if event:
            out.append(event)
    return out


def answer_so_far(text: str, name: str = "answer") -> str:
    """The value of a string field of a JSON object that hasn't ended yet, as far as it is certain: a cut escape waits."""
    at = text.find(f'"{name}"')
    at = text.find('"', text.find(":", at + len(name) + 2)) if at >= 0 and ":" in text[at + len(name) + 2 :] else -1
    if at < 0:
        return ""
    out, k = [], at + 1
    short = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
    while k < len(text) and text[k] != '"':
        if text[k] != "\\":
            out.append(text[k])
            k += 1
            continue
        if k + 1 >= len(text):
            break
        if text[k + 1] != "u":
            out.append(short.get(text[k + 1], text[k + 1]))
            k += 2
            continue
        code = text[k + 2 : k + 6]
        if len(code) < 4:
            break
        unit, k = int(code, 16), k + 6
        if 0xD800 <= unit < 0xDC00:
            low = text[k + 2 : k + 6] if text[k : k + 2] == "\\u" else ""
            if len(low) < 4:
                break
            unit, k = 0x10000 + ((unit - 0xD800) << 10) + int(low, 16) - 0xDC00, k + 6
        out.append(chr(unit))
    return "".join(out)


def answers(pieces: DataFrame) -> DataFrame:
    """Stream of (job_id, event_id, data) -> (job_id, added): what each micro-batch adds to the answer field of a job's JSON. State: the JSON text so far and how much was given."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        text, given = state.get if state.exists else ("", 0)
        rows = pd.concat(list(frames)).sort_values("event_id")
        text += "".join(rows.data)
        now = answer_so_far(text)
        state.update((text, len(now)))
        yield pd.DataFrame({"job_id": [key[0]], "added": [now[given:]]})

    return pieces.select("job_id", "event_id", "data").groupBy("job_id").applyInPandasWithState(run, "job_id long, added string", "text string, given int", "append", GroupStateTimeout.NoTimeout)


def fold(events: DataFrame) -> DataFrame:
    """Stream of (job_id, event_id, expected, type, ...) -> the revision after each accepted batch.

    Optimistic revisions: an event is taken if it expects the revision that holds; others are counted as conflicts.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        revision, conflicts = state.get if state.exists else (0, 0)
        for _, row in pd.concat(list(frames)).sort_values("event_id").iterrows():
            if row.expected == revision:
                revision += 1
            else:
                conflicts += 1
        state.update((revision, conflicts))
        yield pd.DataFrame({"job_id": [key[0]], "revision": [revision], "conflicts": [conflicts]})

    return events.select("job_id", "event_id", "expected").groupBy("job_id").applyInPandasWithState(run, "job_id long, revision long, conflicts long", "revision long, conflicts long", "update", GroupStateTimeout.NoTimeout)


def revisions(events: DataFrame) -> DataFrame:
    """The same fold over a table: job_id, revision and conflicts. Jobs are dealt out and sorted by Spark; a task reads them batch by batch and carries two numbers, however many events a job has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job, revision, conflicts, some = None, 0, 0, False

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"job_id": [job], "revision": [revision], "conflicts": [conflicts]}, schema=pa.schema([(n, pa.int64()) for n in ("job_id", "revision", "conflicts")]))

        for batch in batches:
            for now, expected in zip(batch.column("job_id").to_pylist(), batch.column("expected").to_pylist(), strict=True):
                if some and now != job:
                    yield done()
                    revision = conflicts = 0
                job, some = now, True
                taken = expected == revision
                revision, conflicts = revision + taken, conflicts + (not taken)
        if some:
            yield done()

    rows = events.select(F.col("job_id").cast("long").alias("job_id"), "event_id", F.col("expected").cast("long").alias("expected"))
    return rows.repartition("job_id").sortWithinPartitions("job_id", "event_id").mapInArrow(run, "job_id long, revision long, conflicts long")
