"""Following journals as streams: events as they come, heartbeats in silence, jobs let go by age."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from factloom.streaming.journal import TERMINAL

#: Seconds of silence of a running job after which a heartbeat is sent.
SILENCE = 15
HEARTBEAT = "heartbeat"
_EVENTS = "job_id long, event_id long, type string, data string"


def followed(events: DataFrame, silence: float = SILENCE) -> DataFrame:
    """Each job's events in order, none twice and none behind the terminal one; a heartbeat with the last event's id for each `silence` seconds without an event while the job runs.

    events: a stream of a journal. State is a job's last event and whether it ended the
    job; a timeout of processing time stands for the silence, and an ended job has none.
    An event that comes after a later one was passed on is left out, as a follower that
    resumes by id would leave it out.
    """
    wait = int(silence * 1000)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, ended = state.get if state.exists else (0, False)
        if state.hasTimedOut:
            state.setTimeoutDuration(wait)
            yield pd.DataFrame({"job_id": [key[0]], "event_id": [last], "type": [HEARTBEAT], "data": [None]})
            return
        # a batch holds some events of a job; they are sorted, as files may come in any order
        rows = pd.concat(list(frames)).sort_values("event_id").drop_duplicates("event_id")
        rows = rows[(rows["event_id"] > last) & (not ended)]
        ends = rows.loc[rows["type"].isin(TERMINAL), "event_id"]
        if len(ends):
            rows, ended = rows[rows["event_id"] <= ends.iloc[0]], True
        state.update((int(rows["event_id"].max()) if len(rows) else last, bool(ended)))
        if not ended:
            state.setTimeoutDuration(wait)
        yield rows[["job_id", "event_id", "type", "data"]]

    own = events.select("job_id", "event_id", "type", "data").where("job_id is not null and event_id is not null")
    return own.groupBy("job_id").applyInPandasWithState(run, _EVENTS, "last long, ended boolean", "append", GroupStateTimeout.ProcessingTimeTimeout)


def evicted(events: DataFrame, most: int = 50) -> DataFrame:
    """job_id, last_event of finished jobs as they are let go, the oldest first, while there are more than `most`; running ones stay.

    One state holds the jobs that are kept, as many as `most` and those that run; batches
    reach it a row a job, as they are summed up before, so it sees jobs and not events.
    """

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            own = rows.assign(finished=rows["type"].isin(TERMINAL)).groupby("job_id", as_index=False).agg(last=("event_id", "max"), finished=("finished", "max"))
            yield own.assign(all=0)[["all", "job_id", "last", "finished"]]

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {int(k): v for k, v in json.loads(state.get[0]).items()} if state.exists else {}
        for rows in frames:
            for job, last, finished in zip(rows["job_id"].tolist(), rows["last"].tolist(), rows["finished"].tolist(), strict=True):
                before = held.get(job, [0, False])
                held[job] = [max(before[0], last), before[1] or finished]
        done = sorted((last, job) for job, (last, finished) in held.items() if finished)
        gone = done[: max(0, min(len(done), len(held) - most))]
        for _, job in gone:
            del held[job]
        state.update((json.dumps(held),))
        yield pd.DataFrame({"job_id": [job for _, job in gone], "last_event": [last for last, _ in gone]}, dtype="int64")

    slim = events.select("job_id", "event_id", "type").where(F.col("job_id").isNotNull() & F.col("event_id").isNotNull())
    slim = slim.mapInPandas(summed, "all int, job_id long, last long, finished boolean")
    return slim.groupBy("all").applyInPandasWithState(run, "job_id long, last_event long", "jobs string", "append", GroupStateTimeout.NoTimeout)
