"""Streams that follow journals."""

import time

from factloom.streaming import follow, journal

SCHEMA = journal.JOURNAL


def put(spark, path, rows):
    spark.createDataFrame([(*r, None) for r in rows], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_followed_events_equal_the_closed_journal(spark, tmp_path):
    path, out, place = (str(tmp_path / k) for k in ("in", "out", "place"))
    first = [(1, 1, "progress", "a"), (1, 3, "progress", "b"), (2, 2, "progress", "c"), (3, 4, "done", "d"), (3, 5, "progress", "late")]
    second = [(1, 6, "done", "e"), (1, 7, "progress", "late"), (2, 8, "progress", "f"), (4, 9, "failed", "g")]
    put(spark, path, first)
    stream = follow.followed(journal.journal_stream(spark, path), silence=3600)
    for rows in (None, second):
        if rows:
            put(spark, path, rows)
        # a stream with timeouts never has nothing to wait for, so it is stopped once all files were read
        query = stream.writeStream.format("parquet").option("checkpointLocation", place).start(out)
        for _ in range(90):
            time.sleep(0.5)
            if sum(p["numInputRows"] for p in query.recentProgress) >= len(rows or first):
                break
        query.stop()
    got = sorted((r.job_id, r.event_id, r.type) for r in spark.read.parquet(out).collect())
    batch = sorted((r.job_id, r.event_id, r.type) for r in journal.closed(spark.read.parquet(path)).collect())
    assert got == batch and (3, 5, "progress") not in got and (1, 6, "done") in got


def test_silence_gives_heartbeats(spark, tmp_path):
    path = str(tmp_path / "in")
    put(spark, path, [(1, 1, "progress", "a"), (2, 2, "done", "b")])
    stream = follow.followed(journal.journal_stream(spark, path), silence=1)
    query = stream.writeStream.format("memory").queryName("beats").option("checkpointLocation", str(tmp_path / "place")).trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            time.sleep(1)
            rows = spark.table("beats").collect()
            if sum(r.type == follow.HEARTBEAT for r in rows) >= 2:
                break
    finally:
        query.stop()
    beats = [r for r in rows if r.type == follow.HEARTBEAT]
    assert len(beats) >= 2 and {(r.job_id, r.event_id) for r in beats} == {(1, 1)}
    assert sorted((r.job_id, r.event_id) for r in rows if r.type != follow.HEARTBEAT) == [(1, 1), (2, 2)]


def test_evicted_jobs_equal_the_batch(spark, tmp_path):
    path, out, place = (str(tmp_path / k) for k in ("in", "out", "place"))
    batches = [[(j, j, "done" if j % 2 else "progress", "x") for j in range(6)], [(j, 10 + j, "done", "x") for j in (0, 2, 4)], [(9, 100, "done", "x")]]
    for rows in batches:
        put(spark, path, rows)
        stream = follow.evicted(journal.journal_stream(spark, path, per_trigger=1), most=3)
        query = stream.writeStream.format("parquet").option("checkpointLocation", place).trigger(availableNow=True).start(out)
        query.awaitTermination(180)
    gone = {r.job_id for r in spark.read.parquet(out).collect()}
    states = journal.job_states(spark.read.parquet(path))
    kept = {r.job_id for r in journal.retained(states, 3).collect()}
    assert gone == {r.job_id for r in states.collect()} - kept
