"""The job stream against the batch operator: endings, late cancels, silence and expiry."""

import time

import pytest
from pyspark.sql import functions as F

from geoweave.streaming import jobs
from geoweave.streaming.progress import STEPS

EVENT = "job_id long, seq long, ts timestamp, kind string, step string, complete boolean"
REQUEST = "job_id long, ts timestamp"
STORE = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(STORE)


def at(second):
    return f"2024-01-01 00:{second // 60:02d}:{second % 60:02d}"


def frame(spark, rows, schema):
    plain = schema.replace("timestamp", "string")
    return spark.createDataFrame(rows, plain).withColumn("ts", F.to_timestamp("ts"))


def job(j, n, start=0, error=None):
    """Two events for each step: it begins, it is complete."""
    rows = [(j, k, at(start + k), "step", STEPS[k // 2][0], k % 2 == 1) for k in range(n)]
    return [(*r[:3], "error", None, None) if r[1] == error else r for r in rows]


def sorted_key(rows):
    return sorted(map(str, rows))


def run(spark, tmp_path, steps, **how):
    """Writes the (events, requests) of each step as files, one step after the other, and returns all messages.

    Timers keep a query that runs until all is read from ending, so each step is one batch.
    """
    source = {n: str(tmp_path / n) for n in ("events", "requests")}
    for n, schema in (("events", EVENT), ("requests", REQUEST)):
        frame(spark, [], schema).write.parquet(source[n])
    for events, requests in steps:
        frame(spark, events, EVENT).coalesce(1).write.mode("append").parquet(source["events"])
        if requests:
            frame(spark, requests, REQUEST).coalesce(1).write.mode("append").parquet(source["requests"])
        read = [spark.readStream.schema(s).parquet(source[n]) for n, s in (("events", EVENT), ("requests", REQUEST))]
        out = jobs.job_message_stream(*read, **how).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        q = out.option("checkpointLocation", str(tmp_path / "cp")).trigger(once=True).start()
        assert q.awaitTermination(120)
    return spark.read.schema(jobs.MESSAGE).parquet(str(tmp_path / "out")).collect()


def messages_by_hand(events, asked):
    out, done, first = [], [], True
    for j, seq, ts, kind, step, complete in events:
        if first:
            out.append((j, seq, 0, "init", None, None))
            first = False
        ending = "cancelled" if asked and ts > asked else "error" if kind == "error" else None
        if not ending:
            if complete and step not in done:
                done.append(step)
            weight = {k: w for k, _, w in STEPS}
            part = sum(weight[s] for s in done) + (0 if complete else 0.4 * weight[step])
            out += [(j, seq, 1, "step", step, None), (j, seq, 2, "progress", None, min(100 if complete else 99, round(part)))]
            ending = "done" if complete and step == "render" else None
        if ending:
            return [*out, (j, seq, 3, ending, None, None), (j, seq, 4, "close", None, None)]
    return out


def test_stream_equals_batch(rocks, tmp_path):
    """A job that is done, one cancelled, one that fails, one still open, over two runs of the stream."""
    events = {1: job(1, 18) + [(1, 18, at(90), "step", "upload", True)], 2: job(2, 12), 3: job(3, 9, error=5), 4: job(4, 7)}
    requests = [(2, at(6)), (2, at(9))]
    every = [r for rows in events.values() for r in rows]
    batch = jobs.job_messages(frame(rocks, every, EVENT), frame(rocks, requests, REQUEST)).collect()
    want = [m for j, rows in events.items() for m in messages_by_hand(rows, at(6) if j == 2 else None)]
    assert sorted_key(tuple(r) for r in batch) == sorted_key(want)
    halves = [([r for r in every if r[1] < 6], requests), ([r for r in every if r[1] >= 4], [])]  # two events come twice
    assert sorted_key(tuple(r) for r in run(rocks, tmp_path, halves)) == sorted_key(want)


def test_late_cancel_ends_at_the_next_event(rocks, tmp_path):
    rows = job(1, 10)
    got = run(rocks, tmp_path, [(rows[:6], []), (rows[6:], [(1, at(2))])])
    kinds = [(r["seq"], r["type"]) for r in got if r["ord"] >= 3]
    assert sorted(kinds) == [(6, "cancelled"), (6, "close")]
    assert max(r["seq"] for r in got) == 6


def test_silence_and_expiry(rocks, tmp_path):
    """A silent job is told alive until its time to live is over; a closed one is not."""
    source = str(tmp_path / "events")
    frame(rocks, job(1, 2) + job(2, 18), EVENT).coalesce(1).write.parquet(source)
    none = str(tmp_path / "requests")
    frame(rocks, [], REQUEST).write.parquet(none)
    read = rocks.readStream.schema(EVENT).parquet(source), rocks.readStream.schema(REQUEST).parquet(none)
    out = jobs.job_message_stream(*read, idle_seconds=1.0, ttl_minutes=4 / 60)
    q = out.writeStream.format("memory").queryName("alive").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="500 milliseconds").start()
    try:
        until, beats = time.time() + 60, []
        while time.time() < until and len(beats) < 3:
            time.sleep(1)
            beats = rocks.table("alive").filter("type = 'keepalive'").collect()
        time.sleep(6)
        beats = rocks.table("alive").filter("type = 'keepalive'").collect()
    finally:
        q.stop()
    assert {r["job_id"] for r in beats} == {1} and 3 <= len(beats) <= 4
    assert sorted(r["ord"] for r in beats) == list(range(5, 5 + len(beats)))
