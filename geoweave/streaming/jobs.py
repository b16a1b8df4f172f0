"""What a client of a job is told, from the job's events and cancel requests; in batch and as a stream.

Events: job_id, seq, ts, kind (`step` or `error`), step, complete. Requests: job_id, ts. A job's messages are
`init`, then `step` and `progress` for every step, and one ending: `done` when the last step is complete,
`cancelled` at the first event after a request, or `error`; `close` follows the ending, and nothing comes after it.
A stream also sends `keepalive` while a job is silent, and forgets a job after its time to live.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from geoweave.streaming.progress import CURRENT_PART, IDLE_SECONDS, STEPS, TTL_MINUTES, percents, steps_table

WEIGHTS = {key: weight for key, _, weight in STEPS}
LAST = STEPS[-1][0]
MESSAGE = "job_id long, seq long, ord int, type string, step string, percent int"


def _message(ord_: int, kind: str, step: Column | None = None, percent: Column | None = None) -> Column:
    text, number = F.lit(None).cast("string"), F.lit(None).cast("int")
    return F.struct(F.lit(ord_).alias("ord"), F.lit(kind).alias("type"), (text if step is None else step).alias("step"), (number if percent is None else percent).alias("percent"))


def job_messages(events: DataFrame, requests: DataFrame) -> DataFrame:
    """(job_id, seq, ord, type, step, percent): all messages of finished and open jobs, in batch."""
    asked = requests.groupBy("job_id").agg(F.min("ts").alias("asked"))
    marked = events.join(asked, "job_id", "left").withColumn("cancelled", F.coalesce(F.col("ts") > F.col("asked"), F.lit(False)))
    finished = (F.col("step") == LAST) & F.col("complete")
    ending = F.when(F.col("cancelled"), "cancelled").when(F.col("kind") == "error", "error").when(finished, "done")
    by_job = Window.partitionBy("job_id").orderBy("seq")
    ended = F.count("ending").over(by_job.rowsBetween(Window.unboundedPreceding, -1))
    live = marked.withColumn("ending", ending).withColumn("ended", ended).filter("ended = 0").withColumn("first", F.row_number().over(by_job) == 1)
    plain = ~F.coalesce(F.col("ending").isin("cancelled", "error"), F.lit(False))
    known = percents(live.filter(plain), steps_table(events.sparkSession)).withColumnRenamed("percent", "share")
    told = live.join(known, ["job_id", "seq"], "left")
    messages = F.array(
        F.when(F.col("first"), _message(0, "init")),
        F.when(plain, _message(1, "step", F.col("step"))),
        F.when(plain, _message(2, "progress", None, F.col("share"))),
        *(F.when(F.col("ending") == kind, _message(3, kind)) for kind in ("done", "cancelled", "error")),
        F.when(F.col("ending").isNotNull(), _message(4, "close")),
    )
    return told.select("job_id", "seq", F.inline(F.array_compact(messages)))


class JobMessages(StatefulProcessor):
    """State of a job: the steps done (a list), when it was asked to stop, whether it is closed, its last event and keepalives (one value)."""

    def __init__(self, idle_seconds: float = IDLE_SECONDS, ttl_minutes: float = TTL_MINUTES):
        self.idle, self.ttl = int(idle_seconds * 1000), int(ttl_minutes * 60_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.done = handle.getListState("done", "step string", self.ttl)
        self.job = handle.getValueState("job", "seq long, asked long, closed boolean, beats int", self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        seq, asked, closed, _ = self.job.get() if self.job.exists() else (-1, None, False, 0)
        asks = batch.loc[batch.kind == "cancel", "at"]
        if len(asks):
            asked = int(asks.min()) if asked is None else min(int(asks.min()), asked)
        done = [s for (s,) in self.done.get()] if self.done.exists() else []
        known, out = len(done), []
        for row in batch[batch.kind != "cancel"].sort_values("seq").itertuples(index=False):
            if closed or row.seq <= seq:  # a repeated event says nothing new
                continue
            if seq < 0:
                out.append((row.seq, 0, "init", None, None))
            seq, ending = row.seq, None
            if asked is not None and row.at > asked:
                ending = "cancelled"
            elif row.kind == "error":
                ending = "error"
            else:
                if row.complete and row.step not in done:
                    done.append(row.step)
                part = sum(WEIGHTS.get(s, 0) for s in done) + (0 if row.complete else CURRENT_PART * WEIGHTS.get(row.step, 0))
                out += [(row.seq, 1, "step", row.step, None), (row.seq, 2, "progress", None, min(100 if row.complete else 99, round(part)))]
                ending = "done" if row.step == LAST and row.complete else None
            if ending:
                closed = True
                out += [(row.seq, 3, ending, None, None), (row.seq, 4, "close", None, None)]
        for step in done[known:]:
            self.done.appendValue((step,))
        self.job.update((int(seq), asked, bool(closed), 0))
        self._wake(timerValues, None if closed else self.idle)
        yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.job.exists():
            return
        seq, asked, closed, beats = self.job.get()
        if closed or (beats + 1) * self.idle > self.ttl:
            self.job.clear()
            self.done.clear()
            return
        # the state's time to live counts from the last event, as the number of beats does
        self.job.update((seq, asked, closed, beats + 1))
        self._wake(timerValues, self.idle)
        if seq >= 0:
            yield self._rows(key, [(seq, 5 + beats, "keepalive", None, None)])

    def _wake(self, timerValues, after: int | None) -> None:
        """One timer for each job: at the next keepalive, or when a closed job is forgotten."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + (self.ttl if after is None else after))

    @staticmethod
    def _rows(key, out: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame([(key[0], *r) for r in out], columns=["job_id", "seq", "ord", "type", "step", "percent"])
        return frame.astype({"job_id": "int64", "seq": "int64", "ord": "int32", "percent": "Int32"})

    def close(self) -> None:
        pass


def as_input(events: DataFrame, requests: DataFrame) -> DataFrame:
    """Events and cancel requests as rows of one kind, keyed by job."""
    at = F.unix_micros(F.col("ts")).alias("at")
    rows = events.select("job_id", F.col("seq").cast("long").alias("seq"), at, "kind", "step", "complete")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("step", "string"), ("complete", "boolean"))]
    return rows.unionByName(requests.select("job_id", F.lit(-1).cast("long").alias("seq"), at, F.lit("cancel").alias("kind"), *none))


def job_message_stream(events: DataFrame, requests: DataFrame, idle_seconds: float = IDLE_SECONDS, ttl_minutes: float = TTL_MINUTES) -> DataFrame:
    """The messages of streams of events and requests; the session's state store must be the RocksDB one.

    A request that comes with or before an event that it precedes ends the job there, as in batch; one that
    comes too late ends it at the next event.
    """
    processor = JobMessages(idle_seconds, ttl_minutes)
    keyed = as_input(events, requests).groupBy("job_id")
    return keyed.transformWithStateInPandas(processor, MESSAGE, "Append", "ProcessingTime")
