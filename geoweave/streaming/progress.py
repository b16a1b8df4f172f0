"""Progress of jobs: percent done, the step reached, expired jobs; in batch and as a stream.

Events: job_id, seq, ts, step, idx (the step's number), complete (the step is
done with this event).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Key, label and weight of the steps; the weights add up to 100.
STEPS = (("upload", "Reading the file", 1), ("ocr_init", "Preparing text recognition", 3), ("ocr_pass1", "Clear numbers", 18), ("ocr_pass2", "Numbers at the edges", 18), ("ocr_pass3", "Faint numbers", 18), ("ocr_highscale", "Smallest numbers", 18), ("analyze", "Reading the drawing", 9), ("classify", "Finding parcels on the route", 7), ("render", "Drawing the preview", 8))
#: Part of the current step's weight that counts as done.
CURRENT_PART = 0.4
TTL_MINUTES = 30


def steps_table(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(i).alias("idx"), F.lit(k).alias("step"), F.lit(label).alias("label"), F.lit(w).alias("weight")) for i, (k, label, w) in enumerate(STEPS)])))


def step_ranges(steps: DataFrame) -> DataFrame:
    """Where each step begins and ends, in percent."""
    w = Window.orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # nine rows
    total = F.sum("weight").over(Window.partitionBy())
    done = F.sum("weight").over(w)
    return steps.select("idx", "step", F.round(100 * (done - F.col("weight")) / total, 6).alias("from_pct"), F.round(100 * done / total, 6).alias("to_pct"))


def monotone_steps(events: DataFrame) -> DataFrame:
    """Adds `reached`: the furthest step so far; a job's step never goes back."""
    w = Window.partitionBy("job_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumn("reached", F.max("idx").over(w))


def percents(events: DataFrame, steps: DataFrame) -> DataFrame:
    """(job_id, seq, percent): weights of the steps done so far, and a part of the current one if it is not; under 100 until then."""
    first = Window.partitionBy("job_id", "step", "complete").orderBy("seq")
    fresh = F.when(F.col("complete") & (F.row_number().over(first) == 1), F.col("weight")).otherwise(0)
    weighed = events.join(F.broadcast(steps.select("step", "weight")), "step").withColumn("fresh", fresh)
    run = Window.partitionBy("job_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    done = F.sum("fresh").over(run)
    part = done + F.when(F.col("complete"), 0.0).otherwise(CURRENT_PART * F.col("weight"))
    return weighed.select("job_id", "seq", F.least(F.bround(part), F.when(F.col("complete"), 100).otherwise(99)).cast("int").alias("percent"))


def expired(events: DataFrame, now: str, minutes: int = TTL_MINUTES) -> DataFrame:
    """The jobs whose last event is over ``minutes`` old at ``now``."""
    last = events.groupBy("job_id").agg(F.max("ts").alias("last_ts"))
    return last.filter(F.col("last_ts") < F.to_timestamp(F.lit(now)) - F.expr(f"INTERVAL {minutes} MINUTES"))


# How a line of the log begins, and the step that it belongs to; the first that fits counts.
LOG_STEPS = (("^paths:", "analyze"), ("^green segments:", "analyze"), ("^endpoint closures:", "analyze"), ("^endpoint extensions", "analyze"), ("^parallel endpoint closures:", "analyze"), ("^T-junction extensions:", "analyze"), ("^pin crosslines:", "analyze"), ("^route-end closures:", "analyze"), ("^route buffer frame:", "analyze"), ("^polygons:", "analyze"), ("^polygons after area filter:", "analyze"), ("^crossed green border segments:", "classify"), ("^road corridor polygon:", "classify"), ("^crossed polygons:", "classify"), ("^OCR labels", "classify"), ("^crossed=[0-9]+ borderline=[0-9]+", "classify"))
#: Seconds of silence after which a client is told that the job is alive.
IDLE_SECONDS = 30


def step_of_line(line: str = "line"):
    """The step that a line of the log belongs to, or null."""
    return F.coalesce(*[F.when(F.col(line).rlike(pattern), F.lit(step)) for pattern, step in LOG_STEPS])


def until_cancelled(events: DataFrame, requests: DataFrame) -> DataFrame:
    """Adds `cancelled`: events of a job up to its first cancel request (job_id, ts), and of later ones the first, which ends it."""
    first = requests.groupBy("job_id").agg(F.min("ts").alias("asked"))
    j = events.join(first, "job_id", "left").withColumn("cancelled", F.coalesce(F.col("ts") > F.col("asked"), F.lit(False)))
    w = Window.partitionBy("job_id", "cancelled").orderBy("seq")
    return j.withColumn("n", F.row_number().over(w)).filter("NOT cancelled OR n = 1").drop("n", "asked")


def keepalives(events: DataFrame, seconds: int = IDLE_SECONDS) -> DataFrame:
    """(job_id, seq, k, ts): a keepalive for every ``seconds`` of silence after an event of a job, until its next one."""
    w = Window.partitionBy("job_id").orderBy("seq")
    quiet = events.withColumn("n", F.floor((F.unix_timestamp(F.lead("ts").over(w)) - F.unix_timestamp("ts") - 1) / seconds)).filter("n > 0")
    return quiet.select("job_id", "seq", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("k"), "ts").withColumn("ts", F.timestamp_seconds(F.unix_timestamp("ts") + F.col("k") * seconds))


def ticker(start, cap, elapsed, expected):
    """Estimated percent within a step: linear up to 95 percent of the way to its end."""
    return start + (cap - start) * 0.95 * F.least(F.lit(1.0), elapsed / expected)


def reading_estimate(area, least: float = 40.0, most: float = 1800.0):
    """Expected seconds of reading a page of so many square points: a quarter second for each thousand."""
    return F.least(F.lit(most), F.greatest(F.lit(least), area / 1000 * 0.25))


def duration_text(seconds):
    return F.when(seconds < 60, F.concat(F.lit("~"), F.bround(seconds).cast("long").cast("string"), F.lit(" s"))).otherwise(F.concat(F.lit("~"), F.bround(seconds / 60).cast("long").cast("string"), F.lit(" min")))


def sse_lines(events: DataFrame) -> DataFrame:
    """Server-sent event lines of the events' columns."""
    return events.select("job_id", F.concat(F.lit("data: "), F.to_json(F.struct(*[F.col(c) for c in events.columns if c != "job_id"])), F.lit("\n\n")).alias("line"))


def progress_stream(events: DataFrame, timeout_minutes: int = TTL_MINUTES) -> DataFrame:
    """(job_id, seq, percent) from a stream of events; a job's state goes after its time to live."""
    weights = {k: w for k, _, w in STEPS}

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen = state.get[0] if state.exists else ""
        done = [s for s in seen.split(",") if s]
        rows = []
        for batch in batches:
            for seq, step, complete in batch.sort_values("seq")[["seq", "step", "complete"]].itertuples(index=False):
                if complete and step not in done:
                    done.append(step)
                part = sum(weights.get(x, 0) for x in done) + (0 if complete else CURRENT_PART * weights.get(step, 0))
                rows.append((key[0], int(seq), min(100 if complete else 99, round(part))))
        state.update((",".join(done),))
        state.setTimeoutDuration(timeout_minutes * 60_000)
        yield pd.DataFrame(rows, columns=["job_id", "seq", "percent"])

    return events.groupBy("job_id").applyInPandasWithState(run, "job_id long, seq long, percent int", "done string", "append", "ProcessingTimeTimeout")
