"""Event logs as streams: windowed counts, session health with kept state, last page by URL."""

from __future__ import annotations

import logging
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from webloom.streaming.metrics import LastPassed

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
HEALTH = "pool bigint, event_id bigint, session int, score double, usage int, retired boolean"


def read_events(spark: SparkSession, path: str, max_files: int = 64) -> DataFrame:
    """The events table as a stream of files, with ts as a time-zoned event time."""
    folder, name = path.rsplit("/", 1)
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", max_files).option("pathGlobFilter", name).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts and sums by window and type; windows close when the watermark passes them."""
    keyed = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    out = keyed.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "total")


def session_health(requests: DataFrame, max_error: float = 3.0, max_usage: int = 50, blocked=(401, 403, 429)) -> DataFrame:
    """The session fold of webloom.operators.ordered with its state in the state store: requests (pool, event_id, status)."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        session, score, usage, retired = state.get if state.exists else (1, 0.0, 0, False)
        rows = pd.concat(list(frames)).sort_values("event_id")
        out = []
        for event_id, status in zip(rows["event_id"], rows["status"], strict=True):
            if retired:
                session, score, usage = session + 1, 0.0, 0
            usage += 1
            score = max(0.0, score - 0.5) if 200 <= status < 400 else score + 1.0
            retired = status in blocked or score >= max_error or usage >= max_usage
            out.append((key[0], event_id, session, score, usage, retired))
        state.update((session, score, usage, retired))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in HEALTH.split(", ")])

    kept = "session int, score double, usage int, retired boolean"
    return requests.groupBy("pool").applyInPandasWithState(step, HEALTH, kept, "append", GroupStateTimeout.NoTimeout)


def throttle(log: DataFrame, cooldown: float = 60.0) -> DataFrame:
    """The throttle fold of webloom.operators.ordered with its state in the state store: log (pool, event_id, t, kind)."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        factor, until = state.get if state.exists else (1.0, -1e18)
        rows = pd.concat(list(frames)).sort_values(["t", "event_id"])
        factors = []
        for t, kind in zip(rows["t"], rows["kind"], strict=True):
            if kind == "slow":
                factor, until = max(0.1, factor * 0.5), t + cooldown
            elif kind == "ok" and t >= until and factor < 1:
                factor = min(1.0, factor * 1.5)
            factors.append(factor)
        state.update((factor, until))
        yield pd.DataFrame({"pool": key[0], "event_id": rows["event_id"].to_numpy(), "factor": factors})

    return log.groupBy("pool").applyInPandasWithState(step, "pool bigint, event_id bigint, factor double", "factor double, until double", "append", GroupStateTimeout.NoTimeout)


def replay_then_follow(log: DataFrame, stream: DataFrame, handle, checkpoint: str, seq: str = "seq", kind: str = "type", final=("done", "cancelled", "failed")):
    """What a late subscriber does: handle the stored log once, then each new batch without what the log had (seq up to its
    last). A log with a final event is complete: no stream is started, and None is returned."""
    handle(log, -1)
    last, ended = log.agg(F.max(seq), F.bool_or(F.col(kind).isin(*final))).first()
    if ended:
        return None
    return write_batches(stream if last is None else stream.where(F.col(seq) > F.lit(last)), handle, checkpoint)


def on_change(handle, folder: str | None = None):
    """A handler that passes a batch on only if its rows differ from those passed on last (a few rows, such as counters). With a folder
    (beside the stream's checkpoint) what was passed on last is known after a restart too."""
    last = LastPassed(folder)

    def run(df: DataFrame, batch_id: int) -> None:
        n, total = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()
        now = [n, str(total)]
        if n and last.differs(now):
            handle(df, batch_id)
            last.keep(now, batch_id)

    return run


def fan_out(stream: DataFrame, consumers: dict, checkpoint: str, log=None) -> dict:
    """One independent query for each consumer (name -> handle), with a checkpoint of its own. A consumer that raises
    BufferError (it is full) loses that batch, which is logged; the others don't notice."""
    note = log or (lambda name, batch_id: logging.getLogger(__name__).warning("%s is full, batch %s dropped", name, batch_id))

    def guarded(name, handle):
        def run(df: DataFrame, batch_id: int) -> None:
            try:
                handle(df, batch_id)
            except BufferError:
                note(name, batch_id)

        return run

    return {name: write_batches(stream, guarded(name, handle), f"{checkpoint}/{name}") for name, handle in consumers.items()}


def run_once(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Process all there is, then stop; the result as a table of files beside the checkpoint, never on the driver.

    Each batch is written to a folder of its own, so a batch that is tried again replaces what it had written. In complete
    mode the last batch is the result."""
    spark, out = stream.sparkSession, f"{checkpoint}/out-{name}"
    batches: list[int] = []

    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        batches.append(batch_id)

    q = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{checkpoint}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    kept = batches[-1:] if mode == "complete" else sorted(set(batches))
    if not kept:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(*[f"{out}/batch={b}" for b in kept])


def write_batches(stream: DataFrame, handle, checkpoint: str, interval: str = "500 milliseconds"):
    """A running query that gives each batch to handle(df, batch_id); stop() it to cancel."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()
