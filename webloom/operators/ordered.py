"""State machines over ordered events: rate limits, throttling and session health, one pass per key.

The linear ones are window functions. Those whose state feeds back are scans: rows are dealt out by key, sorted, and read
batch by batch with the state of the current key in hand, so time is linear in the events and a key's log of any length needs
no more memory than a batch. The log of one key is read by one task, since each state needs the one before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string
from pyspark.sql.window import Window

MIN_RPS = 0.01


def token_slots(df: DataFrame, key: str, order: list[str], arrival: str, rps: float) -> DataFrame:
    """slot: when each request may start, at least 1/rps after the one before: i*d + max over j <= i of (a_j - j*d)."""
    gap = 1.0 / max(MIN_RPS, rps)
    w = Window.partitionBy(key).orderBy(*order)
    n = F.row_number().over(w) - 1
    late = F.max(F.col("_lead")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    df = df.withColumn("_n", n).withColumn("_lead", F.col(arrival) - F.col("_n") * gap)
    return df.withColumn("slot", late + F.col("_n") * gap).drop("_n", "_lead")


def throttle(df: DataFrame, key: str, order: list[str], ts: str, kind: str, cooldown: float = 60.0) -> DataFrame:
    """kind 'slow' (429 or 503) halves the factor to at least 0.1 and opens a window; 'ok' after the window raises it by half."""

    def step(state, t, what):
        factor, until = state
        if what == "slow":
            return max(0.1, factor * 0.5), t + cooldown
        if what == "ok" and factor < 1 and t is not None and t >= until:
            return min(1.0, factor * 1.5), until
        return state

    return _scan(df, key, order, [ts, kind], (1.0, -1e18), step, "factor double, until double")


def session_health(df: DataFrame, key: str, order: list[str], status: str, max_error: float = 3.0, max_usage: int = 50, blocked=(401, 403, 429)) -> DataFrame:
    """session (number), score, usage and retired after each request; a request after a retirement opens a new session."""

    def step(state, code):
        session, score, usage, retired = state
        if retired:
            session, score, usage = session + 1, 0.0, 0
        score = max(0.0, score - 0.5) if code is not None and 200 <= code < 400 else score + 1.0
        return session, score, usage + 1, code in blocked or score >= max_error or usage + 1 >= max_usage

    return _scan(df, key, order, [status], (1, 0.0, 0, False), step, "session int, score double, usage int, retired boolean")


def _scan(df: DataFrame, key: str, order: list[str], values: list[str], start: tuple, step: Callable, state: str) -> DataFrame:
    """key, order, values and the state after each event: step(state, *values)."""
    rows = df.select(key, *order, *[c for c in values if c not in order])
    added = _parse_datatype_string(state)
    kinds = [f.type for f in to_arrow_schema(added)]
    schema = StructType(rows.schema.fields + added.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, now = object(), start
        for b in batches:
            out = []
            for k, *x in zip(b.column(key).to_pylist(), *[b.column(c).to_pylist() for c in values], strict=True):
                if k != current:
                    current, now = k, start
                now = step(now, *x)
                out.append(now)
            columns = list(zip(*out, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], names=schema.names)

    return rows.repartition(key).sortWithinPartitions(*rows.columns).mapInArrow(run, schema)
