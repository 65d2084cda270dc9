"""Ordered state machines as associative scans, so that the log of one hot key is split over tasks.

What an event does to a key's state is a function, and functions of some kinds are closed under composition. A request that
arrives at a and keeps the line busy for d turns the time x at which the line is free into max(a, x) + d; a block of requests is
x -> max(high, x + busy), two numbers (slots). An event of a machine with few states is a table of next states and of what it adds to a
counter, and so is a block (automaton). Rows are dealt out by ranges of (key, order), so a key's log lies in as many
neighbouring blocks as it needs. Each block is composed (one pass), the few functions of the blocks are composed in order, and
each block is read again with the state in which it starts (second pass).
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from webloom.checkpointing import cut
from webloom.operators.ordered import MIN_RPS

#: max-plus zero: no time at all.
NEVER = -(1 << 62)


def effective_interval(rps: float, factor: Column, until: Column, arrival_s: Column, jitter: Column) -> Column:
    """Microseconds between grants: 1 / rps, with the throttle factor while its window is open, times 0.8 to 1.2 by jitter (0 to 1)."""
    now = F.greatest(F.lit(MIN_RPS), F.lit(float(rps)) * F.when(arrival_s < until, factor).otherwise(1.0))
    return F.round(F.lit(1e6) / now * (F.lit(0.8) + jitter * F.lit(0.4))).cast("bigint")


def _groups(batch: pa.RecordBatch, key: int) -> list[tuple[int, int]]:
    """Runs of rows with one key (nulls are a key)."""
    k = batch.column(key)
    if not len(k):
        return []
    a, b = k.slice(1), k.slice(0, len(k) - 1)
    same = pc.if_else(pc.and_(pc.is_null(a), pc.is_null(b)), True, pc.fill_null(pc.equal(a, b), False))
    cuts = np.concatenate(([0], np.flatnonzero(~same.to_numpy(zero_copy_only=False).astype(bool)) + 1, [len(k)]))
    return list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))


def _blocks_of(df: DataFrame, key: str, order: list[str], blocks: int | None) -> DataFrame:
    """df in blocks by ranges of (key, order), sorted within, with the number of the block."""
    n = blocks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(n, key, *order).withColumn("_block", F.spark_partition_id()).sortWithinPartitions(key, *order))


def slots(df: DataFrame, key: str, order: list[str], arrival: str, interval: str, blocks: int | None = None) -> DataFrame:
    """df with slot: when each request may start (bigint, as arrival): not before it arrives, nor before the one before it in the key's
    order has started and its interval is over. arrival and interval are bigint and not null; order must be a total order."""
    dealt = _blocks_of(df, key, order, blocks)
    names = dealt.columns
    at, a_at, d_at, b_at = (names.index(c) for c in (key, arrival, interval, "_block"))
    kind = dealt.schema[key].dataType
    key_type = to_arrow_type(kind)

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The composed functions of a block's first and last key; keys between them are in no other block."""
        found: list[list] = []
        block = None
        for b in batches:
            if not b.num_rows:
                continue
            block = b.column(b_at)[0].as_py()
            a, d = b.column(a_at).to_numpy(zero_copy_only=False).astype(np.int64), b.column(d_at).to_numpy(zero_copy_only=False).astype(np.int64)
            for i, j in _groups(b, at):
                total = np.cumsum(d[i:j])
                high, busy = int((a[i:j] - total + d[i:j]).max() + total[-1]), int(total[-1])
                k = b.column(at)[i].as_py()
                if found and found[-1][0] == k:
                    last = found[-1]
                    last[1], last[2] = max(high, last[1] + busy), last[2] + busy
                else:
                    found.append([k, high, busy])
                    if len(found) > 2:  # a key inside a block is in no other one
                        del found[1]
        rows = [(k, block, place, high, busy) for place, (k, high, busy) in enumerate(found)]
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], key_type), *[pa.array(c, pa.int64()) for c in columns[1:]]], names=["key", "block", "place", "high", "busy"])

    functions = dealt.mapInArrow(compose, f"key {kind.simpleString()}, block bigint, place bigint, high bigint, busy bigint").collect()  # two a block at most
    starts: dict[int, tuple] = {}
    last_key, free = object(), NEVER
    for r in sorted(functions, key=lambda r: (r.block, r.place)):
        if r.key != last_key:
            last_key, free = r.key, NEVER
        else:
            starts[r.block] = (r.key, free)
        free = max(r.high, free + r.busy)

    schema = dealt.drop("_block").withColumn("slot", F.lit(0).cast("bigint")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, free, begun = None, NEVER, False
        for b in batches:
            if not b.num_rows:
                continue
            a, d = b.column(a_at).to_numpy(zero_copy_only=False).astype(np.int64), b.column(d_at).to_numpy(zero_copy_only=False).astype(np.int64)
            out = np.empty(len(a), np.int64)
            for i, j in _groups(b, at):
                k = b.column(at)[i].as_py()
                if not begun or k != current:
                    start = starts.get(b.column(b_at)[0].as_py())
                    free = start[1] if not begun and start and start[0] == k else NEVER
                    current, begun = k, True
                before = np.cumsum(d[i:j]) - d[i:j]
                out[i:j] = np.maximum(np.maximum.accumulate(a[i:j] - before), free) + before
                free = int(out[j - 1] + d[j - 1])
            yield pa.RecordBatch.from_arrays([*[c for n, c in enumerate(b.columns) if n != b_at], pa.array(out)], names=schema.names)

    return dealt.mapInArrow(run, schema)



class Tables:
    """The composed function of a run of events: where each start state leads, and what is added to the counter on the way.

    Start states that have come to the same state stay together, so only the few different ones are carried on."""

    def __init__(self, n_states: int):
        self.group, self.added = np.arange(n_states), np.zeros(n_states, np.int64)
        self.now, self.more = np.arange(n_states), np.zeros(n_states, np.int64)

    def apply(self, kinds: np.ndarray, following: np.ndarray, gain: np.ndarray) -> None:
        for n, k in enumerate(kinds.tolist()):
            self.more += gain[k][self.now]
            self.now = following[k][self.now]
            if n % 16 == 15 and len(self.now) > 1:
                self._merge()

    def _merge(self) -> None:
        self.added += self.more[self.group]
        self.now, where = np.unique(self.now, return_inverse=True)
        self.group, self.more = where[self.group], np.zeros(len(self.now), np.int64)

    def to_bytes(self) -> bytes:
        self._merge()
        return zlib.compress(np.stack((self.now[self.group], self.added)).tobytes())


def automaton(df: DataFrame, key: str, order: list[str], kind: str, following: np.ndarray, gain: np.ndarray, start: int, blocks: int | None = None) -> DataFrame:
    """df with state and counter (bigint) after each event of a machine that starts anew for each key: an event of kind k (a column of
    numbers, not null) leads from state s to following[k][s] and adds gain[k][s] to the counter. order must be a total order."""
    dealt = _blocks_of(df, key, order, blocks)
    names, n_states = dealt.columns, following.shape[1]
    at, k_at, b_at = (names.index(c) for c in (key, kind, "_block"))
    key_kind = dealt.schema[key].dataType
    key_type = to_arrow_type(key_kind)

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The functions of a block's first and last key; a key between them is only looked at as long as it may be the last."""
        found: list[tuple] = []
        block = None
        for b in batches:
            if not b.num_rows:
                continue
            block = b.column(b_at)[0].as_py()
            kinds = b.column(k_at).to_numpy(zero_copy_only=False).astype(np.int64)
            groups = _groups(b, at)
            for n, (i, j) in enumerate(groups):
                k = b.column(at)[i].as_py()
                if found and found[-1][0] == k:
                    found[-1][1].apply(kinds[i:j], following, gain)
                elif not found or n == len(groups) - 1:
                    found = [*found[:1], (k, Tables(n_states))]
                    found[-1][1].apply(kinds[i:j], following, gain)
                elif n:
                    continue  # ends inside the batch, and so in no other block
                else:
                    found = found[:1]
        rows = [(k, block, place, t.to_bytes()) for place, (k, t) in enumerate(found)]
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        kinds_of = (key_type, pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds_of, strict=True)], names=["key", "block", "place", "tables"])

    functions = dealt.mapInArrow(compose, f"key {key_kind.simpleString()}, block bigint, place bigint, tables binary").collect()  # two a block at most
    starts: dict[int, tuple] = {}
    last_key, state, count = object(), start, 0
    for r in sorted(functions, key=lambda r: (r.block, r.place)):
        if r.key != last_key:
            last_key, state, count = r.key, start, 0
        else:
            starts[r.block] = (r.key, state, count)
        to, added = np.frombuffer(zlib.decompress(r.tables), np.int64).reshape(2, -1)
        state, count = int(to[state]), count + int(added[state])

    schema = dealt.drop("_block").withColumns({"state": F.lit(0).cast("bigint"), "counter": F.lit(0).cast("bigint")}).schema
    next_of, gain_of = following.tolist(), gain.tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, count, begun = None, start, 0, False
        for b in batches:
            if not b.num_rows:
                continue
            kinds = b.column(k_at).to_pylist()
            states, counts = [0] * len(kinds), [0] * len(kinds)
            for i, j in _groups(b, at):
                k = b.column(at)[i].as_py()
                if not begun or k != current:
                    known = starts.get(b.column(b_at)[0].as_py()) if not begun else None
                    state, count = known[1:] if known and known[0] == k else (start, 0)
                    current, begun = k, True
                for n in range(i, j):
                    count += gain_of[kinds[n]][state]
                    states[n] = state = next_of[kinds[n]][state]
                    counts[n] = count
            yield pa.RecordBatch.from_arrays([*[c for n, c in enumerate(b.columns) if n != b_at], pa.array(states, pa.int64()), pa.array(counts, pa.int64())], names=schema.names)

    return dealt.mapInArrow(run, schema)


#: Kinds of requests for session health.
GOOD, BAD, BLOCKED = 0, 1, 2


def session_health(df: DataFrame, key: str, order: list[str], status: str, max_error: float = 3.0, max_usage: int = 50, blocked=(401, 403, 429), blocks: int | None = None) -> DataFrame:
    """webloom.operators.ordered.session_health with one key's log split over tasks: key, order, status, session, score, usage, retired.

    A state is (score in halves, usage, retired); the counter counts the sessions that were opened."""
    top, width = math.ceil(2 * max_error) + 2, max_usage + 1
    score, usage, retired = (x.ravel() for x in np.meshgrid(np.arange(top), np.arange(width), np.arange(2), indexing="ij"))
    s, u = np.where(retired, 0, score), np.where(retired, 0, usage)
    u = np.minimum(u + 1, max_usage)
    place = lambda a, b, c: (a * width + b) * 2 + c
    better, worse = np.maximum(s - 1, 0), np.minimum(s + 2, top - 1)
    out = lambda a, gone: place(a, u, (gone | (a >= 2 * max_error) | (u >= max_usage)).astype(np.int64))
    following = np.stack([out(better, False), out(worse, False), out(worse, True), out(better, True)])
    gain = np.stack([retired] * 4)
    fine = F.coalesce(F.col(status).between(200, 399), F.lit(False))
    stopped = F.coalesce(F.col(status).isin(*blocked), F.lit(False))
    kind = F.when(stopped, F.when(fine, 3).otherwise(BLOCKED)).when(fine, GOOD).otherwise(BAD)
    rows = df.select(key, *order, *[c for c in (status,) if c not in order]).withColumn("_kind", kind.cast("bigint"))
    got = automaton(rows, key, order, "_kind", following, gain, 0, blocks)
    half = F.floor(F.col("state") / (2 * width))
    return got.select(
        *[c for c in rows.columns if c != "_kind"], (F.col("counter") + 1).cast("int").alias("session"), (half / 2.0).alias("score"),
        F.pmod(F.floor(F.col("state") / 2), F.lit(width)).cast("int").alias("usage"), (F.col("state") % 2 == 1).alias("retired"),
    )
