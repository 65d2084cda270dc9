"""Streams with event time: ordered keyed state with timers, joins of two streams, sessions, and a side table of late rows.

OrderedFold holds a key's events back until the watermark has passed them and then folds them in order of time, so files may come
in any order within the watermark's delay. A fold may put entries on the key's agenda; they come due, in the same order of
time, when the watermark passes them. State is typed and kept in the state store; memory is a key's events of one delay.
"""

from __future__ import annotations

import contextlib
import heapq
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType, _parse_datatype_string

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SECOND = 1_000_000


@contextlib.contextmanager
def timed_state(spark: SparkSession) -> Iterator[None]:
    """Start queries with timers inside: they need a state store with column families."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


class Fold:
    """What an ordered fold does. Times are microseconds; None as state means that there is nothing to keep.

    state, payload and out are schemas: the kept state, what of an event (besides time and order) is read, and an output row
    after the key. event() and due() give the new state, output rows, and new agenda entries (time, tag, seq, n)."""

    state: str
    payload: str
    out: str

    def event(self, state: tuple | None, at: int, seq: int, payload: tuple) -> tuple[tuple | None, list[tuple], list[tuple]]:
        raise NotImplementedError

    def due(self, state: tuple | None, at: int, tag: str, seq: int, n: int) -> tuple[tuple | None, list[tuple], list[tuple]]:
        return state, [], []


class _Timer:
    """One event-time timer of a key: the earliest time asked for."""

    SCHEMA = StructType([StructField("at", LongType())])

    def __init__(self, handle: StatefulProcessorHandle):
        self.handle, self.kept = handle, handle.getValueState("timer", self.SCHEMA)

    def wake(self, at: int) -> None:
        """at: microseconds; the timer stands on the next millisecond."""
        ms = -(-at // 1000)
        now = self.kept.get()[0] if self.kept.exists() else None
        if now is None or ms < now:
            if now is not None:
                self.handle.deleteTimer(now)
            self.handle.registerTimer(ms)
            self.kept.update((ms,))

    def rang(self) -> None:
        self.kept.clear()


class OrderedFold(StatefulProcessor):
    def __init__(self, fold: Fold, out: list[str]):
        """Schemas are parsed here, on the driver."""
        self.fold, self.row = fold, Row(*out)
        self.schemas = [_parse_datatype_string(x) for x in (f"at bigint, seq bigint, {fold.payload}", "at bigint, tag string, seq bigint, n bigint", fold.state)]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.events, self.agenda = (handle.getListState(n, s) for n, s in zip(("events", "agenda"), self.schemas, strict=False))
        self.state = handle.getValueState("state", self.schemas[2])
        self.timer = _Timer(handle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        names = [x.split()[0] for x in self.fold.payload.split(", ")]
        new = [(r["at"], r["seq"], *[r[n] for n in names]) for r in rows]
        self.events.appendList(new)
        self.timer.wake(min(r[0] for r in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.timer.rang()
        end = timerValues.getCurrentWatermarkInMs() * 1000
        events = [tuple(x) for x in self.events.get()] if self.events.exists() else []
        agenda = [tuple(x) for x in self.agenda.get()] if self.agenda.exists() else []
        state = tuple(self.state.get()) if self.state.exists() else None
        queue = [(e[0], 1, e[1], e) for e in events if e[0] <= end] + [(a[0], 0, a[2], a) for a in agenda if a[0] <= end]
        later = [a for a in agenda if a[0] > end]
        heapq.heapify(queue)
        out = []
        while queue:
            at, is_event, _, x = heapq.heappop(queue)
            state, rows, more = self.fold.event(state, at, x[1], x[2:]) if is_event else self.fold.due(state, *x)
            out += rows
            for a in more:
                heapq.heappush(queue, (a[0], 0, a[2], a)) if a[0] <= end else later.append(a)
        waiting = [e for e in events if e[0] > end]
        for kept, left in ((self.events, waiting), (self.agenda, later)):
            kept.put(left) if left else kept.clear()
        self.state.clear() if state is None else self.state.update(state)
        if waiting or later:
            self.timer.wake(min(x[0] for x in (*waiting, *later)))
        for x in out:
            yield self.row(*key, *x)

    def close(self) -> None:
        pass


def ordered_fold(stream: DataFrame, key: str, ts: str, seq: str, fold: Fold) -> DataFrame:
    """The key and the fold's rows. stream needs a watermark on ts; seq (bigint) orders events of equal time."""
    names = [x.split()[0] for x in fold.payload.split(", ")]
    rows = stream.select(key, ts, F.unix_micros(ts).alias("at"), F.col(seq).alias("seq"), *names)
    out = StructType([rows.schema[key], *_parse_datatype_string(fold.out).fields])
    return rows.groupBy(key).transformWithState(OrderedFold(fold, out.names), out, "Append", "EventTime")


class Throttle(Fold):
    """Adaptive throttle: kind 'slow' halves the factor (at least 0.1) and opens a window of cooldown; 'ok' after the window raises
    the factor by half. Rows: each event with the factor after it, and the end of each window that nothing prolonged."""

    state, payload = "factor double, until bigint", "kind string"
    out = "event_id bigint, at bigint, factor double, what string"

    def __init__(self, cooldown_s: float = 60.0):
        self.cooldown = round(cooldown_s * SECOND)

    def event(self, state, at, seq, payload):
        factor, until = state or (1.0, None)
        more = []
        if payload[0] == "slow":
            factor, until = max(0.1, factor * 0.5), at + self.cooldown
            more = [(until, "open", seq, 0)]
        elif payload[0] == "ok" and factor < 1 and at >= until:
            factor = min(1.0, factor * 1.5)
        return (factor, until) if factor < 1 else None, [(seq, at, factor, "event")], more

    def due(self, state, at, tag, seq, n):
        return state, [(None, at, state[0], "open")] if state and state[1] == at else [], []


class Deadlines(Fold):
    """Jobs with a deadline: 'start' opens a run of the key, 'done', 'failed' or 'cancelled' ends it; a run without an end after
    timeout fails as job_timeout when the watermark passes its deadline. What comes without a run, or a start in one, is ignored."""

    state, payload = "run int, started bigint, open boolean", "kind string"
    out = "run int, started bigint, ended bigint, status string, error string"
    ends = ("done", "failed", "cancelled")

    def __init__(self, timeout_s: float = 3600.0):
        self.timeout = round(timeout_s * SECOND)

    def event(self, state, at, seq, payload):
        run, started, is_open = state or (0, 0, False)
        if payload[0] == "start" and not is_open:
            return (run + 1, at, True), [], [(at + self.timeout, "deadline", seq, run + 1)]
        if payload[0] in self.ends and is_open:
            return (run, started, False), [(run, started, at, payload[0], None)], []
        return state, [], []

    def due(self, state, at, tag, seq, n):
        run, started, is_open = state
        if is_open and run == n:
            return (run, started, False), [(run, started, at, "failed", "job_timeout")], []
        return state, [], []


class Requeue(Fold):
    """Deferred retries: the n-th 'fail' in a row puts its event back into the key's queue for min(cap, base ** n) seconds later;
    beyond max_retries it is given up. 'ok' starts a new row. Rows come in the order in which they are ready."""

    state, payload = "failures int", "kind string"
    out = "event_id bigint, attempt int, ready bigint, what string"

    def __init__(self, max_retries: int = 3, base_s: float = 2.0, cap_s: float = 30.0, unit_s: float = 1.0):
        self.max_retries, self.base, self.cap, self.unit = max_retries, base_s, cap_s, unit_s

    def event(self, state, at, seq, payload):
        failures = state[0] if state else 0
        if payload[0] == "ok":
            return None, [], []
        if payload[0] != "fail":
            return state, [], []
        if failures >= self.max_retries:
            return state, [(seq, failures, at, "given up")], []
        n = failures + 1
        return (n,), [], [(at + round(min(self.cap, self.base**n) * self.unit * SECOND), "retry", seq, n)]

    def due(self, state, at, tag, seq, n):
        return state, [(seq, n, at, "retry")], []


class Sessions(StatefulProcessor):
    """Sessions of a key, merged as events come in any order; late events go to a side row each.

    The stream's watermark lags keep behind the one that counts here. An event older than the latter is late: it changes no session and is
    given out as a row of its own (only beyond keep the engine drops it). A session is given out once, when the watermark
    that counts passes its end by gap."""

    OUT = "what string, event_id bigint, start bigint, end bigint, n bigint, total double"

    def __init__(self, gap: int, keep: int, out: list[str]):
        self.gap, self.keep, self.row = gap, keep, Row(*out)
        self.schema = _parse_datatype_string("start bigint, end bigint, n bigint, total double")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getListState("open", self.schema)
        self.timer = _Timer(handle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        ms = timerValues.getCurrentWatermarkInMs()
        mark = ms * 1000 + self.keep if ms > 0 else 0
        spans = [tuple(x) for x in self.open.get()] if self.open.exists() else []
        for r in rows:
            if r["at"] < mark:
                yield self.row(*key, "late", r["seq"], r["at"], r["at"], 1, r["value"])
            else:
                spans.append((r["at"], r["at"], 1, r["value"] or 0.0))
        merged: list[tuple] = []
        for s in sorted(spans):
            if merged and s[0] <= merged[-1][1] + self.gap:
                a = merged[-1]
                merged[-1] = (a[0], max(a[1], s[1]), a[2] + s[2], a[3] + s[3])
            else:
                merged.append(s)
        if merged:
            self.open.put(merged)
            self.timer.wake(max(1000, min(s[1] for s in merged) + self.gap - self.keep))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.timer.rang()
        mark = timerValues.getCurrentWatermarkInMs() * 1000 + self.keep
        spans = [tuple(x) for x in self.open.get()] if self.open.exists() else []
        left = [s for s in spans if s[1] + self.gap > mark]
        for s in spans:
            if s[1] + self.gap <= mark:
                yield self.row(*key, "session", None, *s)
        if left:
            self.open.put(left)
            self.timer.wake(max(1000, min(s[1] for s in left) + self.gap - self.keep))
        else:
            self.open.clear()

    def close(self) -> None:
        pass


def sessions(events: DataFrame, key: str, ts: str, seq: str, value: str, gap_s: int, delay_s: int, keep_s: int = 0) -> DataFrame:
    """key, what ('session' or 'late'), event_id (of late ones), start, end (microseconds), n, total. Events up to delay behind
    the newest are in time; up to keep more they are late, with a row each."""
    rows = events.withWatermark(ts, f"{delay_s + keep_s} seconds").select(key, ts, F.unix_micros(ts).alias("at"), F.col(seq).alias("seq"), F.col(value).alias("value"))
    out = StructType([rows.schema[key], *_parse_datatype_string(Sessions.OUT).fields])
    return rows.groupBy(key).transformWithState(Sessions(gap_s * SECOND, keep_s * SECOND, out.names), out, "Append", "EventTime")


def sliding_counts(events: DataFrame, width: str, slide: str, late: str) -> DataFrame:
    """Counts and sums by overlapping windows and type; windows close when the watermark passes them."""
    keyed = events.withWatermark("ts", late).groupBy(F.window("ts", width, slide), "event_type")
    out = keyed.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "total")


def joined_within(tasks: DataFrame, results: DataFrame, same: Column, task_ts: str, result_ts: str, timeout: str, late: str, how: str = "leftOuter") -> DataFrame:
    """Tasks with their results of up to timeout later, two streams with a watermark each, so what can't match any more leaves the
    state. A task without result comes once, with nulls, when its time is over (leftOuter), or never (inner)."""
    in_time = (F.col(result_ts) >= F.col(task_ts)) & (F.col(result_ts) <= F.col(task_ts) + F.expr(f"interval {timeout}"))
    return tasks.withWatermark(task_ts, late).join(results.withWatermark(result_ts, late), same & in_time, how)


def first_results(stream: DataFrame, key: str, ts: str, seq: str, timeout_s: float) -> DataFrame:
    """As a caller that waits sees it: each 'task' of a key ends with the first 'result' after it, or as a time-out; results that nobody
    waits for are dropped. One ordered fold over tasks and results in one stream."""
    return ordered_fold(stream, key, ts, seq, Waiting(timeout_s))


class Waiting(Fold):
    """Tasks that wait for a result, at most timeout. A result ends the task that has waited longest."""

    state, payload = "waiting array<bigint>", "kind string"
    out = "task_id bigint, result_id bigint, at bigint"

    def __init__(self, timeout_s: float):
        self.timeout = round(timeout_s * SECOND)

    def event(self, state, at, seq, payload):
        waiting = list(state[0]) if state else []
        if payload[0] == "task":
            return ([*waiting, seq],), [], [(at + self.timeout, "timeout", seq, 0)]
        if payload[0] == "result" and waiting:
            return (waiting[1:],) if waiting[1:] else None, [(waiting[0], seq, at)], []
        return state, [], []

    def due(self, state, at, tag, seq, n):
        waiting = list(state[0]) if state else []
        if seq not in waiting:
            return state, [], []
        waiting.remove(seq)
        return (waiting,) if waiting else None, [(seq, None, at)], []

