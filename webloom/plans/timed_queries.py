"""Queries with event time: joins of streams, timers, ordered keyed state, sessions, and what goes with them."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webloom.checkpointing import stream_folder
from webloom.functions import variant
from webloom.operators import jobs, ordered, scan, sketches
from webloom.plans.page_queries import STATUS
from webloom.plans.state_queries import HEALTH_SQL, KIND
from webloom.session import table
from webloom.sources import pagestore
from webloom.streaming import events as streams
from webloom.streaming import timed

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


DELAY = 3600
US = 1_000_000


def _timed(spark, stream, name):
    with timed.timed_state(spark):
        return streams.run_once(stream, name, "append", stream_folder(spark, "stream"))


def _of_types(spark, sf, kinds: dict[str, str]):
    """The events of some types as a stream, each with its kind; the watermark is theirs."""
    e = streams.read_events(spark, f"{sf}/events.parquet").where(F.col("event_type").isin(*kinds))
    kind = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])[F.col("event_type")]
    return e.withColumn("kind", kind).withWatermark("ts", f"{DELAY} seconds")


def _sql_of_types(kinds: dict[str, str]) -> str:
    """e0: events of these types; mark: where the watermark ends up; e: what it has passed, numbered per user."""
    cases = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in kinds.items())
    return f"""e0 AS (SELECT user_id, event_id, epoch_us(ts) AS "at", CASE event_type {cases} END AS kind FROM events WHERE event_type IN ({", ".join(f"'{k}'" for k in kinds)})),
    mark AS (SELECT max("at") // 1000 * 1000 - {DELAY * US} AS wm FROM e0),
    e AS (SELECT e0.*, row_number() OVER (PARTITION BY user_id ORDER BY "at", event_id) AS n FROM e0, mark WHERE "at" <= wm)"""


@query(
    "stream_task_results",
    """WITH t AS (SELECT event_id AS task_id, user_id, ts FROM events WHERE event_type = 'click'), r AS (SELECT event_id AS result_id, user_id, ts FROM events WHERE event_type = 'purchase'),
    m AS (SELECT t.task_id, r.result_id, t.ts FROM t LEFT JOIN r ON r.user_id = t.user_id AND r.ts BETWEEN t.ts AND t.ts + INTERVAL 6 HOUR)
    SELECT task_id, result_id FROM m WHERE result_id IS NOT NULL OR ts + INTERVAL 6 HOUR < least((SELECT max(ts) FROM t), (SELECT max(ts) FROM r)) - INTERVAL 1 HOUR""",
)
def stream_task_results(spark, sf):
    """Tasks (clicks) with all their results (purchases of the user within six hours), from two streams."""
    e = streams.read_events(spark, f"{sf}/events.parquet")
    tasks = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("task_id"), F.col("ts").alias("asked"))
    results = e.where("event_type = 'purchase'").select(F.col("user_id").alias("by"), F.col("event_id").alias("result_id"), F.col("ts").alias("answered"))
    out = timed.joined_within(tasks, results, F.col("user_id") == F.col("by"), "asked", "answered", "6 hours", "1 hour")
    return streams.run_once(out.select("task_id", "result_id"), "stream_task_results", "append", stream_folder(spark, "stream"))


TASKS = {"click": "task", "purchase": "result"}


@query(
    "stream_first_results",
    f"""WITH RECURSIVE {_sql_of_types(TASKS)},
    r AS (SELECT user_id, 0::BIGINT AS n, []::STRUCT(id BIGINT, "at" BIGINT)[] AS w, []::STRUCT(t BIGINT, r BIGINT, "at" BIGINT)[] AS outs FROM (SELECT DISTINCT user_id FROM e)
      UNION ALL SELECT user_id, n, CASE WHEN kind = 'task' THEN list_append(live, {{'id': event_id, 'at': "at"}}) ELSE live[2:] END,
        list_concat(list_transform(gone, lambda x: {{'t': x.id, 'r': NULL::BIGINT, 'at': x."at" + {6 * DELAY * US}}}),
          CASE WHEN kind = 'result' AND len(live) > 0 THEN [{{'t': live[1].id, 'r': event_id, 'at': "at"}}] ELSE [] END)
      FROM (SELECT e.user_id, e.n, e.event_id, e."at", e.kind, list_filter(r.w, lambda x: x."at" + {6 * DELAY * US} > e."at") AS live, list_filter(r.w, lambda x: x."at" + {6 * DELAY * US} <= e."at") AS gone
        FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)),
    last AS (SELECT user_id, max_by(w, n) AS w FROM r GROUP BY user_id),
    o AS (SELECT user_id, unnest(outs) AS o FROM r UNION ALL SELECT user_id, {{'t': x.id, 'r': NULL::BIGINT, 'at': x."at" + {6 * DELAY * US}}} FROM (SELECT user_id, unnest(w) AS x FROM last), mark WHERE x."at" + {6 * DELAY * US} <= wm)
    SELECT user_id, o.t AS task_id, o.r AS result_id, o."at" AS "at" FROM o""",
)
def stream_first_results(spark, sf):
    """Each task with the one result that ends its wait, or the time at which the wait ended without one."""
    return _timed(spark, timed.first_results(_of_types(spark, sf, TASKS), "user_id", "ts", "event_id", 6 * DELAY), "stream_first_results")


JOBS = {"signup": "start", "purchase": "done", "error": "failed"}
LIMIT = 12 * DELAY * US


@query(
    "stream_deadlines",
    f"""WITH RECURSIVE {_sql_of_types(JOBS)},
    r AS (SELECT user_id, 0::BIGINT AS n, 0 AS run, NULL::BIGINT AS started, 0 AS o_run, NULL::BIGINT AS o_started, NULL::BIGINT AS ended, NULL::VARCHAR AS status, NULL::VARCHAR AS error FROM (SELECT DISTINCT user_id FROM e)
      UNION ALL SELECT user_id, n, run + (kind = 'start' AND live IS NULL)::INTEGER, CASE WHEN kind = 'start' THEN coalesce(live, "at") END, run, started,
        CASE WHEN started IS NOT NULL AND live IS NULL THEN started + {LIMIT} WHEN live IS NOT NULL AND kind <> 'start' THEN "at" END,
        CASE WHEN started IS NOT NULL AND live IS NULL THEN 'failed' WHEN live IS NOT NULL AND kind <> 'start' THEN kind END,
        CASE WHEN started IS NOT NULL AND live IS NULL THEN 'job_timeout' END
      FROM (SELECT e.user_id, e.n, e."at", e.kind, r.run, r.started, CASE WHEN r.started + {LIMIT} > e."at" THEN r.started END AS live FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)),
    last AS (SELECT user_id, max_by(run, n) AS run, arg_max_null(started, n) AS started FROM r GROUP BY user_id)
    SELECT user_id, o_run AS run, o_started AS started, ended, status, error FROM r WHERE status IS NOT NULL
    UNION ALL SELECT user_id, run, started, started + {LIMIT}, 'failed', 'job_timeout' FROM last, mark WHERE started + {LIMIT} <= wm""",
)
def stream_deadlines(spark, sf):
    """Jobs (from a signup to the user's next purchase or error) that end in twelve hours or fail as job_timeout."""
    return _timed(spark, timed.ordered_fold(_of_types(spark, sf, JOBS), "user_id", "ts", "event_id", timed.Deadlines(12 * DELAY)), "stream_deadlines")


COOLDOWN = 60_000 * US


@query(
    "stream_throttle_ordered",
    f"""WITH RECURSIVE e0 AS (SELECT user_id % 64 AS pool, event_id, epoch_us(ts) AS "at", coalesce({STATUS}, 500) AS status FROM events),
    mark AS (SELECT max("at") // 1000 * 1000 - {DELAY * US} AS wm FROM e0),
    e AS (SELECT pool, event_id, "at", {KIND} AS kind, row_number() OVER (PARTITION BY pool ORDER BY "at", event_id) AS n FROM e0, mark WHERE "at" <= wm),
    r AS (SELECT pool, 0::BIGINT AS n, NULL::BIGINT AS event_id, NULL::BIGINT AS "at", NULL::VARCHAR AS kind, 1.0::DOUBLE AS factor, 0::BIGINT AS until FROM (SELECT DISTINCT pool FROM e)
      UNION ALL SELECT e.pool, e.n, e.event_id, e."at", e.kind,
        CASE WHEN e.kind = 'slow' THEN greatest(0.1::DOUBLE, factor * 0.5::DOUBLE) WHEN e.kind = 'ok' AND e."at" >= until AND factor < 1 THEN least(1.0::DOUBLE, factor * 1.5::DOUBLE) ELSE factor END,
        CASE WHEN e.kind = 'slow' THEN e."at" + {COOLDOWN} ELSE until END FROM r JOIN e ON e.pool = r.pool AND e.n = r.n + 1),
    slow AS (SELECT *, lead("at") OVER (PARTITION BY pool ORDER BY n) AS next FROM r WHERE kind = 'slow')
    SELECT pool, event_id, "at", round(factor, 6) AS factor, 'event' AS what FROM r WHERE n > 0
    UNION ALL SELECT pool, NULL, until, round(factor, 6), 'open' FROM slow, mark WHERE (next IS NULL OR next >= until) AND until <= wm""",
)
def stream_throttle_ordered(spark, sf):
    """The throttle with events held back to the watermark and a timer for the end of each window."""
    e = streams.read_events(spark, f"{sf}/events.parquet").select((F.col("user_id") % 64).alias("pool"), "event_id", "ts", F.expr(f"coalesce({STATUS}, 500)").alias("status"))
    log = e.withColumn("kind", F.expr(KIND)).withWatermark("ts", f"{DELAY} seconds")
    out = _timed(spark, timed.ordered_fold(log, "pool", "ts", "event_id", timed.Throttle(60000.0)), "stream_throttle_ordered")
    return out.withColumn("factor", F.round("factor", 6))


TRIES = {"error": "fail", "purchase": "ok"}


@query(
    "stream_requeue",
    f"""WITH {_sql_of_types(TRIES)}, g AS (SELECT *, count(*) FILTER (kind = 'ok') OVER (PARTITION BY user_id ORDER BY n) AS g FROM e),
    f AS (SELECT *, row_number() OVER (PARTITION BY user_id, g ORDER BY n) AS k FROM g WHERE kind = 'fail'),
    q AS (SELECT user_id, event_id, least(k, 3)::INTEGER AS attempt, "at" + CASE WHEN k <= 3 THEN least(30, 2 ** k)::BIGINT * {DELAY * US} ELSE 0 END AS ready, CASE WHEN k <= 3 THEN 'retry' ELSE 'given up' END AS what FROM f)
    SELECT user_id, event_id, attempt, ready, what FROM q, mark WHERE ready <= wm""",
)
def stream_requeue(spark, sf):
    """Failed requests that go back into the queue of their key, ready after a backoff in hours."""
    return _timed(spark, timed.ordered_fold(_of_types(spark, sf, TRIES), "user_id", "ts", "event_id", timed.Requeue(unit_s=DELAY)), "stream_requeue")


@query(
    "stream_sessions",
    f"""WITH e AS (SELECT user_id, epoch_us(ts) AS "at", value FROM events), b AS (SELECT *, coalesce("at" - lag("at") OVER (PARTITION BY user_id ORDER BY "at") > {2 * DELAY * US}, true)::INTEGER AS first FROM e),
    s AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY "at") AS s FROM b), x AS (SELECT user_id, min("at") AS start, max("at") AS "end", count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, s)
    SELECT user_id, 'session' AS what, start, "end", n, total FROM x WHERE "end" + {2 * DELAY * US} <= (SELECT max("at") // 1000 * 1000 - {DELAY * US} FROM e)""",
)
def stream_sessions(spark, sf):
    """Sessions of users with a gap of two hours; nothing is late in one file."""
    out = timed.sessions(streams.read_events(spark, f"{sf}/events.parquet"), "user_id", "ts", "event_id", "value", 2 * DELAY, DELAY, 24 * DELAY)
    return _timed(spark, out, "stream_sessions").select("user_id", "what", "start", "end", "n", F.round("total", 4).alias("total"))


@query(
    "stream_sliding_counts",
    """WITH e AS (SELECT event_type, value, unnest([0, 12]) AS back, date_trunc('day', ts) + INTERVAL 12 HOUR * (hour(ts) // 12) AS slot FROM events)
    SELECT strftime(slot - INTERVAL 1 HOUR * back, '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM e GROUP BY ALL""",
)
def stream_sliding_counts(spark, sf):
    stream = timed.sliding_counts(streams.read_events(spark, f"{sf}/events.parquet"), "1 day", "12 hours", "1 day")
    return streams.run_once(stream, "stream_sliding_counts", "complete", stream_folder(spark, "stream"))


@query(
    "rate_limit_slots_adaptive",
    f"""WITH RECURSIVE e0 AS (SELECT user_id % 64 AS pool, event_id, epoch_us(ts) AS "at", epoch_us(ts) / 1e6 AS t, coalesce({STATUS}, 500) AS status FROM events),
    e AS (SELECT pool, event_id, "at", t, {KIND} AS kind, row_number() OVER (PARTITION BY pool ORDER BY t, event_id) AS n FROM e0),
    r AS (SELECT pool, 0::BIGINT AS n, NULL::BIGINT AS event_id, NULL::BIGINT AS "at", NULL::DOUBLE AS t, 1.0::DOUBLE AS factor, -1e18::DOUBLE AS until FROM (SELECT DISTINCT pool FROM e)
      UNION ALL SELECT e.pool, e.n, e.event_id, e."at", e.t,
        CASE WHEN kind = 'slow' THEN greatest(0.1::DOUBLE, factor * 0.5::DOUBLE) WHEN kind = 'ok' AND e.t >= until AND factor < 1 THEN least(1.0::DOUBLE, factor * 1.5::DOUBLE) ELSE factor END,
        CASE WHEN kind = 'slow' THEN e.t + 60000.0::DOUBLE ELSE until END FROM r JOIN e ON e.pool = r.pool AND e.n = r.n + 1),
    b AS (SELECT pool, n, event_id, "at", t, lag(factor) OVER w AS factor, lag(until) OVER w AS until FROM r WINDOW w AS (PARTITION BY pool ORDER BY n)),
    d AS (SELECT *, round(1000000.0::DOUBLE / greatest(0.01::DOUBLE, 0.02::DOUBLE * CASE WHEN t < until THEN factor ELSE 1.0::DOUBLE END) * (0.8::DOUBLE + (event_id * 7919 % 1000 / 1000.0::DOUBLE) * 0.4::DOUBLE))::BIGINT AS d FROM b WHERE n > 0),
    c AS (SELECT *, sum(d) OVER (PARTITION BY pool ORDER BY n) - d AS before FROM d)
    SELECT pool, event_id, d AS gap, (max("at" - before) OVER (PARTITION BY pool ORDER BY n) + before)::BIGINT AS slot FROM c""",
)
def rate_limit_slots_adaptive(spark, sf):
    """Grants at a rate that the throttle lowers while its window is open, with jitter; a pool's log is split over blocks."""
    e = table(spark, sf, "events").select((F.col("user_id") % 64).alias("pool"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.expr(f"coalesce({STATUS}, 500)").alias("status"))
    e = e.withColumn("t", F.col("at") / 1e6).withColumn("kind", F.expr(KIND))
    state = ordered.throttle(e.select("pool", "t", "event_id", "at", "kind"), "pool", ["t", "event_id", "at"], "t", "kind", 60000.0)
    before = Window.partitionBy("pool").orderBy("t", "event_id")
    rows = state.select("pool", "event_id", "at", "t", F.lag("factor").over(before).alias("factor"), F.lag("until").over(before).alias("until"))
    jitter = F.col("event_id") * 7919 % 1000 / F.lit(1000.0)
    rows = rows.withColumn("gap", scan.effective_interval(0.02, F.col("factor"), F.col("until"), F.col("t"), jitter))
    return scan.slots(rows.select("pool", "event_id", "at", "gap"), "pool", ["at", "event_id"], "at", "gap").select("pool", "event_id", "gap", "slot")


@query("session_health_blocks", HEALTH_SQL)
def session_health_blocks(spark, sf):
    """Session health with each pool's log split over blocks."""
    e = table(spark, sf, "events").select((F.col("user_id") % 64).alias("pool"), "event_id", F.expr(f"coalesce({STATUS}, 500)").alias("status"))
    return scan.session_health(e, "pool", ["event_id"], "status").drop("status")


@query(
    "distinct_sketches",
    "SELECT event_type, count(DISTINCT user_id * 1000 + (props::JSON ->> '$.k')::BIGINT) AS n, true AS close FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-25' GROUP BY 1",
)
def distinct_sketches(spark, sf):
    """Distinct (user, k) by type over twenty days, from one sketch a type and day; close: the estimate is within 5 % of the exact count."""
    pair = F.col("user_id") * 1000 + F.get_json_object("props", "$.k").cast("bigint")
    e = table(spark, sf, "events").select("event_type", F.to_date("ts").alias("day"), pair.alias("pair"))
    kept = sketches.distinct_sketches(e, ["event_type", "day"], F.col("pair"))
    span = "day >= DATE '2024-01-05' AND day < DATE '2024-01-25'"
    exact = e.where(span).groupBy("event_type").agg(F.count_distinct("pair").alias("n"))
    both = exact.join(sketches.united(kept.where(span), ["event_type"]), "event_type")
    return both.select("event_type", "n", (F.abs(F.col("estimate") - F.col("n")) <= 0.05 * F.col("n")).alias("close"))


@query(
    "variant_paths",
    """SELECT event_id, (props::JSON ->> '$.k')::INTEGER AS k, user_id AS user, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS second, NULL::VARCHAR AS missing, NULL::INTEGER AS wrong FROM events WHERE event_id % 11 <> 0
    UNION ALL SELECT event_id, (props::JSON ->> '$.k')::INTEGER, NULL, NULL, NULL, NULL FROM events WHERE event_id % 11 = 0""",
)
def variant_paths(spark, sf):
    """A nested body parsed once and read by many typed paths; every eleventh is broken."""
    second = F.when(F.col("event_id") % 7 == 0, F.lit("null")).otherwise(F.concat(F.lit('"'), "event_type", F.lit('"')))
    body = F.concat(F.lit('{"user": {"id": '), F.col("user_id").cast("string"), F.lit('}, "tags": ["x", {"name": '), second, F.lit("}]"), F.when(F.col("event_id") % 11 == 0, "").otherwise("}"))
    rows = table(spark, sf, "events").select("event_id", "props", body.alias("body"))
    rows = variant.with_paths(rows, "props", {"k": ("k", "int")})
    rows = variant.with_paths(rows, "body", {"user": ("user.id", "bigint"), "second": ("tags.1.name", "string"), "missing": ("user.name.first", "string"), "wrong": ("tags.0", "int")})
    return rows.select("event_id", "k", "user", "second", "missing", "wrong")


@query("page_store_scan", r"SELECT url, length(html) AS size FROM pages WHERE lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)) BETWEEN 'm' AND 'www.m'")
def page_store_scan(spark, sf):
    """Pages of a range of hosts from a store of 16 files; the range is pushed into the source."""
    path = stream_folder(spark, "pagestore")
    pagestore.write_store(table(spark, sf, "pages").select("url", "html"), path, 16)
    rows = pagestore.read_store(spark, path).where("host >= 'm' AND host <= 'www.m'")
    return rows.select("url", F.length("html").alias("size"))


@query("stream_event_text", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def stream_event_text(spark, sf):
    """Events written as text by a streaming sink that writes each batch once, then read back."""
    folder = stream_folder(spark, "stream")
    payload = F.to_json(F.struct(F.col("user_id").alias("user")))
    text = streams.read_events(spark, f"{sf}/events.parquet").select(jobs.sse(F.col("event_type"), payload).alias("text"))
    pagestore.write_text(text, f"{folder}/text", f"{folder}/state").awaitTermination()
    rows = spark.read.option("lineSep", "\n\n").text(f"{folder}/text").select(F.regexp_extract("value", "^event: (.*)", 1).alias("event_type"), F.regexp_extract("value", "user\":([0-9]+)", 1).alias("user"))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user").alias("users"))
