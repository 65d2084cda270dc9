"""Crawls over the catalogue site, site maps, prices, and events of crawls."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webloom.checkpointing import stream_folder
from webloom.functions import classify, html
from webloom.functions.html import Field, Rule
from webloom.operators import jobs, sitemap
from webloom.operators.crawl import Cancel, answered, crawl
from webloom.operators.scope import Scope
from webloom.plans.page_queries import STATUS
from webloom.plans.state_queries import HEALTH_SQL
from webloom.session import table
from webloom.sources import site
from webloom.streaming import events as streams

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


R = site.ROOT
LEDGER = f"""l AS (SELECT '{R}' AS url, NULL AS parent_url, 0 AS depth, 0 AS a, 0 AS b UNION ALL SELECT '{R}region/' || r_regionkey, '{R}', 1, r_regionkey, 0 FROM region
    UNION ALL SELECT '{R}nation/' || n_nationkey, '{R}region/' || n_regionkey, 2, n_regionkey, n_nationkey FROM nation
    UNION ALL SELECT '{R}customer/' || c_custkey, '{R}nation/' || c_nationkey, 3, c_nationkey, c_custkey FROM customer)"""


@query("crawl_site_ledger", f"WITH {LEDGER} SELECT url, parent_url, depth, true AS ok FROM l")
def crawl_site_ledger(spark, sf):
    return crawl(site.catalogue(spark, sf), Scope(R, max_depth=3), None).ledger.select("url", "parent_url", "depth", "ok")


@query(
    "crawl_site_stats",
    "SELECT 31 + (SELECT count(*) FROM customer) AS visited, 0 AS failed, 10 + 25 + 2 * (SELECT count(*) FROM customer) AS dedup_skipped, 6 AS out_of_scope",
)
def crawl_site_stats(spark, sf):
    return crawl(site.catalogue(spark, sf), Scope(R, max_depth=3), None).stats().select("visited", "failed", "dedup_skipped", "out_of_scope")


@query(
    "crawl_max_pages",
    f"WITH {LEDGER} SELECT url, depth FROM l WHERE depth < 2 UNION ALL (SELECT url, depth FROM l WHERE depth = 2 ORDER BY a, b LIMIT 14)",
)
def crawl_max_pages(spark, sf):
    return crawl(site.catalogue(spark, sf), Scope(R, max_depth=3), 20).ledger.select("url", "depth")


@query("crawl_subdomains", "SELECT 31 AS visited, 5 AS failed, 10 + 25 AS dedup_skipped, 1 + (SELECT count(*) FROM customer) AS out_of_scope")
def crawl_subdomains(spark, sf):
    return crawl(site.catalogue(spark, sf), Scope(R, "subdomains", max_depth=2), None).stats().select("visited", "failed", "dedup_skipped", "out_of_scope")


@query("crawl_discarded", "SELECT * FROM (VALUES ('max_depth', (SELECT count(*) FROM customer)), ('mode', 6), ('seen', 35)) v(reason, n)")
def crawl_discarded(spark, sf):
    out = crawl(site.catalogue(spark, sf), Scope(R, max_depth=2), None).discarded
    return out.groupBy("reason").agg(F.sum("n").alias("n"))


def _flaky(spark, sf):
    """Customers that answer 503 as often as their key mod 6 says before they answer (mod 6 = 5: always, never again to be tried)."""
    pages = site.catalogue(spark, sf)
    key = F.when(F.contains("url", F.lit("/customer/")), F.substring_index("url", "/", -1).cast("int") % 6).otherwise(0)
    rows = pages.select("url", "html", "status_code", key.alias("k"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("attempt")).where("attempt <= k")
    fails = (F.col("attempt") < F.col("k")) | (F.col("k") == 5)
    return rows.select(
        "url", F.when(~fails, F.col("html")).alias("html"), F.when(fails, 503).otherwise(F.col("status_code")).alias("status_code"),
        F.when(fails, "unavailable").alias("error"), "attempt", (F.col("k") != 5).alias("retryable"),
    )


@query(
    "crawl_retries",
    """SELECT 31 + count(*) FILTER (c_custkey % 6 < 4) AS visited, 0 AS queued, count(*) FILTER (c_custkey % 6 >= 4) AS failed,
    37 + 2 * count(*) FILTER (c_custkey % 6 < 4) - 2 AS dedup_skipped, 6 AS out_of_scope, sum([0, 1, 2, 3, 3, 0][c_custkey % 6 + 1])::BIGINT AS retries_total FROM customer""",
)
def crawl_retries(spark, sf):
    return crawl(_flaky(spark, sf), Scope(R, max_depth=3), None).stats()


@query(
    "crawl_cancel",
    f"""WITH {LEDGER}, o AS (SELECT *, row_number() OVER (ORDER BY depth, a, b) AS n FROM l WHERE depth < 3)
    SELECT kind, url, CASE WHEN kind = 'hard' AND n > 20 THEN 'cancelled' END AS error FROM o, (VALUES ('soft'), ('hard')) k(kind) WHERE n <= 23""",
)
def crawl_cancel(spark, sf):
    out, pages = None, answered(site.catalogue(spark, sf))
    for kind in ("soft", "hard"):
        c = crawl(pages, Scope(R, max_depth=3), None, cancel=Cancel(20, kind == "hard", 3))
        rows = c.ledger.select(F.lit(kind).alias("kind"), "url", "error")
        out = rows if out is None else out.unionByName(rows)
    return out


def _site_pages(spark, sf):
    rows = crawl(site.catalogue(spark, sf), Scope(R, max_depth=2), None).ledger
    return rows.select("url", "parent_url", F.struct("depth", "key").alias("ord"), "depth", "status_code", "error", F.lit(0).alias("took_ms"))


@query(
    "crawl_site_map",
    f"""WITH n AS (SELECT r_regionkey AS r, n_nationkey AS n, lead(n_nationkey) OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) IS NULL AS nl, r_regionkey = (SELECT max(r_regionkey) FROM region) AS rl FROM region JOIN nation ON n_regionkey = r_regionkey)
    SELECT '{R}  [d=0, 200, 0ms]' AS line UNION ALL SELECT DISTINCT '    ' || CASE WHEN rl THEN '└── ' ELSE '├── ' END || '{R}region/' || r || '  [d=1, 200, 0ms]' FROM n
    UNION ALL SELECT '    ' || CASE WHEN rl THEN '    ' ELSE '│   ' END || CASE WHEN nl THEN '└── ' ELSE '├── ' END || '{R}nation/' || n || '  [d=2, 200, 0ms]' FROM n""",
)
def crawl_site_map(spark, sf):
    return sitemap.text_lines(_site_pages(spark, sf)).orderBy("path").select("line")


@query("site_map_roots", f"SELECT '{R}nation/' || n_nationkey AS url FROM nation WHERE n_regionkey <> 0 UNION ALL SELECT '{R}region/0'")
def site_map_roots(spark, sf):
    pages = table(spark, sf, "nation").select(F.concat(F.lit(R + "nation/"), F.col("n_nationkey")).alias("url"), F.concat(F.lit(R + "region/"), F.col("n_regionkey")).alias("parent_url"))
    top = table(spark, sf, "region").where("r_regionkey = 0").select(F.concat(F.lit(R + "region/"), F.col("r_regionkey")).alias("url"), F.lit(None).cast("string").alias("parent_url"))
    return sitemap.roots(pages.unionByName(top)).select("url")


@query("site_map_children", f"SELECT '{R}region/' || n_regionkey AS parent_url, string_agg(n_nationkey::VARCHAR, ',' ORDER BY n_nationkey) AS children FROM nation GROUP BY 1")
def site_map_children(spark, sf):
    pages = table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("url"), F.concat(F.lit(R + "region/"), F.col("n_regionkey")).alias("parent_url"), F.col("n_nationkey").alias("ord"))
    return sitemap.children(pages).select("parent_url", F.array_join("children", ",").alias("children"))


def _prices(spark, sf):
    rule = Rule((("name", Field("h1.name")), ("price", Field(".name + p.price"))))
    x = site.catalogue(spark, sf).where(F.contains("url", F.lit("/customer/"))).select("url", html.extract(F.col("html"), rule).alias("x"))
    return x.select("url", "x.name", F.replace("x.price", F.lit("£")).cast("double").alias("price"))


PRICES = f"SELECT '{R}customer/' || c_custkey AS url, c_name AS name, c_nationkey, round(abs(c_acctbal), 2) AS price FROM customer"


@query("price_top10", f"SELECT url, name, price FROM ({PRICES}) ORDER BY price, url LIMIT 10")
def price_top10(spark, sf):
    return _prices(spark, sf).orderBy("price", "url").limit(10)


@query("price_top3_per_group", "SELECT c_mktsegment, c_custkey, n FROM (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS n FROM customer) WHERE n <= 3")
def price_top3_per_group(spark, sf):
    w = Window.partitionBy("c_mktsegment").orderBy("c_custkey")
    return table(spark, sf, "customer").select("c_mktsegment", "c_custkey", F.row_number().over(w).alias("n")).where("n <= 3")


@query("global_position", "SELECT l_orderkey, l_linenumber, l_orderkey % 5 * 10 + l_linenumber AS position FROM lineitem")
def global_position(spark, sf):
    groups = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("items"))
    rows = groups.select("l_orderkey", F.explode("items").alias("l_linenumber"))
    return rows.select("l_orderkey", "l_linenumber", (F.col("l_orderkey") % 5 * 10 + F.col("l_linenumber")).alias("position"))


JOBS = "jobs AS (SELECT o_orderkey AS job, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'running' ELSE 'queued' END AS status, (o_orderkey % 23)::BIGINT AS total, least(o_orderkey % 23, o_custkey % 17)::BIGINT AS done FROM orders)"


def _jobs(spark, sf):
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "running").otherwise("queued")
    total = F.col("o_orderkey") % 23
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("job"), status.alias("status"), total.alias("total"), F.least(total, F.col("o_custkey") % 17).alias("done"))


@query(
    "job_progress",
    f"""WITH {JOBS}, p AS (SELECT *, greatest(total - done, 0) AS rest FROM jobs), q AS (SELECT *, CASE WHEN status = 'running' THEN least(4, rest) ELSE 0 END AS running FROM p)
    SELECT job, status, total, done, CASE WHEN total > 0 THEN floor(100 * done / total + 0.5) ELSE 0 END::BIGINT AS pct, running::BIGINT AS running, (rest - running)::BIGINT AS queued FROM q""",
)
def job_progress(spark, sf):
    return jobs.progress(_jobs(spark, sf), 4)


@query("job_health", f"WITH {JOBS} SELECT count(*) FILTER (status = 'running') AS jobs_active, count(*) AS jobs_total FROM jobs")
def job_health(spark, sf):
    return jobs.health(_jobs(spark, sf))


@query("job_terminal", f"WITH {JOBS} SELECT job, status IN ('done', 'failed', 'cancelled') AS terminal, CASE WHEN job % 9 = 0 THEN 'cancelled' ELSE 'done' END AS final FROM jobs")
def job_terminal(spark, sf):
    return _jobs(spark, sf).select("job", classify.is_terminal(F.col("status")).alias("terminal"), classify.final_status(F.col("status"), F.col("job") % 9 == 0).alias("final"))


@query("batch_summary", f"SELECT event_type, count(*) FILTER (coalesce({STATUS}, 500) BETWEEN 200 AND 399) AS successes, count(*) AS total FROM events GROUP BY 1")
def batch_summary(spark, sf):
    ok = classify.status_ok(F.expr(f"coalesce({STATUS}, 500)"))
    return table(spark, sf, "events").groupBy("event_type").agg(F.count_if(ok).alias("successes"), F.count(F.lit(1)).alias("total"))


@query("batch_results_in_order", "SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey) AS results FROM lineitem GROUP BY 1")
def batch_results_in_order(spark, sf):
    out = jobs.in_input_order(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey", "l_linenumber", "l_partkey")
    return out.select("l_orderkey", F.array_join("results", ",").alias("results"))


@query(
    "recent_jobs",
    "SELECT user_id, max_by(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id ORDER BY min((ts, event_id)) DESC LIMIT 20",
)
def recent_jobs(spark, sf):
    return jobs.recent(table(spark, sf, "events"), "user_id", ["ts", "event_id"], "event_type").select("user_id", "event_type")


@query(
    "stats_change_log",
    "SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER w AS p, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE n = 1 OR event_type IS DISTINCT FROM p",
)
def stats_change_log(spark, sf):
    return jobs.changes(table(spark, sf, "events").select("user_id", "event_id", "event_type", "ts"), "user_id", ["ts", "event_id"], F.col("event_type")).select("user_id", "event_id", "event_type")


@query("event_sse_format", """SELECT event_id, 'event: ' || event_type || chr(10) || 'data: {"id":' || event_id || ',"user":' || user_id || '}' || chr(10) || chr(10) AS message FROM events""")
def event_sse_format(spark, sf):
    payload = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("user_id").alias("user")))
    return table(spark, sf, "events").select("event_id", jobs.sse(F.col("event_type"), payload).alias("message"))


@query(
    "event_replay_union",
    """WITH e AS (SELECT user_id AS job, event_id AS ord, event_type AS type, props AS payload FROM events)
    SELECT job, 0 AS part, max(ord) AS ord, 'stats' AS type, count(*)::VARCHAR AS payload FROM e GROUP BY job
    UNION ALL SELECT job, 1, ord, type, payload FROM e WHERE type IN ('view', 'click')
    UNION ALL SELECT job, 2, max(ord), 'done', max_by(type, ord) FROM e GROUP BY job""",
)
def event_replay_union(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("job"), F.col("event_id").alias("ord"), F.col("event_type").alias("type"), F.col("props").alias("payload"))
    by_job = e.groupBy("job").agg(F.max("ord").alias("ord"), F.count(F.lit(1)).cast("string").alias("n"), F.max_by("type", "ord").alias("last"))
    stats = by_job.select("job", "ord", F.lit("stats").alias("type"), F.col("n").alias("payload"))
    final = by_job.select("job", "ord", F.lit("done").alias("type"), F.col("last").alias("payload"))
    return jobs.replay(stats, e.where("type IN ('view', 'click')"), final)


@query("event_last_by_url", "SELECT user_id, max_by(event_type, (ts, event_id)) AS event_type, max_by(value, (ts, event_id)) AS value FROM events GROUP BY user_id")
def event_last_by_url(spark, sf):
    return jobs.latest(table(spark, sf, "events"), "user_id", ["ts", "event_id"], ["event_type", "value"])


@query("cancelled_pages", "SELECT status, count(*) AS n FROM (SELECT CASE WHEN value > 50 THEN 'cancelled' ELSE 'done' END AS status FROM events) GROUP BY 1")
def cancelled_pages(spark, sf):
    rows = table(spark, sf, "events").select(F.col("value").alias("finished_ts"))
    return jobs.cancelled_pages(rows, F.lit(50)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("stream_event_counts", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_event_counts(spark, sf):
    stream = streams.windowed_counts(streams.read_events(spark, f"{sf}/events.parquet"))
    return streams.run_once(stream, "stream_event_counts", "complete", stream_folder(spark, "stream"))


@query("stream_session_health", HEALTH_SQL)
def stream_session_health(spark, sf):
    requests = streams.read_events(spark, f"{sf}/events.parquet").select((F.col("user_id") % 64).alias("pool"), "event_id", F.expr(f"coalesce({STATUS}, 500)").alias("status"))
    return streams.run_once(streams.session_health(requests), "stream_session_health", "append", stream_folder(spark, "stream"))


