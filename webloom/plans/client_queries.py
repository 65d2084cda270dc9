"""Queries of what clients send and get: sinks read back, presets, ids, placeholders, short answers, late subscribers."""

from __future__ import annotations

from pyspark.sql import functions as F

from webloom.checkpointing import stream_folder
from webloom.functions import classify, html, urls
from webloom.operators import jobs
from webloom.operators.scope import Scope, allows
from webloom.operators.scrape import first_result
from webloom.session import table
from webloom.sources import inventory, sinks
from webloom.streaming import events as streams

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


@query("sink_json", "SELECT c_custkey, c_name, CASE WHEN c_nationkey % 2 = 0 THEN c_mktsegment END AS segment FROM customer")
def sink_json(spark, sf):
    """Results written as JSON lines, nulls left out, and read back."""
    path = stream_folder(spark, "json")
    rows = table(spark, sf, "customer").select("c_custkey", "c_name", F.when(F.col("c_nationkey") % 2 == 0, F.col("c_mktsegment")).alias("segment"))
    sinks.write_json(rows, path)
    return spark.read.schema("c_custkey bigint, c_name string, segment string").json(path)


@query("sink_csv", """SELECT url, CASE WHEN page_id % 3 > 0 THEN (200 + page_id % 3)::VARCHAR END AS status_code, NULL::VARCHAR AS success, 'a "title", ' || page_id AS title, NULL::VARCHAR AS error FROM pages""")
def sink_csv(spark, sf):
    """Results as CSV with the fixed header, whatever columns they have."""
    path = stream_folder(spark, "csv")
    rows = table(spark, sf, "pages").select("url", F.when(F.col("page_id") % 3 > 0, 200 + F.col("page_id") % 3).alias("status_code"), F.concat(F.lit('a "title", '), "page_id").alias("title"))
    sinks.write_csv(rows, path)
    return spark.read.option("header", True).option("escape", "\\").csv(path)


@query("sink_html", "SELECT sum(length(html) - length(replace(html, chr(10), '')) + 1)::BIGINT AS n_lines, sum(length(replace(html, chr(10), '')))::BIGINT AS n_chars FROM pages")
def sink_html(spark, sf):
    """Pages written as text, read back by lines."""
    path = stream_folder(spark, "html")
    sinks.write_html(table(spark, sf, "pages"), path)
    return spark.read.option("lineSep", "\n").text(path).agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.char_length("value")).alias("n_chars"))


@query("decoded_images", "SELECT page_id, octet_length(encode(html)) AS size, sha256(html) AS digest FROM pages")
def decoded_images(spark, sf):
    """Base64 bodies, as screenshots come, decoded to bytes."""
    rows = table(spark, sf, "pages").select("page_id", F.base64(F.col("html").cast("binary")).alias("screenshot_base64"))
    return sinks.decoded_images(rows).select("page_id", F.octet_length("image").cast("bigint").alias("size"), F.sha2("image", 256).alias("digest"))


@query(
    "device_requests",
    """SELECT d AS device, w AS width, h AS height, touch, count(event_id) AS n FROM (VALUES ('desktop', 1280, 800, false), ('mobile', 390, 844, true)) p(d, w, h, touch)
    LEFT JOIN events ON CASE WHEN user_id % 3 = 0 THEN 'mobile' ELSE 'desktop' END = d GROUP BY ALL""",
)
def device_requests(spark, sf):
    """Requests by the preset of their device."""
    kind = F.when(F.col("user_id") % 3 == 0, "mobile").otherwise("desktop")
    counts = table(spark, sf, "events").groupBy(kind.alias("device")).agg(F.count(F.lit(1)).alias("n"))
    return inventory.devices(spark).join(counts, "device", "left").select("device", "width", "height", "touch", F.coalesce("n", F.lit(0)).alias("n"))


@query("resource_servers", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'socks5' ELSE 'http' END || '://h' || s_suppkey || '.example.com:' || (1000 + s_suppkey % 50) AS server FROM supplier")
def resource_servers(spark, sf):
    k = F.col("s_suppkey")
    url = F.concat(F.when(k % 2 == 0, "socks5_http").otherwise("http"), F.lit("://user:p@H"), k, F.lit(".Example.com:"), 1000 + k % 50, F.lit("/x"))
    return table(spark, sf, "supplier").select("s_suppkey", urls.server_of(url).alias("server"))


@query("scope_allows", r"SELECT page_id, page_id % 6 <= 3 AND NOT regexp_matches(url, '[?&]page=2') AS allowed FROM pages")
def scope_allows(spark, sf):
    """Which pages a crawl of all hosts may visit, by depth and an excluded pattern."""
    scope = Scope("https://example.com/", "all", exclude=(r"[?&]page=2",), max_depth=3)
    return table(spark, sf, "pages").select("page_id", allows(scope, F.col("url"), F.col("page_id") % 6).alias("allowed"))


@query("sentinel_rows", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN event_type || ',last' WHEN event_id % 4 = 1 THEN 'x,SHOP ON' WHEN event_id % 4 = 2 THEN '' ELSE event_type END AS items FROM events")
def sentinel_rows(spark, sf):
    """A list's first row goes if it is the advert that stands there."""
    k, kind = F.col("event_id") % 4, F.col("event_type")
    items = F.when(k == 0, F.array(F.lit("SHOP ON X"), kind, F.lit("last"))).when(k == 1, F.array(F.lit("x"), F.lit("SHOP ON"))).when(k == 2, F.array(F.lit("SHOP ON"))).otherwise(F.array(kind))
    return table(spark, sf, "events").select("event_id", F.array_join(classify.drop_sentinel(items, "SHOP ON"), ",").alias("items"))


@query("first_of_each_list", "SELECT item_id, array_to_string(string_split(text, ' ')[1:5], ' ') AS words FROM benchmark")
def first_of_each_list(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.array_join(classify.first_n(F.split("text", " "), 5), " ").alias("words"))


@query("appended_result_pages", "SELECT 0 AS result_page, r_name AS name, NULL::INTEGER AS region FROM region UNION ALL SELECT 1, n_name, n_regionkey FROM nation")
def appended_result_pages(spark, sf):
    """Result pages with different columns as one table."""
    first = table(spark, sf, "region").select(F.col("r_name").alias("name"))
    return jobs.appended([first, table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))]).select("result_page", "name", "region")


@query("message_truncation", "SELECT doc_id, length(left(text, 200)) AS n, sha256(left(text, 200)) AS digest FROM documents")
def message_truncation(spark, sf):
    short = classify.truncated(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.char_length(short).cast("bigint").alias("n"), F.sha2(short.cast("binary"), 256).alias("digest"))


@query("request_timing", "SELECT event_id, user_id * 125 AS took_ms, 'req_' || left(sha1(event_id::VARCHAR), 24) AS request_id FROM events")
def request_timing(spark, sf):
    """Elapsed milliseconds and the short id of each request."""
    start = F.col("event_id") / F.lit(4.0)
    took = classify.elapsed_ms(start, start + F.col("user_id") / F.lit(8.0))
    return table(spark, sf, "events").select("event_id", took.alias("took_ms"), classify.short_id("req", F.col("event_id").cast("string")).alias("request_id"))


@query("compact_headers", "SELECT event_id, CASE WHEN event_id % 2 = 0 AND event_id % 3 = 0 THEN NULL WHEN event_id % 2 = 0 THEN 'b=' || event_type WHEN event_id % 3 = 0 THEN 'a=1' ELSE 'a=1;b=' || event_type END AS headers FROM events")
def compact_headers(spark, sf):
    """Headers without their null entries; none at all is null."""
    m = F.create_map(F.lit("a"), F.when(F.col("event_id") % 2 > 0, "1"), F.lit("b"), F.when(F.col("event_id") % 3 > 0, F.col("event_type")))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries(classify.without_nulls(m))), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return table(spark, sf, "events").select("event_id", shown.alias("headers"))


@query(
    "missing_results",
    "SELECT n_nationkey AS idx, n_name AS url, CASE WHEN n_regionkey = 0 THEN 'no result' ELSE 'kept' END AS note, CASE WHEN n_regionkey = 0 THEN 0 ELSE 7 END AS took_ms FROM nation",
)
def missing_results(spark, sf):
    """Requests without a result get the row that stands for it."""
    reqs = table(spark, sf, "nation").select(F.col("n_nationkey").alias("idx"), F.col("n_name").alias("url"), "n_regionkey")
    there = F.struct(F.col("url").alias("url"), F.lit(200).alias("status_code"), F.lit(7).cast("long").alias("took_ms"), F.lit(0).alias("retries"), F.array(F.lit("kept")).alias("warnings"))
    out = jobs.results_or_placeholders(reqs.select("idx", "url"), reqs.where("n_regionkey > 0").select("idx", there.alias("result")), ["idx"], "no result")
    return out.select("idx", "result.url", F.get("result.warnings", F.lit(0)).alias("note"), F.col("result.took_ms").cast("int").alias("took_ms"))


@query("textarea_urls", r"SELECT page_id, unnest([url, regexp_extract(url, '^https?://([^/?#]*)', 1)]) AS line FROM pages")
def textarea_urls(spark, sf):
    """One address a line, as typed into a text field."""
    text = F.concat(F.lit("  "), "url", F.lit(" \r\n\r\n \n"), F.regexp_extract("url", "^https?://([^/?#]*)", 1), F.lit("\n"))
    return table(spark, sf, "pages").select("page_id", F.explode(classify.text_lines(text)).alias("line"))


@query("one_page_results", "SELECT page_id AS job, CASE WHEN page_id % 3 = 2 THEN url END AS result, CASE WHEN page_id % 3 < 2 THEN 'empty result' END AS error, page_id % 3 < 2 AS retryable FROM pages")
def one_page_results(spark, sf):
    """First result of jobs of one page; an empty list and none are errors that may be tried again."""
    k = F.col("page_id") % 3
    results = F.when(k == 0, F.array().cast("array<string>")).when(k == 2, F.array("url", F.lit("second")))
    return first_result(table(spark, sf, "pages").select(F.col("page_id").alias("job"), results.alias("results")))


@query(
    "job_deadlines",
    """SELECT o_orderkey AS job, CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderkey < 9000 THEN 'failed' ELSE 'running' END AS status,
    CASE WHEN o_orderstatus <> 'F' AND o_orderkey < 9000 THEN 'job_timeout' END AS error FROM orders""",
)
def job_deadlines(spark, sf):
    """Jobs whose time is over at a given moment."""
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("job"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("running").alias("status"), F.col("o_orderkey").cast("double").alias("started"), F.lit(None).cast("string").alias("error"))
    return jobs.past_deadline(rows, F.lit(10000.0), F.lit(1000.0)).select("job", "status", "error")


@query("extract_outer_html", r"SELECT page_id, CASE WHEN page_id % 5 > 0 THEN nullif(regexp_extract(html, '(?s)<h1>.*?</h1>'), '') END AS heading, page_id % 5 = 0 AS empty FROM pages")
def extract_outer_html(spark, sf):
    """The heading with its markup; an empty document has no data at all."""
    html_of = F.when(F.col("page_id") % 5 > 0, F.col("html")).otherwise("")
    got = html.extract(html_of, html.Rule((("heading", html.Field("h1", "html")),)))
    return table(spark, sf, "pages").select("page_id", got.alias("got")).select("page_id", "got.heading", F.col("got.warnings").isNull().alias("empty"))


@query("credential_fallback", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'geo' || s_suppkey WHEN s_suppkey % 3 = 1 THEN 'any' || s_suppkey END AS answer FROM supplier")
def credential_fallback(spark, sf):
    """The answer for a place, else the one without; empty answers are none."""
    k = F.col("s_suppkey")
    with_geo = F.when(k % 3 == 0, F.concat(F.lit("geo"), k)).when(k % 3 == 1, "")
    return table(spark, sf, "supplier").select("s_suppkey", classify.geo_or_plain(with_geo, F.when(k % 3 == 2, "").otherwise(F.concat(F.lit("any"), k))).alias("answer"))


@query("stream_late_subscriber", "SELECT CASE WHEN event_id < 400 THEN 'stored' ELSE 'followed' END AS part, count(*) AS n, max(event_id) AS last FROM events GROUP BY 1")
def stream_late_subscriber(spark, sf):
    """Events that a subscriber gets who comes when the first 400 are stored: those once, then what follows, nothing twice."""
    folder = stream_folder(spark, "subscriber")
    log = table(spark, sf, "events").where("event_id < 400").select(F.col("event_id").alias("seq"), F.col("event_type").alias("type"))
    stream = streams.read_events(spark, f"{sf}/events.parquet").withColumnRenamed("event_id", "seq")

    def keep(df, batch_id):
        df.select("seq", F.lit("stored" if batch_id < 0 else "followed").alias("part")).write.mode("overwrite").parquet(f"{folder}/got/batch={batch_id}")

    q = streams.replay_then_follow(log, stream, keep, f"{folder}/state")
    q.processAllAvailable()
    q.stop()
    got = spark.read.schema("seq bigint, part string").parquet(f"{folder}/got")
    return got.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last"))


@query("stream_fan_out", "SELECT c AS consumer, CASE c WHEN 'full' THEN 0 ELSE count(*) END AS n FROM events, (VALUES ('audit'), ('stats'), ('full')) v(c) GROUP BY c")
def stream_fan_out(spark, sf):
    """Three consumers of one stream; one is full and loses its batches, the others don't notice."""
    folder = stream_folder(spark, "fan-out")

    def keep(name):
        def run(df, batch_id):
            df.select("event_id", F.lit(name).alias("consumer")).write.mode("overwrite").parquet(f"{folder}/got/{name}-{batch_id}")

        return run

    def full(df, batch_id):
        raise BufferError

    log = streams.read_events(spark, f"{sf}/events.parquet")
    running = streams.fan_out(log, {"audit": keep("audit"), "stats": keep("stats"), "full": full}, f"{folder}/state")
    for q in running.values():
        q.processAllAvailable()
        q.stop()
    got = spark.read.schema("event_id bigint, consumer string").option("recursiveFileLookup", True).parquet(f"{folder}/got")
    names = spark.createDataFrame([(n,) for n in running], "consumer string")
    return names.join(got.groupBy("consumer").agg(F.count(F.lit(1)).alias("n")), "consumer", "left").select("consumer", F.coalesce("n", F.lit(0)).alias("n"))
