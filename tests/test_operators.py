import json

import pytest
from pyspark.sql import functions as F

from tests.oracle import agree
from webloom.functions import classify
from webloom.operators import frontier, jobs, ordered, pool, sitemap
from webloom.functions.html import Field, Rule
from webloom.operators.crawl import Cancel, crawl
from webloom.operators.scope import Scope, reason
from webloom.sources import inventory, sinks
from webloom.streaming import events as streams

SEED = "https://example.com/"


@pytest.mark.parametrize(
    ("scope", "url", "depth", "expected"),
    [
        (Scope(SEED), "https://example.com/about", 1, None),
        (Scope(SEED), "https://blog.example.com/", 1, "mode"),
        (Scope(SEED, "subdomains"), "https://blog.example.com/", 1, None),
        (Scope(SEED, "subdomains"), "https://other.com/", 1, "mode"),
        (Scope(SEED, "all"), "https://other.com/", 1, None),
        (Scope(SEED, "all"), "ftp://example.com/", 1, "scheme"),
        (Scope(SEED, max_depth=2), "https://example.com/x", 3, "max_depth"),
        (Scope(SEED, "all", ("/blog/",), ("/blog/private/",)), "https://x.com/blog/private/post", 1, "exclude"),
        (Scope(SEED, "regex", (r"^https://example\.com/blog/",)), "https://example.com/about", 1, "include"),
        (Scope(SEED, "regex"), "https://example.com/about", 1, "mode"),
    ],
)
def test_scope(spark, scope, url, depth, expected):
    assert spark.range(1).select(reason(scope, F.lit(url), F.lit(depth)).alias("r")).first().r == expected


def test_round_robin(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "b")], "seq int, host string")
    assert [r.seq for r in frontier.take_fairly(df, 4, "host", "seq").orderBy("turn", "first").collect()] == [1, 3, 2, 4]


def pages(spark, rows):
    return spark.createDataFrame(rows, "url string, html string, status_code int, error string")


def test_crawl_cases(spark):
    link = lambda *u: "".join(f'<a href="{x}">x</a>' for x in u)
    one = crawl(pages(spark, [(SEED, "<p>no links", 200, None)]), Scope(SEED))
    assert [(r.url, r.depth, r.parent_url) for r in one.ledger.collect()] == [(SEED, 0, None)]
    store = pages(spark, [(SEED, link("/child", "https://off.com/"), 200, None), (SEED + "child", link("/child", "/", "/gone"), 404, None)])
    c = crawl(store, Scope(SEED, max_depth=2))
    got = {r.url: (r.depth, r.ok, r.error) for r in c.ledger.collect()}
    assert got == {SEED: (0, True, None), SEED + "child": (1, False, None), SEED + "gone": (2, False, "page not in store")}
    assert c.stats().first().asDict() == {"visited": 2, "queued": 0, "failed": 1, "dedup_skipped": 2, "out_of_scope": 1, "retries_total": 0}
    many = pages(spark, [(SEED, link(*[f"/p{i}" for i in range(20)]), 200, None)] + [(f"{SEED}p{i}", "", 200, None) for i in range(20)])
    assert crawl(many, Scope(SEED), max_pages=1).stats().first().visited == 1
    assert crawl(many, Scope(SEED), max_pages=7).stats().first().visited == 7
    flat = crawl(many, Scope(SEED, max_depth=0)).stats().first()
    assert (flat.visited, flat.out_of_scope) == (1, 20)
    failing = pages(spark, [(SEED, link("/a", "/b", "/c"), 200, None), (SEED + "a", None, None, "503"), (SEED + "b", "", 200, None), (SEED + "c", "", 200, None)])
    assert [r.url for r in crawl(failing, Scope(SEED), max_pages=2).ledger.where("error is null").orderBy("url").collect()] == [SEED, SEED + "b"]


def test_crawl_retries_cancel_and_discovery(spark):
    link = "<h1>T</h1>" + "".join(f'<a href="/p{i}">x</a>' for i in range(20))
    kinds = "url string, html string, status_code int, error string, attempt int, retryable boolean"
    rows = [(SEED, None, 503, "busy", 0, True), (SEED, None, 503, "busy", 1, True), (SEED, link, 200, None, 2, False), (SEED + "p0", None, 422, "bad", 0, False), (SEED + "p1", None, None, "gone", 0, True)]
    rows += [(f"{SEED}p{i}", "<p>x", 200, None, 0, False) for i in range(2, 20)]
    store = spark.createDataFrame(rows, kinds)
    c = crawl(store, Scope(SEED))
    got = {r.url: (r.error, r.retries, r.wait_s, r.response) for r in c.ledger.collect()}
    assert got[SEED] == (None, 2, 6.0, None) and got[SEED + "p0"] == ("bad", 0, 0.0, None) and got[SEED + "p1"] == ("gone", 3, 14.0, None)
    assert c.stats().first().asDict() == {"visited": 19, "queued": 0, "failed": 2, "dedup_skipped": 0, "out_of_scope": 0, "retries_total": 5}
    rule = Rule((("title", Field("h1")),))
    kept = crawl(store, Scope(SEED), max_pages=5, rule=rule, scraping=True)
    assert {r.url: r.response.data for r in kept.ledger.collect()}[SEED] == {"title": ["T"]}
    assert kept.stats().first().asDict() | {"failed": 2} == {"visited": 5, "queued": 14, "failed": 2, "dedup_skipped": 0, "out_of_scope": 0, "retries_total": 5}
    for hard in (False, True):
        c = crawl(store, Scope(SEED), cancel=Cancel(6, hard, 3))
        s = c.stats().first()
        assert (c.status, s.visited, s.failed, s.queued) == ("cancelled", 6 if hard else 9, 5 if hard else 2, 10)
        assert c.ledger.where("error = 'cancelled'").count() == 3 * hard


def test_crawls_of_the_same_pages_share_their_answers(spark, sf, monkeypatch):
    from webloom.operators import crawl as operator
    from webloom.plans.crawl_queries import ORACLE, QUERIES

    calls, answers = [], operator.answers
    monkeypatch.setattr(operator, "answers", lambda *a, **k: calls.append(1) or answers(*a, **k))
    agree(spark, sf, QUERIES["crawl_cancel"], ORACLE["crawl_cancel"])
    assert len(calls) == 1


def test_session_and_throttle(spark):
    codes = [200, 500, 200, 500, 500, 500, 200, 429, 200]
    df = spark.createDataFrame([("p", i, c) for i, c in enumerate(codes)], "pool string, seq int, status int")
    rows = ordered.session_health(df, "pool", ["seq"], "status").orderBy("seq").collect()
    assert [r.session for r in rows] == [1, 1, 1, 1, 1, 1, 2, 2, 3]
    assert [r.score for r in rows] == [0, 1, 0.5, 1.5, 2.5, 3.5, 0, 1, 0] and [r.retired for r in rows] == [False] * 5 + [True, False, True, False]
    log = [("d", 0.0, "slow"), ("d", 1.0, "slow"), ("d", 2.0, "ok"), ("d", 62.0, "ok"), ("d", 63.0, "ok")]
    df = spark.createDataFrame(log, "d string, t double, kind string")
    out = ordered.throttle(df, "d", ["t"], "t", "kind").orderBy("t").collect()
    assert [r.factor for r in out] == [0.5, 0.25, 0.25, 0.375, 0.5625]
    slots = ordered.token_slots(df, "d", ["t"], "t", 0.5).orderBy("t").collect()
    assert [r.slot for r in slots] == [0, 2, 4, 62, 64]


def test_classifiers(spark):
    df = spark.createDataFrame([(None, "Connection CLOSED by peer"), (407, None), (200, "bad selector"), (None, None)], "s int, e string")
    assert [r[0] for r in df.select(classify.is_resource_failure(F.col("s"), F.col("e"))).collect()] == [True, True, False, False]
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first().v
    assert [value(classify.parent_timeout(F.lit(x).cast("int"))) for x in (10000, 5000, None, 0)] == [50000, 40000, None, None]
    assert value(classify.merged_headers(F.expr("map('Accept-Language', 'de', 'A', '1')"), F.expr("map('accept-language', 'fr')"))) == {"A": "1", "accept-language": "fr"}
    assert value(classify.without_nulls(F.expr("map('a', cast(null as string))"))) is None
    assert value(classify.text_lines(F.lit("a \r\n\n b"))) == ["a", "b"]
    assert 0.8 * 4 <= value(classify.backoff(F.lit(2), 0.2, F.lit("u"))) <= 1.2 * 4
    assert value(classify.drop_sentinel(F.expr("array('SHOP ON X', 'b')"), "SHOP ON")) == ["b"]


def test_pool_and_recovery(spark):
    inv = spark.createDataFrame([("1", "lte", "u", "active", False, 1), ("2", "lte", "u", "active", False, 2), ("3", "lte", "", "active", False, 3)], "id string, category string, url string, status string, expired boolean, seq int")
    req = spark.createDataFrame([(1, "lte", "2"), (2, "lte", "3"), (3, "datacenter", None)], "request_id int, category string, pin string")
    assert {r.request_id: r.id for r in pool.select(req, inv).collect()} == {1: "2", 2: "1", 3: None}
    fails = spark.createDataFrame([("j", "mobile", 1, False), ("j", "mobile", 2, True), ("j", "mobile", 3, False), ("k", "mobile_shared", 1, True)], "job string, type string, seq int, change_works boolean")
    assert {r.job: r.path for r in pool.recover(fails, inv).collect()} == {"j": ["1", "2", "2", None], "k": ["1", "2"]}


def test_site_map_and_jobs(spark):
    rows = [("r", None, 1, 0, 200, None, 5), ("a", "r", 2, 1, None, "x", 0), ("b", "r", 3, 1, 200, None, 7), ("c", "a", 4, 2, None, None, 1), ("o", "lost", 5, 1, 200, None, 2)]
    df = spark.createDataFrame(rows, "url string, parent_url string, ord int, depth int, status_code int, error string, took_ms int")
    lines = [r.line for r in sitemap.text_lines(df).orderBy("path").collect()]
    assert lines == ["r  [d=0, 200, 5ms]", "│   ├── a  [d=1, ERR, 0ms]", "│   │   └── c  [d=2, —, 1ms]", "│   └── b  [d=1, 200, 7ms]", "o  [d=1, 200, 2ms]"]
    reqs = spark.createDataFrame([(0, "u0"), (1, "u1")], "idx int, url string")
    miss = jobs.results_or_placeholders(reqs, reqs.where("idx = 0").select("idx", classify.placeholder(F.lit("u0"), F.lit("fine")).alias("result")), ["idx"], "worker failed")
    assert {r.idx: r.result.warnings for r in miss.collect()} == {0: ["fine"], 1: ["worker failed"]}


def test_sources_and_sinks(spark, tmp_path):
    item = {"id": "7", "url": "h:1", "system_status": "Active", "connection_port": 1}
    df = spark.createDataFrame([(json.dumps([item]),), (json.dumps({"results": [item, item]}),)], "body string")
    out = inventory.inventory(df, "body").collect()
    assert len(out) == 3 and out[0].status == "active" and out[0].expired is False
    with pytest.raises(Exception, match="neither"):
        inventory.inventory(spark.createDataFrame([('{"x": 1}',)], "body string"), "body").collect()
    assert inventory.requests(spark.createDataFrame([('{"url": "u"}',)], "b string"), "b").first().device == "desktop"
    rows = spark.createDataFrame([("u", 200, "é")], "url string, status_code int, title string")
    sinks.write_csv(rows, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first().title == "é"
    sinks.write_json(rows, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first().title == "é"
    assert bytes(sinks.decoded_images(spark.createDataFrame([("iVBORw==",)], "screenshot_base64 string")).first().image)[1:4] == b"PNG"
    sinks.write_html(rows.select(F.lit("<p>x</p>").alias("html")), str(tmp_path / "h"))
    assert spark.read.text(str(tmp_path / "h")).first().value == "<p>x</p>"


def test_running_stream(spark, sf, tmp_path):
    seen = []
    q = streams.write_batches(streams.read_events(spark, f"{sf}/events.parquet"), lambda df, i: seen.append(df.count()), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert sum(seen) == 1000


def test_api(spark, monkeypatch):
    from webloom import api
    from webloom.functions.html import Field, Rule
    from webloom.settings import Settings

    monkeypatch.setenv("WEBLOOM_MAX_PAGES", "1")
    store = pages(spark, [(SEED, '<h1>T</h1><a href="/a">a</a>', 200, None), (SEED + "a", "", 500, None)])
    rule = Rule((("title", Field("h1", required=True)),))
    r = api.scrape_page(spark, "HTTPS://example.com", store, rule, raw_html=True).first()
    assert (r.ok, r.data.title, r.final_url, r.warnings) == (True, "T", SEED, []) and r.raw_html.startswith("<h1>")
    r = api.scrape_page(spark, SEED + "a", store, rule).first()
    assert r.data.title is None and r.warnings == ["status_code=500"]
    c = api.create_crawl(store, Scope(SEED), Settings.from_environment())
    assert [r.type for r in api.crawl_events(c).orderBy("ord").collect()] == ["stats", "page", "done"]
    log = spark.createDataFrame([("j", 1, "queued", 4, 0), ("j", 2, "running", None, 1), ("k", 1, "done", 1, 1)], "job string, seq int, status string, total bigint, done bigint")
    s = api.job_status(log, "j").first()
    assert (s.status, s.total, s.done, s.pct, s.running, s.queued) == ("running", 4, 1, 25, 2, 1)
    assert [r.job for r in api.cancel(log.where("seq = 1"), log.select("job").distinct()).collect()] == ["j"]


def test_long_log_of_one_key(spark):
    n = 200_000
    df = spark.range(n).select(F.lit("k").alias("key"), F.col("id").alias("seq"), F.when(F.col("id") % 7 == 0, 500).otherwise(200).alias("status"))
    last = ordered.session_health(df, "key", ["seq"], "status").agg(F.max("session"), F.count(F.lit(1))).first()
    assert tuple(last) == (n // 50, n)
    none = spark.createDataFrame([(None, 1, None), (None, 2, 200)], "key string, seq int, status int")
    assert [r.score for r in ordered.session_health(none, "key", ["seq"], "status").orderBy("seq").collect()] == [1.0, 0.5]


def test_late_subscriber_and_fan_out(spark, sf, tmp_path):
    stream = streams.read_events(spark, f"{sf}/events.parquet").withColumnRenamed("event_id", "seq")
    log = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").alias("seq"), F.lit("page").alias("type")).where("seq <= 300")
    got, note = [], lambda df, i: got.extend((i < 0, r.seq) for r in df.select("seq").collect())
    q = streams.replay_then_follow(log, stream, note, str(tmp_path / "a"))
    q.processAllAvailable()
    q.stop()
    assert len(got) == len({s for _, s in got}) == 1000 and sum(old for old, _ in got) == log.count()
    from webloom import api

    assert api.subscribe(log.limit(1).withColumn("type", F.lit("done")), stream, note, str(tmp_path / "b")) is None
    seen, dropped = [], []

    def full(df, i):
        raise BufferError

    both = streams.fan_out(stream, {"one": lambda df, i: seen.append(df.count()), "two": full}, str(tmp_path / "c"), lambda *x: dropped.append(x))
    for q in both.values():
        q.processAllAvailable()
        q.stop()
    assert sum(seen) == 1000 and dropped and dropped[0][0] == "two"
    calls = []
    once = streams.on_change(lambda df, i: calls.append(i))
    for i, v in enumerate((1, 1, 2, 2)):
        once(spark.createDataFrame([(v,)], "v int"), i)
    assert calls == [0, 2]


def test_small_functions(spark):
    from webloom.operators.scrape import first_result

    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first().v
    assert value(classify.first_n(F.expr("array(1, 2, 3)"), 2)) == [1, 2] and value(classify.truncated(F.lit("abcdef"), 3)) == "abc"
    assert value(classify.geo_or_plain(F.lit(""), F.lit("p"))) == "p" and value(classify.now_s()) > 1.6e9
    rows = spark.createDataFrame([("a", ["x", "y"]), ("b", []), ("c", None)], "job string, results array<string>")
    assert {r.job: (r.result, r.error, r.retryable) for r in first_result(rows).collect()} == {"a": ("x", None, False), "b": (None, "empty result", True), "c": (None, "empty result", True)}
    late = spark.createDataFrame([("r", "running", 0.0, None), ("d", "done", 0.0, None), ("n", "queued", None, None)], "job string, status string, started double, error string")
    assert {r.job: (r.status, r.error) for r in jobs.past_deadline(late, F.lit(99.0), F.lit(60.0)).collect()} == {"r": ("failed", "job_timeout"), "d": ("done", None), "n": ("queued", None)}
    assert {r.device: (r.width, r.touch, r.timezone) for r in inventory.devices(spark).collect()} == {"desktop": (1280, False, "America/New_York"), "mobile": (390, True, "America/New_York")}
    pages2 = jobs.appended([one.withColumn("a", F.lit(1)), one.withColumn("b", F.lit(2))])
    assert sorted((r.result_page, r.a, r.b) for r in pages2.collect()) == [(0, 1, None), (1, None, 2)]
