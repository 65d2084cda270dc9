"""Event time: files in any order, timers, joins of streams, sessions with late rows, restarts; slots split over blocks."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from webloom.functions import variant
from webloom.operators import ordered, scan, sketches
from webloom.streaming import events as streams
from webloom.streaming import timed

LOG = "key string, seq bigint, at bigint, kind string, value double"
END = "end"


def write_files(spark, folder, parts):
    """A file for each part, which the stream reads in this order."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, LOG).coalesce(1).write.parquet(f"{folder}/part={i}")


def read(spark, folder, delay):
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(f"{folder}/part=*")
    return stream.withColumn("ts", F.timestamp_micros("at")).withWatermark("ts", delay) if delay else stream.withColumn("ts", F.timestamp_micros("at"))


def run(spark, stream, tmp_path, name="q"):
    with timed.timed_state(spark):
        return streams.run_once(stream, name, "append", str(tmp_path / "cp"))


def us(seconds):
    return 1_700_000_000_000_000 + round(seconds * 1_000_000)


def closing(seq=10**6):
    """A mark that is late enough for the watermark to pass all before it."""
    return (END, seq, us(10**7), "mark", 0.0)


def random_log(n, seed, kinds, keys="abc", span=3000):
    r = random.Random(seed)
    return [(r.choice(keys), i, us(t), r.choice(kinds), 1.0) for i, t in enumerate(sorted(r.uniform(0, span) for _ in range(n)))]


def test_throttle_reads_shuffled_files_in_order(spark, tmp_path):
    rows = random_log(600, 1, ["slow", "ok", "ok", "ok", "other"])
    mixed = random.Random(2).sample(rows, len(rows))
    write_files(spark, tmp_path / "in", [mixed[:200], mixed[200:400], mixed[400:], [closing()]])
    log = read(spark, tmp_path / "in", "1 hour")
    got = run(spark, timed.ordered_fold(log, "key", "ts", "seq", timed.Throttle(60)), tmp_path)
    batch = spark.createDataFrame(rows, LOG).withColumn("t", F.col("at") / 1e6)
    want = ordered.throttle(batch, "key", ["t", "seq"], "t", "kind", 60.0).collect()
    got = got.where(f"key <> '{END}'").collect()
    assert sorted((r.key, r.event_id, r.factor) for r in got if r.what == "event") == sorted((r.key, r.seq, r.factor) for r in want)
    ends = set()
    for key, mine in itertools.groupby(sorted(r for r in rows if r[3] == "slow"), key=lambda r: r[0]):
        times = sorted(r[2] for r in mine)
        ends |= {(key, a + 60_000_000) for a, b in zip(times, [*times[1:], 1 << 62], strict=True) if b >= a + 60_000_000}
    assert {(r.key, r.at) for r in got if r.what == "open"} == ends and len(ends) > 3


def test_late_events_are_not_folded(spark, tmp_path):
    """What comes after the watermark has passed it and a batch has been folded up to there is left out; what comes before isn't."""
    on_time = [("a", i, us(i * 10), "fail" if i % 2 else "ok", 1.0) for i in range(100)]
    write_files(spark, tmp_path / "in", [on_time[50:], on_time[45:50], [("a", 999, us(1), "fail", 1.0)], [closing()]])
    got = run(spark, timed.ordered_fold(read(spark, tmp_path / "in", "100 seconds"), "key", "ts", "seq", timed.Requeue()), tmp_path).collect()
    assert sorted(r.event_id for r in got) == [i for i in range(45, 100) if i % 2]
    assert all(r.attempt == 1 and r.ready == us(r.event_id * 10 + 2) for r in got)


def test_requeue_order_and_limit(spark, tmp_path):
    rows = [("a", 1, us(0), "fail", 0.0), ("a", 2, us(1), "fail", 0.0), ("a", 3, us(1.5), "fail", 0.0), ("a", 4, us(2), "fail", 0.0), ("a", 5, us(3), "ok", 0.0), ("a", 6, us(4), "fail", 0.0)]
    write_files(spark, tmp_path / "in", [[rows[3], rows[0]], [rows[5], rows[2]], [rows[1], rows[4]], [closing()]])
    got = run(spark, timed.ordered_fold(read(spark, tmp_path / "in", "1 minute"), "key", "ts", "seq", timed.Requeue(3, 2.0, 6.0)), tmp_path).collect()
    assert [(r.event_id, r.attempt, r.ready, r.what) for r in got] == [(1, 1, us(2), "retry"), (4, 3, us(2), "given up"), (2, 2, us(5), "retry"), (6, 1, us(6), "retry"), (3, 3, us(7.5), "retry")]


def test_deadlines_with_a_restart(spark, tmp_path):
    """Timers and state live in the checkpoint: a second run goes on where the first one stopped, and nothing is given twice."""
    first = [("a", 1, us(0), "start", 0.0), ("b", 2, us(1), "start", 0.0), ("c", 3, us(2), "start", 0.0), ("a", 4, us(5), "done", 0.0), ("a", 5, us(6), "done", 0.0)]
    later = [("b", 6, us(8), "start", 0.0), ("c", 7, us(20), "failed", 0.0), ("c", 8, us(21), "start", 0.0), ("c", 9, us(22), "cancelled", 0.0), ("d", 10, us(23), "done", 0.0), ("e", 11, us(24), "start", 0.0)]
    fold = lambda: timed.ordered_fold(read(spark, tmp_path / "in", "1 second"), "key", "ts", "seq", timed.Deadlines(10))
    write_files(spark, tmp_path / "in", [first])
    one = run(spark, fold(), tmp_path).collect()
    spark.createDataFrame(later, LOG).coalesce(1).write.parquet(str(tmp_path / "in/part=1"))
    two = run(spark, fold(), tmp_path).collect()
    spark.createDataFrame([closing()], LOG).coalesce(1).write.parquet(str(tmp_path / "in/part=2"))
    three = run(spark, fold(), tmp_path).collect()
    rows = [(r.key, r.run, r.started, r.ended, r.status, r.error) for r in (*one, *two, *three)]
    assert sorted(rows) == [
        ("a", 1, us(0), us(5), "done", None), ("b", 1, us(1), us(11), "failed", "job_timeout"), ("c", 1, us(2), us(12), "failed", "job_timeout"),
        ("c", 2, us(21), us(22), "cancelled", None), ("e", 1, us(24), us(34), "failed", "job_timeout"),
    ]
    assert len(one) == 1 and len(three) == 1


@pytest.mark.parametrize("how", ["inner", "leftOuter"])
def test_stream_join_gives_each_task_once(spark, tmp_path, how):
    rows = random_log(200, 5, ["task", "result", "other"], "abcdefgh", 4000)
    slices = [rows[i : i + 50] for i in range(0, 200, 50)]
    write_files(spark, tmp_path / "in", [*slices, [(END, 10**6, us(10**6), "task", 0.0), (END, 10**6 + 1, us(10**6), "result", 0.0)], [(END, 10**6 + 2, us(2 * 10**6), "task", 0.0), (END, 10**6 + 3, us(2 * 10**6), "result", 0.0)]])
    log = read(spark, tmp_path / "in", None)
    tasks = log.where("kind = 'task'").select("key", F.col("seq").alias("task"), F.col("ts").alias("asked"))
    results = log.where("kind = 'result'").select(F.col("key").alias("by"), F.col("seq").alias("result"), F.col("ts").alias("answered"))
    out = timed.joined_within(tasks, results, F.col("key") == F.col("by"), "asked", "answered", "100 seconds", "10 seconds", how)
    got = streams.run_once(out.select("key", "task", "result"), "join", "append", str(tmp_path / "cp")).where(f"key <> '{END}'").collect()
    want = []
    for key, seq, at, kind, _ in rows:
        if kind == "task":
            hits = [r[1] for r in rows if r[0] == key and r[3] == "result" and at <= r[2] <= at + 100_000_000]
            want += [(key, seq, h) for h in hits] or ([(key, seq, None)] if how == "leftOuter" else [])
    assert sorted(map(str, ((r.key, r.task, r.result) for r in got))) == sorted(map(str, want)) and len(want) > 10


def test_first_results(spark, tmp_path):
    rows = [("a", 1, us(0), "task", 0.0), ("a", 2, us(1), "task", 0.0), ("a", 3, us(2), "result", 0.0), ("a", 4, us(3), "result", 0.0), ("a", 5, us(4), "result", 0.0), ("a", 6, us(5), "task", 0.0), ("a", 7, us(15), "result", 0.0), ("b", 8, us(1), "result", 0.0)]
    write_files(spark, tmp_path / "in", [rows[4:], rows[:4], [closing()]])
    got = run(spark, timed.first_results(read(spark, tmp_path / "in", "1 minute"), "key", "ts", "seq", 10), tmp_path).collect()
    assert sorted((r.task_id, r.result_id, r.at) for r in got) == [(1, 3, us(2)), (2, 4, us(3)), (6, None, us(15))]


def test_sessions_and_late_rows(spark, tmp_path):
    """Sessions that files complete bit by bit; a late row goes to the side and changes no session."""
    on_time = [("a", 1, us(100), "x", 1.0), ("a", 2, us(130), "x", 2.0), ("b", 3, us(110), "x", 4.0)]
    bridge = [("a", 4, us(115), "x", 8.0), ("a", 5, us(160), "x", 16.0)]  # joins what stood apart
    new = [("a", 6, us(400), "x", 1.0)]
    late = [("a", 7, us(120), "x", 32.0), ("b", 8, us(395), "x", 64.0)]
    write_files(spark, tmp_path / "in", [on_time, bridge, new, late, [closing()]])
    out = timed.sessions(read(spark, tmp_path / "in", None), "key", "ts", "seq", "value", 20, 60, 1000)
    got = run(spark, out, tmp_path).where(f"key <> '{END}'").collect()
    rows = sorted((r.what, r.key, r.start, r.end, r.n, r.total) for r in got)
    assert rows == [
        ("late", "a", us(120), us(120), 1, 32.0), ("session", "a", us(100), us(130), 3, 11.0), ("session", "a", us(160), us(160), 1, 16.0),
        ("session", "a", us(400), us(400), 1, 1.0), ("session", "b", us(110), us(110), 1, 4.0), ("session", "b", us(395), us(395), 1, 64.0),
    ]


def test_sessions_against_session_window(spark, tmp_path):
    rows = random_log(300, 9, ["x"], "abcd", 20_000)
    write_files(spark, tmp_path / "in", [rows[:100], rows[100:200], rows[200:], [closing()]])
    out = timed.sessions(read(spark, tmp_path / "in", None), "key", "ts", "seq", "value", 60, 600)
    got = run(spark, out, tmp_path).where(f"key <> '{END}'")
    plain = spark.createDataFrame(rows, LOG).withColumn("ts", F.timestamp_micros("at")).groupBy("key", F.session_window("ts", "60 seconds")).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("start"))
    assert sorted((r.key, r.start, r.n) for r in got.collect()) == sorted((r.key, r.start, r.n) for r in plain.collect())


def plain_slots(rows):
    out, free = {}, {}
    for key, at, seq, gap in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        out[seq] = max(at, free.get(key, at))
        free[key] = out[seq] + gap
    return out


@pytest.mark.parametrize("blocks", [1, 3, 16])
def test_slots_split_a_hot_key(spark, blocks):
    """One key has nine tenths of the log, so it lies in most of the blocks."""
    r = random.Random(blocks)
    rows = [("hot" if r.random() < 0.9 else r.choice(["a", "b", "z", None]), r.randrange(0, 400_000), i, r.randrange(0, 100)) for i in range(8000)]
    df = spark.createDataFrame(rows, "key string, at bigint, seq bigint, gap bigint").repartition(5)
    out = scan.slots(df, "key", ["at", "seq"], "at", "gap", blocks)
    assert out.columns == ["key", "at", "seq", "gap", "slot"] and out.rdd.getNumPartitions() == blocks
    assert {x.seq: x.slot for x in out.collect()} == plain_slots(rows)
    if blocks == 16:
        assert max(len(p) for p in out.where("key = 'hot'").rdd.glom().collect()) < 2000
    assert scan.slots(df.limit(0), "key", ["at", "seq"], "at", "gap", blocks).count() == 0


@pytest.mark.parametrize("blocks", [1, 5, 16])
def test_session_health_splits_a_hot_key(spark, blocks):
    """The same as the scan that reads a key's log in one task, with blocks that a key fills, ends in or lies inside."""
    r = random.Random(blocks)
    rows = [("hot" if r.random() < 0.8 else r.choice(["a", "b", "z", None]), i, r.choice([200, 200, 200, 302, 500, 404, 403, None])) for i in range(6000)]
    rows += [(f"k{i}", i, 500) for i in range(300)]
    df = spark.createDataFrame(rows, "key string, seq bigint, status int").repartition(5)
    got = scan.session_health(df, "key", ["seq"], "status", blocks=blocks)
    want = ordered.session_health(df, "key", ["seq"], "status")
    assert got.columns == want.columns and got.dtypes == want.dtypes
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    odd = scan.session_health(df, "key", ["seq"], "status", 2.5, 7, (200, 404), blocks)
    assert sorted(map(tuple, odd.collect()), key=str) == sorted(map(tuple, ordered.session_health(df, "key", ["seq"], "status", 2.5, 7, (200, 404)).collect()), key=str)
    assert scan.session_health(df.limit(0), "key", ["seq"], "status", blocks=blocks).count() == 0


def test_effective_interval(spark):
    rows = [(1.0, 0.0, 5.0, 0.5), (0.5, 10.0, 5.0, 0.5), (0.5, 10.0, 10.0, 0.0), (0.1, 10.0, 5.0, 1.0), (None, None, 5.0, 0.5)]
    df = spark.createDataFrame(rows, "factor double, until double, t double, j double")
    got = [r.d for r in df.select(scan.effective_interval(2.0, F.col("factor"), F.col("until"), F.col("t"), F.col("j")).alias("d")).collect()]
    assert got == [500_000, 1_000_000, 400_000, 6_000_000, 500_000]


def test_sketches_unite(spark):
    df = spark.range(60_000).select((F.col("id") % 3).alias("day"), (F.col("id") % 20_000).alias("v"), F.lit("h").alias("host"))
    kept = sketches.distinct_sketches(df, ["host", "day"], F.col("v"))
    n = lambda s: sketches.united(s, ["host"]).first().estimate
    assert abs(n(kept) - 20_000) < 800 and abs(n(kept.where("day < 2")) - 20_000) < 800  # any two days have all values
    more = sketches.distinct_sketches(spark.range(5000).select(F.lit(9).cast("bigint").alias("day"), (F.col("id") + 10**6).alias("v"), F.lit("h").alias("host")), ["host", "day"], F.col("v"))
    assert abs(n(sketches.added(kept, more, ["host"])) - 25_000) < 1000
    assert sketches.united(sketches.distinct_sketches(df.where("v IS NULL"), ["host"], F.col("v")), ["host"]).count() == 0


def test_variant_paths(spark):
    rows = [(1, '{"a": {"b": [1, {"c": "x"}]}, "n": 7}'), (2, '{"a": null, "n": "7"}'), (3, "broken {"), (4, ""), (5, None), (6, '{"a.b": 3}')]
    out = variant.with_paths(spark.createDataFrame(rows, "i int, body string"), "body", {"c": ("a.b.1.c", "string"), "n": ("n", "int"), "all": ("a", "string")})
    assert out.columns == ["i", "body", "c", "n", "all"]
    got = {r.i: (r.c, r.n) for r in out.collect()}
    assert got == {1: ("x", 7), 2: (None, 7), 3: (None, None), 4: (None, None), 5: (None, None), 6: (None, None)}


def test_page_store_prunes_files_and_rows(spark, tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringContains

    from webloom.sources import pagestore

    rows = [(f"https://h{i % 40:02d}.example.com/{i}", f"<p>{i}") for i in range(400)] + [(None, "x")]
    path = str(tmp_path / "store")
    pagestore.write_store(spark.createDataFrame(rows, "url string, html string"), path, 8)
    reader = pagestore.PageStoreReader(path)
    every = reader.partitions()
    assert len(every) > 4
    left = list(reader.pushFilters([EqualTo(("host",), "h05.example.com"), StringContains(("html",), "5")]))
    assert [type(f) for f in left] == [StringContains] and len(reader.partitions()) == 1
    got = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert len(got) == 10 and {r["host"] for r in got} == {"h05.example.com"}
    for f, n in ((In(("host",), ("h01.example.com", "h39.example.com", None)), 20), (GreaterThan(("host",), "h38.example.com"), 10)):
        r = pagestore.PageStoreReader(path)
        assert not list(r.pushFilters([f])) and len(r.partitions()) < len(every) and sum(b.num_rows for p in r.partitions() for b in r.read(p)) == n
    df = pagestore.read_store(spark, path)
    assert df.count() == 401 and df.where("host = 'h07.example.com' AND html LIKE '%7%'").count() == 10 and df.where("url = 'https://h03.example.com/43'").first().html == "<p>43"


def test_text_sink_writes_a_batch_once(spark, tmp_path):
    from webloom.sources import pagestore

    writer = pagestore.TextSinkWriter(str(tmp_path / "out"))
    lines = lambda: sorted(x for f in (tmp_path / "out").glob("batch-*") for x in f.read_text().splitlines())
    task = lambda *t: writer.write({"text": f"{x}\n"} for x in t)
    writer.commit([task("a", "b"), task(), task("c")], 0)
    lost = [task("x"), None]
    writer.abort(lost, 1)
    writer.commit([task("d")], 1)
    writer.commit([task("d"), task("e")], 1)  # the batch is tried again
    assert lines() == list("abcde") and not list((tmp_path / "out/_aside").iterdir()) and len(list((tmp_path / "out/_batches").iterdir())) == 2
    folder = tmp_path / "in"
    for i in range(2):
        spark.createDataFrame([(f"{i}{k}\n",) for k in range(3)], "text string").coalesce(1).write.parquet(f"{folder}/part={i}")
        stream = spark.readStream.schema("text string").parquet(f"{folder}/part=*")
        pagestore.write_text(stream, str(tmp_path / "stream"), str(tmp_path / "cp")).awaitTermination()
    got = sorted(x for f in (tmp_path / "stream").glob("batch-*") for x in f.read_text().splitlines())
    assert got == ["00", "01", "02", "10", "11", "12"]


def test_counters_outlive_a_restart(spark, tmp_path):
    from webloom.streaming import metrics

    rows = random_log(90, 3, ["ok", "fail"])
    for i in range(2):
        write_files(spark, tmp_path / f"in{i}", [rows[:30], rows[30:60]] if not i else [rows[60:]])
    for i in range(2):
        counters = metrics.Counters("pages", str(tmp_path / "counts"))
        spark.streams.addListener(counters)
        for part in (tmp_path / f"in{i}").iterdir():
            part.rename(tmp_path / f"in0/{part.name}_{i}") if i else None
        log = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in0/part=*")
        seen = metrics.observed(log, "pages", visited=F.count(F.lit(1)), failed=F.count_if(F.col("kind") == "fail"))
        streams.run_once(seen, f"q{i}", "append", str(tmp_path / "cp"))
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        spark.streams.removeListener(counters)
        done = rows[:60] if not i else rows
        assert counters.totals() == {"visited": len(done), "failed": sum(r[3] == "fail" for r in done)}
    assert len(counters.batches()) == 3


def test_change_suppression_outlives_a_restart(spark, tmp_path):
    calls = []
    for start, values in ((0, (1, 1, 2)), (3, (2, 3))):
        once = streams.on_change(lambda df, i: calls.append(i), str(tmp_path / "last"))
        for i, v in enumerate(values, start):
            once(spark.createDataFrame([(v,)], "v int"), i)
    assert calls == [0, 2, 4]


def test_a_wave_shuffles_only_what_it_finds(spark):
    """Plan of a crawl's wave: no exchange over answers, links or what was seen."""
    from webloom.checkpointing import counted, laid_out
    from webloom.functions import urls
    from webloom.operators import crawl

    plan_of = lambda df: df._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fp = urls.fingerprint(F.col("url")).alias("fp")
        page = spark.range(200).select(F.concat(F.lit("https://a.com/"), F.col("id")).alias("url"))
        store = laid_out(page.select(fp, F.lit(True).alias("stored"), F.lit(200).alias("status_code"), F.lit(None).cast("string").alias("final_url"), F.lit(None).cast("string").alias("error"), F.lit(0).alias("retries"), F.lit(0.0).alias("wait_s"), F.lit(None).cast("string").alias("response")), "fp")
        links = laid_out(page.select(fp, F.lit(0).cast("bigint").alias("pos"), F.concat("url", F.lit("/next")).alias("link")), "fp")
        wave = laid_out(page.limit(20).select(fp, "url", F.lit(None).cast("string").alias("parent_url"), F.array(F.lit(0).cast("bigint")).alias("key")), "fp")
        rows, n = counted(crawl.fetched(wave, store, 0), rows=F.count(F.lit(1)))
        assert n == {"rows": 20} and "Exchange" not in plan_of(crawl.fetched(wave, store, 0))
        found = crawl.linked(rows, links, [wave.select("fp"), store.select("fp")])
        plan = plan_of(found)
        assert plan.count("Exchange") == 1 and plan.count("SortMergeJoin") == 3 and found.count() == 20
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
