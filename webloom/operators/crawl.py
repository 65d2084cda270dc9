"""A crawl over stored pages: breadth-first waves of frontier x page store, deterministic and with explainable counts."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webloom.checkpointing import counted, cut, laid_out
from webloom.functions import classify, html, urls
from webloom.functions.html import FIELDS, Rule
from webloom.operators import frontier
from webloom.operators.scope import Scope, reason
from webloom.settings import Settings

FOLD_WAVES = 8
MISSING, CANCELLED = "page not in store", "cancelled"


@dataclass
class Crawl:
    """ledger: a row per fetched or failed URL; discarded: counts of links that were not queued, by depth and reason; queued:
    URLs left in the frontier when the crawl ended; status: done or cancelled."""

    ledger: DataFrame
    discarded: DataFrame
    queued: int = 0
    status: str = "done"

    def stats(self) -> DataFrame:
        """visited, queued, failed, dedup_skipped, out_of_scope, retries_total as one row."""
        a = self.ledger.agg(
            F.count_if(F.col("error").isNull()).alias("visited"), F.lit(self.queued).cast("bigint").alias("queued"), F.count_if(F.col("error").isNotNull()).alias("failed"),
            F.coalesce(F.sum("retries"), F.lit(0)).cast("bigint").alias("retries_total"),
        )
        n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("bigint")
        seen = F.col("reason") == "seen"
        b = self.discarded.agg(n(seen).alias("dedup_skipped"), n(~seen).alias("out_of_scope"))
        return a.crossJoin(b).select("visited", "queued", "failed", "dedup_skipped", "out_of_scope", "retries_total")


@dataclass(frozen=True)
class Cancel:
    """A cancel request that comes when so many pages have succeeded. workers requests are under way then: a soft cancel lets
    them end, a hard one makes them failed rows; nothing more is dispatched."""

    after_pages: int
    hard: bool = False
    workers: int = 4


def answers(pages: DataFrame, rule: Rule | None = None, scraping: bool = False, quick: bool = False, settings: Settings | None = None) -> DataFrame:
    """What fetching a canonical URL gives in the end: status_code, final_url, error, retries, wait_s, links, response.

    A stored page may have attempt (the attempt it answers, 0 first; the last one answers the later ones too) and retryable.
    An error is tried again if classify.should_retry says so. Links and fields are taken from the html in the scan, so html is
    never shuffled; of several pages for an attempt the one with the smallest digest counts, chosen before the shuffle."""
    cfg, have = settings or Settings(), set(pages.columns)
    col = lambda name, kind, default=None: (F.coalesce(F.col(name).cast(kind), F.lit(default)) if name in have else F.lit(default).cast(kind)).alias(name)
    rows = pages.select(
        urls.canonical(F.col("url")).alias("url"), col("html", "string"), col("status_code", "int"), col("final_url", "string"), col("error", "string"),
        col("attempt", "int", 0), col("retryable", "boolean", False),
    ).where("url IS NOT NULL")
    base = F.coalesce(F.when(F.col("final_url") != "", F.col("final_url")), F.col("url"))
    found = F.transform(html.quick_links(F.col("html")), lambda h: urls.resolve_rooted(h, base)) if quick else html.extract_links(F.col("html"), base)
    kind = FIELDS.simpleString()
    response = F.lit(None).cast(kind)
    if scraping and rule is not None:
        response = html.extractor(rule)(F.when(F.col("html") != "", F.col("html")))
    rows = rows.withColumn("links", found).withColumn("response", response)
    answer = F.struct(
        F.xxhash64("html").alias("digest"), "status_code", "final_url", "error", "retryable", "links",
        F.struct(F.map_entries("response.data").alias("data"), F.col("response.warnings").alias("warnings")).alias("response"),
    )
    one = rows.where(F.col("attempt") <= cfg.max_retries).groupBy("url", "attempt").agg(F.min(answer).alias("a"))
    one = one.groupBy("url").agg(F.array_sort(F.collect_list(F.struct("attempt", "a"))).alias("all"))  # at most max_retries + 1 of them
    again = lambda x, n: x["a"]["error"].isNotNull() & classify.should_retry(x["a"]["retryable"], n + 1, x["a"]["status_code"], cfg.max_retries)
    at = lambda n: F.element_at(F.filter("all", lambda x: (x["attempt"] <= n) | (x["attempt"] == F.col("all")[0]["attempt"])), -1)
    tries = F.transform(F.sequence(F.lit(0), F.lit(cfg.max_retries)), lambda n: F.struct(n.alias("n"), again(at(n), n).alias("again")))
    retries = F.coalesce(F.get(F.filter(tries, lambda t: ~t["again"]), F.lit(0))["n"], F.lit(cfg.max_retries))
    waits = F.aggregate(F.filter(F.sequence(F.lit(0), F.lit(cfg.max_retries)), lambda n: (n > 0) & (n <= F.col("retries"))), F.lit(0.0), lambda s, n: s + classify.backoff(n))
    out = one.select("url", "all", retries.alias("retries")).select("url", "retries", waits.alias("wait_s"), at(F.col("retries"))["a"].alias("a"))
    return out.select(
        "url", "a.status_code", "a.final_url", "a.error", "retries", "wait_s", "a.links",
        F.when(F.lit(scraping), F.struct(F.map_from_entries("a.response.data").alias("data"), F.col("a.response.warnings").alias("warnings"))).alias("response"),
    )


@dataclass(frozen=True)
class Answered:
    """Answers and their links, laid out by the fingerprint of the URL: several crawls of the same pages can share them."""

    store: DataFrame
    links: DataFrame


def answered(pages: DataFrame, rule: Rule | None = None, scraping: bool = False, quick: bool = False, settings: Settings | None = None) -> Answered:
    all_ = cut(answers(pages, rule, scraping, quick, settings))
    fp = urls.fingerprint(F.col("url")).alias("fp")
    store = laid_out(all_.select(fp, F.lit(True).alias("stored"), *[c for c in all_.columns if c not in ("url", "links")]), "fp")
    links = all_.where("error IS NULL").select(fp, "links").select("fp", F.posexplode("links").alias("pos", "link"))
    links = laid_out(links.select("fp", F.col("pos").cast("bigint").alias("pos"), urls.canonical(F.col("link")).alias("link")).where("link IS NOT NULL"), "fp")
    return Answered(store, links)


def crawl(
    pages: DataFrame | Answered, scope: Scope, max_pages: int | None = 500, quick: bool = False, rule: Rule | None = None, scraping: bool = False,
    cancel: Cancel | None = None, settings: Settings | None = None,
) -> Crawl:
    """Breadth first from the seed. A link is first compared with what was seen, then with the scope; the seed is not tested.
    Pages are stored pages, or what answered() made of them (with the rule, scraping, quick and settings given there).

    All tables are laid out by the fingerprint of the URL, and stay so: answers and links from the start, what was seen and the
    frontier wave by wave. A wave joins them where they are; only the links that it finds are shuffled, to be compared with what
    was seen (and with a cap the wave itself, to take turns). Counters are observed while a wave is written. A URL without page is
    a failed row and doesn't count for max_pages. A retry belongs to its wave and shows as retries and wait_s. Without scraping
    (discovery) responses are not kept."""
    if isinstance(pages, DataFrame):
        pages = answered(pages, rule, scraping, quick, settings)
    store, links, spark = pages.store, pages.links, pages.store.sparkSession
    fp = urls.fingerprint(F.col("url")).alias("fp")
    seed = spark.range(1).select(urls.canonical(F.lit(scope.seed)).alias("url"), F.lit(None).cast("string").alias("parent_url"), F.array(F.lit(0).cast("bigint")).alias("key"))
    wave = laid_out(cut(seed).select(fp, "*"), "fp")
    seen = [wave.select("fp")]
    ledger, discarded, visited, queued, status = None, None, 0, 0, "done"
    stop = min((x for x in (max_pages, cancel and cancel.after_pages) if x is not None), default=None)
    n_all, n_good = F.count(F.lit(1)), F.count_if(F.col("error").isNull())
    for depth in range(scope.max_depth + 1):
        rows, n = counted(fetched(wave, store, depth), rows=n_all, good=n_good)
        ended = False
        if stop is not None and n["good"] >= stop - visited:
            taken, m = counted(_up_to(rows, stop - visited), rows=n_all, good=n_good) if stop > visited else (rows.limit(0), {"rows": 0, "good": 0})
            ended = m["rows"] < n["rows"]
            if ended and cancel and stop == cancel.after_pages:
                reached = m["good"]
                (taken, m), status = counted(_drained(rows, taken, cancel), rows=n_all), "cancelled"
                m["good"] = reached
            rows, queued, n = taken, n["rows"] - m["rows"], m
        visited += n["good"]
        out = rows.drop("fp")
        ledger = out if ledger is None else ledger.unionByName(out)
        found = linked(rows, links, seen).withColumn("reason", F.when(~F.col("old"), reason(scope, F.col("url"), F.lit(depth + 1))))
        first, n = counted(found, next=F.count_if(~F.col("old") & F.col("reason").isNull()))
        repeats = first.agg(F.coalesce(F.sum(F.col("n") - F.when(F.col("old"), 0).otherwise(1)), F.lit(0)).alias("n")).select(F.lit("seen").alias("reason"), "n")
        out = repeats.unionByName(first.where("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))).withColumn("depth", F.lit(depth))
        discarded = out if discarded is None else discarded.unionByName(out)
        seen.append(first.where("NOT old").select("fp"))
        if len(seen) > FOLD_WAVES:
            seen = [laid_out(reduce(DataFrame.unionByName, seen), "fp")]
        wave = first.where("NOT old AND reason IS NULL").select("fp", "url", "parent_url", "key")
        if not n["next"] or ended or (stop is not None and visited >= stop):
            if n["next"] and cancel and stop == cancel.after_pages:
                status = "cancelled"
            queued += n["next"]
            break
    return Crawl(ledger, discarded, queued, status)


def fetched(wave: DataFrame, store: DataFrame, depth: int) -> DataFrame:
    """The wave's URLs with what fetching them gives; both are laid out by fp."""
    error = F.when(F.col("stored").isNull(), MISSING).otherwise(F.col("error"))
    return wave.join(store, "fp", "left").select(
        "fp", "url", "parent_url", F.lit(depth).alias("depth"), "key", "status_code", "final_url", classify.status_ok(F.col("status_code")).alias("ok"), error.alias("error"),
        F.coalesce("retries", F.lit(0)).alias("retries"), F.coalesce("wait_s", F.lit(0.0)).alias("wait_s"), "response",
    )


def linked(rows: DataFrame, links: DataFrame, seen: list[DataFrame]) -> DataFrame:
    """fp, key, url, parent_url, n, old: the URLs that the pages of rows link to, once each, and whether they were seen; seen and links are
    laid out by fp, and so is the result."""
    found = rows.where("error IS NULL").select("fp", F.col("url").alias("parent_url"), F.col("key").alias("parent_key")).join(links, "fp")
    found = found.select(F.col("link").alias("url"), "parent_url", F.concat("parent_key", F.array("pos")).alias("key"))
    first = found.groupBy(urls.fingerprint(F.col("url")).alias("fp")).agg(F.min(F.struct("key", "url", "parent_url")).alias("b"), F.count(F.lit(1)).alias("n"))
    marks = [f"old{i}" for i in range(len(seen))]
    for mark, part in zip(marks, seen, strict=True):
        first = first.join(part.withColumn(mark, F.lit(True)), "fp", "left")
    return first.select("fp", "b.key", "b.url", "b.parent_url", "n", F.coalesce(*marks, F.lit(False)).alias("old"))


def _ranked(rows: DataFrame, left: int) -> DataFrame:
    """Rows with turn and first of the round-robin order, without those that their host's first left successes come before.

    The successes are ranked under a limit, which prunes in every task before the shuffle, so a host's window holds no more
    than left successes and the failures between them, even if all of the wave is one host."""
    rows = rows.withColumn("host", urls.host(F.col("url")))
    good = rows.where("error IS NULL").select("host", "key")
    last = good.withColumn("g", F.row_number().over(Window.partitionBy("host").orderBy("key"))).where(F.col("g") <= left)
    last = last.where(F.col("g") == left).select("host", F.col("key").alias("last"))
    return frontier.round_robin(rows.join(last, "host", "left").where("last IS NULL OR key <= last").drop("last"), "host", "key")


def _up_to(rows: DataFrame, left: int) -> DataFrame:
    """Rows in round-robin order up to the one that makes the left-th success (there are so many); failures don't use up the cap."""
    ordered = _ranked(rows, left)
    end = ordered.where("error IS NULL").select("turn", "first").orderBy("turn", "first").limit(left).agg(F.max(F.struct("turn", "first")).alias("e"))
    return ordered.join(F.broadcast(end)).where(F.struct("turn", "first") <= F.col("e")).select(*rows.columns)  # end is one row


def _drained(rows: DataFrame, taken: DataFrame, cancel: Cancel) -> DataFrame:
    """What was taken and the requests under way at a cancel: the next in order, which end or are aborted."""
    rest = rows.join(taken.select("url"), "url", "left_anti")
    under_way = frontier.take_fairly(rest.withColumn("host", urls.host(F.col("url"))), cancel.workers, "host", "key").select(*rows.columns)
    if cancel.hard:
        gone = lambda c: F.lit(None).cast(rows.schema[c].dataType).alias(c)
        changed = {"error": F.lit(CANCELLED).alias("error"), "ok": F.lit(False).alias("ok")} | {c: gone(c) for c in ("status_code", "final_url", "response")}
        under_way = under_way.select(*[changed.get(c, F.col(c)) for c in rows.columns])
    return taken.unionByName(under_way)


def page_store(pages: DataFrame):
    """A lookup over a table of stored pages: urls (a DataFrame with url) -> their pages; see Store."""
    return TableStore(pages)


class Store:
    """Where pages come from. Another source of pages is a class with this one method."""

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """Pages (url as asked for, html, status_code, final_url, error) of the distinct urls in wanted; none for unknown ones."""
        raise TypeError("a store needs a lookup of its own")


class TableStore(Store):
    """Pages of a table, found by canonical URL; of several pages for one URL that with the smallest digest."""

    def __init__(self, pages: DataFrame):
        self.pages = pages

    def lookup(self, wanted: DataFrame) -> DataFrame:
        have = set(self.pages.columns)
        col = lambda name, kind: (F.col(name) if name in have else F.lit(None)).cast(kind).alias(name)
        rows = self.pages.select(urls.canonical(F.col("url")).alias("_c"), col("html", "string"), col("status_code", "int"), col("final_url", "string"), col("error", "string"))
        asked = wanted.select("url", urls.canonical(F.col("url")).alias("_c")).where("_c IS NOT NULL").distinct()
        rows = rows.join(asked.select("_c").distinct(), "_c", "left_semi")  # only pages asked for go on, and with them their html
        best = rows.groupBy("_c").agg(F.min(F.struct(F.xxhash64("html").alias("digest"), "status_code", "final_url", "error", "html")).alias("p"))
        return asked.join(best, "_c").select("url", F.col("_c").alias("canonical"), "p.html", "p.status_code", "p.final_url", "p.error")
