"""The operations a client calls, as functions over DataFrames: scrape, crawl, status, results, events, inventory, health."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import classify
from webloom.functions.html import Rule
from webloom.operators import geo, jobs, pool
from webloom.operators.crawl import Cancel, Crawl, crawl
from webloom.operators.scope import Scope
from webloom.operators.scrape import scrape
from webloom.settings import Settings
from webloom.streaming.events import replay_then_follow


def scrape_pages(requests: DataFrame, pages: DataFrame, rule: Rule | None = None, raw_html: bool = False) -> DataFrame:
    """One response per request (request_id, url)."""
    return scrape(requests, pages, rule, raw_html)


def scrape_page(spark: SparkSession, url: str, pages: DataFrame, rule: Rule | None = None, raw_html: bool = False) -> DataFrame:
    return scrape(spark.createDataFrame([("1", url)], "request_id string, url string"), pages, rule, raw_html)


def create_crawl(
    pages: DataFrame, scope: Scope, settings: Settings | None = None, rule: Rule | None = None, enable_scraping: bool = False, cancel: Cancel | None = None
) -> Crawl:
    """A crawl; without enable_scraping it only discovers, and responses are NULL."""
    cfg = settings or Settings()
    return crawl(pages, scope, cfg.max_pages, rule=rule, scraping=enable_scraping, cancel=cancel, settings=cfg)


def get_job(jobs_table: DataFrame, job_id) -> DataFrame:
    return jobs_table.where(F.col("job") == F.lit(job_id))


def job_status(lifecycle: DataFrame, job_id, settings: Settings | None = None) -> DataFrame:
    """Newest status, total and done of a job's lifecycle events, with progress."""
    rows = jobs.latest(get_job(lifecycle, job_id), "job", ["seq"], ["status", "total", "done"])
    return jobs.progress(rows, (settings or Settings()).workers)


def cancel(jobs_table: DataFrame, job_ids: DataFrame) -> DataFrame:
    """Jobs that a cancel request reaches: those not in a terminal state."""
    return jobs_table.join(job_ids, "job", "left_semi").where(~classify.is_terminal(F.col("status")))


def crawl_events(result: Crawl) -> DataFrame:
    """The event log of a finished crawl: its stats, a page or page_error event for every row, the end."""
    row = result.ledger.select(
        F.struct(F.col("depth").cast("bigint").alias("depth"), "key").alias("ord"), F.when(F.col("error").isNull(), "page").otherwise("page_error").alias("type"),
        F.to_json(F.struct("url", "parent_url", "depth", "status_code", "error")).alias("payload"),
    )
    stats = result.stats().select(F.to_json(F.struct("*")).alias("payload"))
    none = F.struct(F.lit(-1).cast("bigint").alias("depth"), F.array().cast("array<bigint>").alias("key"))
    last = F.struct(F.lit(1 << 40).cast("bigint").alias("depth"), F.array().cast("array<bigint>").alias("key"))
    head = stats.select(none.alias("ord"), F.lit("stats").alias("type"), "payload")
    return head.unionByName(row).unionByName(stats.select(last.alias("ord"), F.lit("done").alias("type"), "payload"))


def subscribe(log: DataFrame, stream: DataFrame, handle, checkpoint: str):
    """A job's events for a subscriber who may come late: those stored (seq, type) once, then each new batch; None once the log has ended."""
    return replay_then_follow(log, stream, handle, checkpoint)


def list_resources(inventory: DataFrame, kind: str) -> DataFrame:
    """Usable resources of a type's category and access tier."""
    rows = pool.available(inventory).where(F.col("category") == classify.category(F.lit(kind)))
    return rows.where(classify.access_allowed(F.lit(kind), F.col("access_type"))) if "access_type" in inventory.columns else rows


def list_countries(spark: SparkSession, path: str | None = None) -> DataFrame:
    return geo.profiles(spark, path).select("country").orderBy("country")


def health(jobs_table: DataFrame) -> DataFrame:
    return jobs.health(jobs_table)
