"""Scrape requests answered from a page store: one left join, classification, extraction, and a response row for each request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions import classify, html
from webloom.functions.html import Rule
from webloom.operators.crawl import MISSING, Store, TableStore


def scrape(requests: DataFrame, pages: DataFrame | Store, rule: Rule | None = None, raw_html: bool = False) -> DataFrame:
    """request_id, url, final_url, status_code, ok, data (if a rule is given), raw_html (if asked for), warnings.

    pages is a table or a Store. html is dropped from the plan unless asked for. A missing page, an error and a block page are
    rows too."""
    store = pages if isinstance(pages, Store) else TableStore(pages)
    found = store.lookup(requests.select("url")).withColumn("stored", F.lit(True))
    found = found.withColumn("_block", classify.fetch_error(F.col("html")))
    if rule is not None:
        found = found.withColumn("_x", html.extract(F.when(F.col("html") != "", F.col("html")), rule))
    found = found if raw_html else found.drop("html")
    out = requests.select("request_id", "url").join(found, "url", "left")
    have = F.col("stored")
    out = out.withColumn("_e", F.when(have.isNull(), MISSING).otherwise(F.coalesce(F.col("error"), F.col("_block")))).withColumn("ok", F.col("_e").isNull())
    warnings = classify.soft_warnings(F.col("_e"), F.when(~classify.status_ok(F.col("status_code")), F.col("status_code")))
    columns = ["request_id", "url", F.coalesce(F.when(F.col("final_url") != "", F.col("final_url")), F.col("canonical")).alias("final_url"), "status_code", "ok"]
    if rule is not None:
        columns.append(F.col("_x").dropFields("warnings").alias("data"))
        warnings = F.concat(warnings, F.coalesce(F.col("_x.warnings"), F.array().cast("array<string>")))
    if raw_html:
        columns.append(F.col("html").alias("raw_html"))
    return out.select(*columns, warnings.alias("warnings"))


def first_result(jobs: DataFrame, key: str = "job") -> DataFrame:
    """key, result (the first of results), and for empty or missing results an error that may be tried again."""
    first = F.get("results", F.lit(0))
    return jobs.select(key, first.alias("result"), F.when(first.isNull(), "empty result").alias("error"), first.isNull().alias("retryable"))


def merged_options(base: Column, over: Column) -> Column:
    """Maps merged, the second one's entries win."""
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.array_contains(F.map_keys(over), k)), over)


def matched_results(tasks: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Results of known tasks; others are dropped."""
    return tasks.join(results, key)
