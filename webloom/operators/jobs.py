"""Views over job lifecycle events and crawl event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webloom.functions import classify


def latest(events: DataFrame, key: str, seq: list[str], fields: list[str]) -> DataFrame:
    """The newest non-null value of each field per key: an upsert log read as a table."""
    order = F.struct(*seq)
    return events.groupBy(key).agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), order)).alias(f) for f in fields])


def progress(jobs: DataFrame, workers: int) -> DataFrame:
    return jobs.select("*", classify.progress(F.col("done"), F.col("total"), F.col("status"), workers).alias("p")).select(*jobs.columns, "p.*")


def health(jobs: DataFrame) -> DataFrame:
    return jobs.agg(F.count_if(F.col("status") == "running").alias("jobs_active"), F.count(F.lit(1)).alias("jobs_total"))


def recent(events: DataFrame, key: str, ts: list[str], status: str, n: int = 20) -> DataFrame:
    """The n keys first seen last, newest first, with their newest status; an update keeps its place."""
    rows = events.groupBy(key).agg(F.min(F.struct(*ts)).alias("first"), F.max_by(status, F.struct(*ts)).alias(status))
    return rows.orderBy(F.col("first").desc()).limit(n)


def changes(df: DataFrame, key: str, seq: list[str], value: Column) -> DataFrame:
    """Rows whose value differs from the one before."""
    w = Window.partitionBy(key).orderBy(*seq)
    df = df.withColumn("_v", value)
    return df.withColumn("_p", F.lag("_v").over(w)).withColumn("_n", F.row_number().over(w)).where((F.col("_n") == 1) | ~F.col("_v").eqNullSafe(F.col("_p"))).drop("_v", "_p", "_n")


def in_input_order(rows: DataFrame, key: str, idx: str, value: str) -> DataFrame:
    """Results per job as an array in input order, whatever order they were finished in."""
    return rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(idx, value))), lambda x: x[value]).alias("results"))


def results_or_placeholders(requests: DataFrame, results: DataFrame, key: list[str], message: str) -> DataFrame:
    """Every request with its result, or the row that stands for a missing one."""
    rows = requests.join(results, key, "left")
    missing = classify.placeholder(F.col("url"), F.lit(message))
    return rows.withColumn("result", F.coalesce(F.col("result"), missing))


def replay(stats: DataFrame, pages: DataFrame, final: DataFrame) -> DataFrame:
    """What a late subscriber gets: the newest stats, the pages in order, the final event."""
    part = lambda df, n: df.select("job", F.lit(n).alias("part"), "ord", "type", "payload")
    return part(stats, 0).unionByName(part(pages, 1)).unionByName(part(final, 2))


def sse(kind: Column, payload: Column) -> Column:
    """One server-sent event."""
    return F.concat(F.lit("event: "), kind, F.lit("\ndata: "), payload, F.lit("\n\n"))


def limiter_snapshot(states: DataFrame, key: str, seq: list[str], now: Column) -> DataFrame:
    """Newest factor per domain, 1 once its window ended."""
    last = states.groupBy(key).agg(F.max_by(F.struct("factor", "until"), F.struct(*seq)).alias("s"))
    return last.select(key, F.when(now < F.col("s.until"), F.col("s.factor")).otherwise(F.lit(1.0)).alias("factor"))


def cancelled_pages(pages: DataFrame, cancel_ts: Column) -> DataFrame:
    """Pages finished after a cancel become placeholders."""
    late = F.col("finished_ts") > cancel_ts
    return pages.withColumn("status", F.when(late, "cancelled").otherwise("done"))


def timed_out(started: Column, now: Column, limit_s: Column) -> Column:
    return F.coalesce((now - started) > limit_s, F.lit(False))


def past_deadline(jobs: DataFrame, now: Column, limit_s: Column) -> DataFrame:
    """Jobs (status, started, error) whose time is over become failed with error job_timeout; ended ones stay as they are."""
    late = ~classify.is_terminal(F.col("status")) & timed_out(F.col("started"), now, limit_s)
    return jobs.withColumns({"error": F.when(late, "job_timeout").otherwise(F.col("error")), "status": F.when(late, "failed").otherwise(F.col("status"))})


def appended(pages: list[DataFrame]) -> DataFrame:
    """Rows of successive result pages as one table, with the number of their page."""
    out = None
    for n, df in enumerate(pages):
        rows = df.withColumn("result_page", F.lit(n))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out
