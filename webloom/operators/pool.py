"""Choice of a resource from an inventory, and what to do when one fails."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webloom.functions import classify

ROTATING = ("res_rotating", "residential_rotating", "rotating")


def available(inventory: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Usable rows of (id, category, url, status, expired, seq), without the excluded ids."""
    rows = inventory.where(classify.usable(F.col("url"), F.col("status"), F.col("expired")))
    return rows if excluded is None else rows.join(excluded.select("id"), "id", "left_anti")


def select(requests: DataFrame, inventory: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """For each request (request_id, category, pin): the pinned resource if it is available, else the first; NULL if none.

    The first of a category and the pins are two small keyed lookups, so a request never meets a whole category."""
    free = available(inventory, excluded)
    first = free.groupBy("category").agg(F.min_by("id", "seq").alias("first_id"))
    pins = free.select(F.col("id").alias("pin"), "category", F.lit(True).alias("found"))
    rows = requests.join(pins, ["category", "pin"], "left").join(first, "category", "left")
    return rows.select("request_id", "category", F.when(F.col("found"), F.col("pin")).otherwise(F.col("first_id")).alias("id"))


def diagnostics(inventory: DataFrame, excluded: DataFrame) -> DataFrame:
    ok = classify.usable(F.col("url"), F.col("status"), F.col("expired"))
    rows = inventory.join(excluded.select("id", F.lit(True).alias("out")), "id", "left")
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("ok"), F.count_if(F.coalesce("out", F.lit(False))).alias("excluded"))


def attempts_result(df: DataFrame, key: str, max_attempts: int) -> DataFrame:
    """Of attempts (attempt, ok, failure: resource failure, has_resource): the last one made and retries (its index if it failed).

    The loop ends at the first success, other failure, lack of a resource, or max_attempts."""
    df = df.where(F.col("attempt") < max_attempts)
    stop = F.col("ok") | ~F.col("failure") | ~F.col("has_resource")
    w = Window.partitionBy(key)
    df = df.withColumn("stop", F.coalesce(F.min(F.when(stop, F.col("attempt"))).over(w), F.max("attempt").over(w)))
    rows = df.where(F.col("attempt") <= F.col("stop"))
    failed = F.max(F.when(~F.col("ok") & F.col("failure"), F.col("attempt")))
    return rows.groupBy(key).agg(F.max_by("ok", "attempt").alias("ok"), F.max("attempt").alias("last_attempt"), F.coalesce(failed, F.lit(0)).alias("retries"))


def recovery_steps(failures: DataFrame, inventory: DataFrame) -> DataFrame:
    """job, type, step, id: the resource in use at the start (step 0) and after each of a job's failures (job, seq, type, change_works).

    A rotating type picks again with nothing excluded, so it stays with the first. Others exclude the current resource and take the
    next in order, but a dedicated mobile one with a working change link keeps it. So the place in the category's order is the
    number of resources given up, a running sum; id is NULL when none is left."""
    usable = inventory.where(classify.usable(F.col("url"), F.col("status"), F.col("expired")))
    order = usable.select("category", "id", (F.row_number().over(Window.partitionBy("category").orderBy("seq", "id")) - 1).alias("place"))
    log = Window.partitionBy("job", "type").orderBy("seq", "change_works")
    kept = F.col("type").isin(*ROTATING) | (F.col("type").isin("mobile", "lte") & F.coalesce("change_works", F.lit(False)))
    steps = failures.withColumn("step", F.row_number().over(log)).withColumn("place", F.sum(F.when(kept, 0).otherwise(1)).over(log.rowsBetween(Window.unboundedPreceding, 0)))
    steps = steps.select("job", "type", "step", "place").unionByName(failures.select("job", "type", F.lit(0).alias("step"), F.lit(0).alias("place")).distinct())
    steps = steps.withColumn("category", classify.category(F.col("type"))).join(order.select("category").distinct(), "category", "left_semi")
    return steps.join(order, ["category", "place"], "left").select("job", "type", "step", "id")


def recover(failures: DataFrame, inventory: DataFrame) -> DataFrame:
    """job, type, path: the resources of recovery_steps as a list, for jobs with few failures."""
    path = F.array_sort(F.collect_list(F.struct("step", "id")))
    return recovery_steps(failures, inventory).groupBy("job", "type").agg(F.transform(path, lambda x: x["id"]).alias("path"))
