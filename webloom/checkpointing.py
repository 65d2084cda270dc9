"""Cut lineage between the steps of iterative jobs with files that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, one is made for a local master (tests); on a cluster it must be set, since a
    folder of one machine can't be read by the others."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="webloom-"))
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


def stream_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, for a stream's offsets and state."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _eager(df: DataFrame) -> DataFrame:
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def cut(df: DataFrame) -> DataFrame:
    """An eager checkpoint in the shared folder."""
    return _eager(df)


def counted(df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
    """An eager checkpoint that keeps the layout (partitioning and order) of df, so that later joins on its keys need no exchange; and
    metrics over its rows, observed while it is written: they cost no job of their own."""
    spark, seen = df.sparkSession, Observation()
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # a plan that may still change has no layout to keep
    try:
        out = _eager(df.observe(seen, *[m.alias(name) for name, m in metrics.items()]) if metrics else df)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    return out, dict(seen.get) if metrics else {}


def laid_out(df: DataFrame, key: str) -> DataFrame:
    """df cut, dealt out by key to the session's number of shuffle partitions, and sorted by it."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return counted(df.repartition(n, key).sortWithinPartitions(key))[0]
