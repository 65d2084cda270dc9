"""Order and identity of queued URLs: first seen wins, and round-robin over domains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_seen(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The earliest row of each key: one partial aggregate, no window, so a hot key shrinks before the shuffle."""
    rest = [c for c in df.columns if c != key and c not in order]
    best = F.min(F.struct(*order, *rest)).alias("b")
    return df.groupBy(key).agg(best).select(key, *[F.col(f"b.{c}").alias(c) for c in [*order, *rest]])


def unseen(df: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    return df.join(seen.select(key), key, "left_anti")


def already_seen(df: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    return df.join(seen.select(key).distinct(), key, "left_semi")


def ready(df: DataFrame, now: Column) -> DataFrame:
    return df.where(F.coalesce(F.col("next_attempt_at"), F.lit(0.0)) <= now)


def round_robin(df: DataFrame, domain: str, seq: str) -> DataFrame:
    """turn (place within the domain) and first (the domain's first seq): sorted by both, domains take turns."""
    own = Window.partitionBy(domain)
    return df.withColumn("turn", F.row_number().over(own.orderBy(seq))).withColumn("first", F.min(seq).over(own))


def take_fairly(df: DataFrame, n: int, domain: str, seq: str) -> DataFrame:
    """The first n rows in round-robin order. No domain can give more than n, so each is cut before the global sort."""
    turns = round_robin(df, domain, seq).where(F.col("turn") <= n)
    return turns.orderBy("turn", "first").limit(n)


def sizes(df: DataFrame, domain: str) -> DataFrame:
    return df.groupBy(domain).agg(F.count(F.lit(1)).alias("queued"))
