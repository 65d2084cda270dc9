"""Distinct counts that can be stored and united: one HyperLogLog sketch a key, united for any choice of keys.

A sketch of 2 ** lg_k buckets has a relative standard error of about 0.8 / sqrt(2 ** lg_k) (1.3 % at 12), and a few kilobytes at most,
whatever it has counted. Sketches are made per task before the shuffle, so a hot key moves one sketch a task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K = 12


def distinct_sketches(df: DataFrame, keys: list[str], value: Column, lg_k: int = LG_K) -> DataFrame:
    """keys, sketch (binary): of the values (not null) of each key; a table to keep and add to."""
    return df.groupBy(*keys).agg(F.hll_sketch_agg(value, F.lit(lg_k)).alias("sketch"))


def united(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """keys, estimate: distinct values of all sketches of a key together, so values that several of them have count once."""
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))


def added(sketches: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """The kept sketches with those of new rows; the old rows aren't read again."""
    return sketches.unionByName(more).groupBy(*keys).agg(F.hll_union_agg("sketch").alias("sketch"))
