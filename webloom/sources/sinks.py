"""Writers: JSON, CSV with a fixed header, html text, decoded images, server-sent events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.operators.jobs import sse

RESULT_COLUMNS = ("url", "status_code", "success", "title", "error")


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_csv(df: DataFrame, path: str, columns: tuple[str, ...] = RESULT_COLUMNS) -> None:
    """All rows have the same columns, whatever their kind; missing ones are empty."""
    have = set(df.columns)
    df.select(*[(F.col(c) if c in have else F.lit(None)).cast("string").alias(c) for c in columns]).write.option("header", True).csv(path)


def write_html(df: DataFrame, path: str, column: str = "html") -> None:
    df.select(F.col(column).alias("value")).write.option("lineSep", "\n").text(path)


def decoded_images(df: DataFrame, column: str = "screenshot_base64") -> DataFrame:
    return df.withColumn("image", F.unbase64(F.col(column))).drop(column)


def event_text(df: DataFrame) -> DataFrame:
    return df.select(sse(F.col("type"), F.col("payload")).alias("value"))
