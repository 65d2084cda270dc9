"""JSON bodies as VARIANT: parsed once, then read by as many typed paths as wanted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dotted(path: str) -> str:
    """A dotted path (a.b.0.c; numbers are places in a list) as a VARIANT path."""
    return "$" + "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in path.split(".") if p)


def parsed(body: Column) -> Column:
    """The body as VARIANT; null for null, empty and broken bodies."""
    return F.try_parse_json(F.when(F.trim(body) != "", body))


def with_paths(df: DataFrame, body: str, paths: dict[str, tuple[str, str]]) -> DataFrame:
    """df with a column for each path: name -> (dotted path, type). A missing path, a JSON null and a value that the type can't
    hold are null."""
    rows = df.withColumn("_body", parsed(F.col(body)))
    return rows.withColumns({name: F.try_variant_get("_body", dotted(path), kind) for name, (path, kind) in paths.items()}).drop("_body")
