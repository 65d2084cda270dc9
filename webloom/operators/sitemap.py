"""The tree of a crawl's pages: parents, roots, and its text form."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webloom.checkpointing import cut
from webloom.functions import classify


def roots(pages: DataFrame) -> DataFrame:
    """Pages without a parent among the pages."""
    parents = pages.select(F.col("url").alias("parent_url"))
    return pages.where("parent_url IS NULL").unionByName(pages.where("parent_url IS NOT NULL").join(parents, "parent_url", "left_anti").select(*pages.columns))


def children(pages: DataFrame) -> DataFrame:
    """parent_url and its children in order of ord."""
    own = F.array_sort(F.collect_list(F.struct("ord", "url")))
    return pages.where("parent_url IS NOT NULL").groupBy("parent_url").agg(F.transform(own, lambda x: x["url"]).alias("children"))


def text_lines(pages: DataFrame, max_depth: int | None = None) -> DataFrame:
    """path (sort key) and line of every page (url, parent_url, ord, depth, status_code, error, took_ms), as a drawn tree.

    Levels are joined one by one on the parent's url until one is empty, or down to max_depth below the roots if it is given;
    path holds the places from the root on, so sorting by it gives the order. Urls must be unique."""
    tag = classify.display_state(F.col("error"), F.col("status_code"))
    label = F.concat(F.col("url"), F.lit("  [d="), F.col("depth").cast("string"), F.lit(", "), tag, F.lit(", "), F.col("took_ms").cast("string"), F.lit("ms]"))
    nodes = pages.select("url", "parent_url", "ord", label.alias("label"))
    top = roots(nodes)
    end = F.broadcast(top.agg(F.max("ord").alias("end")))  # one row
    top = top.join(end).withColumn("last", F.col("ord") == F.col("end"))
    level = top.select("url", "label", F.array("ord").alias("path"), F.lit("").alias("prefix"), F.when(F.col("last"), "    ").otherwise("│   ").alias("below"))
    level = cut(level)
    own = Window.partitionBy("parent_url")
    ranked = cut(nodes.withColumn("last", F.lead("ord").over(own.orderBy("ord")).isNull()))
    out = level
    for _ in count() if max_depth is None else range(max_depth):
        up = level.select(F.col("url").alias("parent_url"), "path", "below")
        level = ranked.join(up, "parent_url").select(
            "url", "label", F.concat("path", F.array("ord")).alias("path"),
            F.concat("below", F.when(F.col("last"), "└── ").otherwise("├── ")).alias("prefix"),
            F.concat("below", F.when(F.col("last"), "    ").otherwise("│   ")).alias("below"),
        )
        level = cut(level)
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out.select("path", F.concat("prefix", "label").alias("line"))
