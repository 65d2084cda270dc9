"""The corpus pipeline: quality classifier, line dedup, n-gram Jaccard join, benchmark decontamination, source mixing.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame; run() writes each result to the
shared folder and reads it again. All stages but the last return the columns of documents. A stage defines nulls, empty
and repeated rows as its operator does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import decontaminate, jaccard_join, line_dedup, mixing, quality
from webloom.llm.common import stored


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.filter_quality(docs, model)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose their repeated lines; a null text becomes an empty one, n_chars is counted anew."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    out = line_dedup.LineIndex.build(docs).dedup(docs, others)
    fresh = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.char_length("text").cast("bigint")}
    return out.select(*[fresh.get(c, F.col("rest")[c] if c in others else None).alias(c) for c in docs.columns])


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return jaccard_join.keep_one(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training plan of what is left: words taken and positions of each document, in training order."""
    plan = mixing.mix(docs)
    return plan.select("doc_id", "size", "source_size", "target", "taken", "position").orderBy(F.col("position").asc_nulls_last(), "doc_id")


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("jaccard", jaccard_stage),
    ("decontaminate", benchmark_stage),
    ("mixing", mixing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
