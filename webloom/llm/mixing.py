"""Mixing sources to target weights along a time-varying curriculum, in DataFrame operations only.

Sources are ranked by code point (null last) and weigh WEIGHTS, repeating. A budget of 150% of all words is shared by
weight; a source's target stops at CAP times its size and the excess is shared among the others: with level L, target =
min(CAP * size, L * weight), and L follows from prefix sums over the sources in order of CAP * size / weight.

Each source has a weight schedule over training time t in [0, 1]: target * (1 + a * (2t - 1)), a from SLOPES, repeating.
Its integral is the source's cumulative demand D(t) = target * (t + a * (t * t - t)), D(1) = target. The source's
documents, in a fixed pseudo-random order and repeated up to CAP times, form a stream of words; the copy that begins at
word c is needed when D(t) = c, so its training position is the inverse of D at c. The copy at the end of a target is cut
there, so a source takes its target to the word. Documents are range-sorted by their first position.

The running sum over a source is taken in two steps, so no source has to fit into a task: sums of (source, bucket) cells,
where the bucket is a range of the order key and there are about sqrt(rows) buckets, then a window inside each cell.

Edge cases: null text has size 0 and is never taken (position null, sorted last); a null source is a source of its own;
a source without words has target 0; rows without doc_id are ordered by their texts; repeated rows are separate
documents side by side in the order; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WEIGHTS = (3, 1, 2)
SLOPES = (0.5, 0.0, -0.5)
BUDGET, CAP = 1.5, 2
KEY_BITS = 60
WORD = r"[^\x20\x09-\x0D]+"


def _pick(values, rank):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (rank % len(values) + 1).cast("int"))


def mix(docs: DataFrame, weights=WEIGHTS, slopes=SLOPES, budget: float = BUDGET, cap: int = CAP) -> DataFrame:
    """One row per document: size, source_size, target (its source's), taken, position (of its first copy), positions."""
    n_buckets = max(1, math.isqrt(docs.count()))
    width = -(-(1 << KEY_BITS) // n_buckets)
    order_text = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("t"), F.col("text").cast("string")), F.lit(""))
    sized = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.concat(F.lit("a"), F.col("source").cast("string")), F.lit("b")).alias("skey"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        F.conv(F.substring(F.md5(order_text.cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("bigint").alias("okey"),
    ).withColumn("bucket", F.expr(f"okey div {width}L"))

    cells = sized.groupBy("skey", "bucket").agg(F.sum("size").alias("cell"))
    along = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("cell").over(along), F.lit(0).cast("bigint")))
    targets = source_targets(cells.groupBy("skey").agg(F.sum("cell").alias("source_size")), weights, slopes, budget, cap)
    cells = cells.join(targets, "skey").drop("cell")

    inside = Window.partitionBy("skey", "bucket").orderBy("okey", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = sized.join(cells, ["skey", "bucket"]).withColumn("start", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0).cast("bigint")))
    whole = F.floor("target").cast("bigint")
    begins = [F.col("start") + k * F.col("source_size") for k in range(cap)]
    words = [F.least(F.greatest(whole - b, F.lit(0)), F.col("size")) for b in begins]
    taken = words[0]
    for w in words[1:]:
        taken = taken + w
    positions = F.array_compact(F.array(*[F.when(w > 0, _inverse(b)) for b, w in zip(begins, words, strict=True)]))
    return rows.select(
        "doc_id", "size", "source_size", "target", taken.cast("bigint").alias("taken"), positions.alias("positions"),
        F.get(positions, F.lit(0)).alias("position"),
    )


def source_targets(sources: DataFrame, weights, slopes, budget: float, cap: int) -> DataFrame:
    """Targets of all sources; the windows run over one row a source in one task, which is meant for up to millions of sources."""
    rank = F.row_number().over(Window.orderBy("skey")) - 1
    s = sources.withColumn("rank", rank).withColumn("weight", _pick([int(w) for w in weights], F.col("rank")))
    s = s.withColumn("slope", _pick([float(x) for x in slopes], F.col("rank"))).withColumn("most", (F.col("source_size") * cap).cast("double"))
    everything = Window.partitionBy()
    filling = Window.orderBy(F.col("most") / F.col("weight"), "skey").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("filled", F.coalesce(F.sum("most").over(filling), F.lit(0.0)))
    s = s.withColumn("left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(filling), F.lit(0)))
    s = s.withColumn("level", (F.sum("source_size").over(everything) * budget - F.col("filled")) / F.col("left"))
    level = F.max("level").over(everything)
    return s.select("skey", "source_size", "slope", F.least(F.col("most"), level * F.col("weight")).alias("target"))


def _inverse(words):
    """The time at which the source's cumulative demand reaches so many words."""
    y, a = words.cast("double") / F.col("target"), F.col("slope")
    b = F.lit(1.0) - a
    root = F.sqrt(b * b + F.lit(4.0) * a * y)
    return F.when(a == 0, y).otherwise((root - b) / (F.lit(2.0) * a))


def training_order(plan: DataFrame) -> DataFrame:
    """Copies in training order: doc_id, copy, position; sorted within and across partitions."""
    return plan.select("doc_id", F.posexplode("positions").alias("copy", "at")).select("doc_id", "copy", F.col("at").alias("position")).orderBy("position", "doc_id", "copy")


def query(spark, sf_dir: str) -> DataFrame:
    """op3: the mix of all documents, in order of first position."""
    plan = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "position").orderBy(F.col("position").asc_nulls_last(), "doc_id")


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce('a' || source, 'b') AS skey,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 't' || text, '')), 1, 15))::BIGINT AS okey
  FROM documents
), s0 AS (
  SELECT skey, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY skey) - 1 AS rank FROM d GROUP BY skey
), s1 AS (
  SELECT *, [3, 1, 2][rank % 3 + 1] AS weight, [0.5::DOUBLE, 0.0::DOUBLE, -0.5::DOUBLE][rank % 3 + 1] AS slope,
         (2 * source_size)::DOUBLE AS most FROM s0
), s2 AS (
  SELECT *, coalesce(sum(most) OVER f, 0.0::DOUBLE) AS filled,
         (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0))::DOUBLE AS remaining,
         (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget
  FROM s1 WINDOW f AS (ORDER BY most / weight, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), s3 AS (
  SELECT skey, source_size, slope, least(most, max((budget - filled) / remaining) OVER () * weight) AS target FROM s2
), r AS (
  SELECT doc_id, size, s3.source_size, target, slope,
         coalesce(sum(size) OVER (PARTITION BY skey ORDER BY okey, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN s3 USING (skey)
), t AS (
  SELECT *, least(greatest(floor(target)::BIGINT - start, 0), size) AS t1,
         least(greatest(floor(target)::BIGINT - start - source_size, 0), size) AS t2, start::DOUBLE / target AS y
  FROM r
)
SELECT doc_id, size, source_size, target, (t1 + t2)::BIGINT AS taken,
       CASE WHEN t1 > 0 THEN CASE WHEN slope = 0 THEN y ELSE
         (sqrt((1.0::DOUBLE - slope) * (1.0::DOUBLE - slope) + 4.0::DOUBLE * slope * y) - (1.0::DOUBLE - slope)) / (2.0::DOUBLE * slope) END END AS position
FROM t
"""
