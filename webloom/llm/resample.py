"""Importance resampling towards a target distribution, on hashed n-grams that word-id suffix arrays enumerate.

1. Features. A task takes a slice of documents (bounded bytes) as one stream of word numbers, documents parted by 0. A
   suffix array over it (prefix doubling until ngram words are sorted) puts equal n-grams next to each other: a run of
   neighbours whose common prefix (LCP) has k words is one k-gram. Its bucket, crc32 modulo n_buckets, is computed once a
   run and scattered back to the places of the run. Each document keeps the bucket ids of all its places.
2. Counts. Buckets are counted per task and summed, for the documents and for the target texts: at most n_buckets rows.
3. Weight. A bucket's gain is the floored 1000-fold log of the ratio of its smoothed shares; a document's weight is the
   floored mean of its places' gains. With Gumbel noise from a hash of doc_id, the highest scores are a draw without
   replacement by exp(weight / 1000).
4. Rank. Documents of min_words or more are range-sorted by (score down, doc_id up) and numbered within their partition;
   partition sizes, summed, give the global rank. No window spans the table.

Edge cases: null and empty texts have no features, weight 0 and no rank (fewer than min_words words); a null doc_id hashes as
the empty string and comes after others at equal score; repeated rows are documents of their own, with ranks of their own;
equal texts have equal weights; an empty table gives an empty result; an empty target makes gains from counts of 0. Other columns
are not read, or carried along in a struct `rest` (keep), so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import pairwise
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm.common import map_slices, stored
from webloom.llm.decontaminate import words_of

N_BUCKETS, NGRAM, PERCENT, MIN_WORDS, SEED = 10_000, 2, 25, 20, 7
#: Bucket ids are stored in two bytes.
MAX_BUCKETS = 1 << 16


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of ids by their first depth (or more) words; 0 parts documents and sorts first."""
    rank, step = ids.astype(np.int64), 1
    while step < depth:
        after = np.zeros(len(rank), np.int64)
        after[:-step] = np.where(rank[:-step] > 0, rank[step:], 0)
        _, rank = np.unique(rank * (int(rank.max()) + 1) + after, return_inverse=True)
        rank = np.where(ids > 0, rank + 1, 0)
        step *= 2
    return np.argsort(rank, kind="stable")


def lcp_lengths(ids: np.ndarray, order: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each suffix in order: words it has (up to depth), and words it shares with the one before (up to depth)."""
    n = len(ids)
    padded = np.concatenate((ids, np.zeros(depth, ids.dtype)))
    has, shared = np.zeros(n, np.int64), np.zeros(n, np.int64)
    alive, same = np.ones(n, bool), np.ones(n, bool)
    for k in range(depth):
        word = padded[order + k]
        alive &= word > 0
        has += alive
        same &= alive & (np.concatenate(([-1], word[:-1])) == word)
        shared += same
    return has, shared


def bucket_ids(texts: Sequence[str | None], ngram: int, n_buckets: int) -> tuple[list[int], list[np.ndarray]]:
    """Per text: its number of words, and the bucket of each place of each length 1 to ngram."""
    numbers: dict[bytes, int] = {}
    streams, counts = [], []
    for text in texts:
        w = words_of(text)
        counts.append(len(w))
        streams += [np.fromiter((numbers.setdefault(x, len(numbers) + 1) for x in w), np.int32, len(w)), np.zeros(1, np.int32)]
    ids = np.concatenate([np.empty(0, np.int32), *streams])
    words = [b"", *numbers]
    if not len(numbers):
        return counts, [np.empty(0, np.uint16) for _ in texts]
    order = suffix_array(ids, ngram)
    has, shared = lcp_lengths(ids, order, ngram)
    heads = np.array([crc32(w) for w in words], np.int64)  # crc32 goes on where a shorter prefix's ended
    prefix = heads[ids]
    found = np.full((ngram, len(ids)), -1, np.int32)
    for k in range(1, ngram + 1):
        at = order[has >= k]
        first = shared[has >= k] < k  # a run's first suffix
        run = np.cumsum(first) - 1
        if k == 1:
            hashes = heads[ids[at[first]]]
        else:
            last = ids[at[first] + k - 1].tolist()
            hashes = np.fromiter((crc32(words[i], crc32(b" ", h)) for i, h in zip(last, prefix[at[first]].tolist(), strict=True)), np.int64, len(last))
        prefix = np.zeros(len(ids), np.int64)
        prefix[at] = hashes[run]
        found[k - 1, at] = (hashes % n_buckets)[run]
    ends = np.cumsum([n + 1 for n in counts])
    out = []
    for a, b in pairwise([0, *ends.tolist()]):
        part = found[:, a:b].ravel()
        out.append(part[part >= 0].astype(np.uint16))
    return counts, out


def featured(docs: DataFrame, ngram: int = NGRAM, n_buckets: int = N_BUCKETS, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, n_words, buckets (two bytes a feature), rest of every row; no shuffle."""
    if n_buckets > MAX_BUCKETS:
        raise ValueError(f"at most {MAX_BUCKETS} buckets")
    rest = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.lit(None).cast("boolean")
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), rest.alias("rest"))

    def make():
        def f(cols):
            counts, buckets = bucket_ids(cols["text"], ngram, n_buckets)
            return {"doc_id": cols["doc_id"], "n_words": counts, "buckets": [b.tobytes() for b in buckets], "rest": cols["rest"]}

        return f

    schema = plain.select("doc_id", F.lit(0).cast("bigint").alias("n_words"), F.lit(b"").alias("buckets"), "rest").schema
    return map_slices(plain, "text", make, schema)


def bucket_counts(features: DataFrame, n_buckets: int = N_BUCKETS) -> DataFrame:
    """bucket, n: features in each bucket that has any; counted per task before the shuffle."""

    def run(batches):
        total = np.zeros(n_buckets, np.int64)
        for b in batches:
            total += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint16), minlength=n_buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    return features.select("buckets").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, n_buckets: int = N_BUCKETS) -> DataFrame:
    """bucket, gain of all n_buckets: floor(1000 ln of target's smoothed share over the source's)."""
    spark = source.sparkSession
    whole = Window.partitionBy()  # n_buckets rows
    total = lambda c: F.sum(c).over(whole)
    every = spark.range(0, n_buckets, 1, 1).withColumnRenamed("id", "bucket")
    both = every.join(source.select("bucket", F.col("n").alias("s")), "bucket", "left").join(target.select("bucket", F.col("n").alias("t")), "bucket", "left")
    both = both.na.fill(0, ["s", "t"]).withColumns({"all_s": total("s"), "all_t": total("t")})
    ratio = ((F.col("t") + 1) * (F.col("all_s") + n_buckets)).cast("double") / ((F.col("s") + 1) * (F.col("all_t") + n_buckets)).cast("double")
    return both.select("bucket", F.floor(1000 * F.log(ratio)).cast("bigint").alias("gain"))


def weighed(features: DataFrame, gain: DataFrame, n_buckets: int = N_BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features, weight, rest; the gains (n_buckets numbers) go to every task."""
    table = np.zeros(n_buckets, np.int64)
    for r in gain.collect():  # n_buckets rows
        table[r.bucket] = r.gain
    held = features.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        g = held.value
        for b in batches:
            sizes, weights = [], []
            for x in b.column("buckets"):
                ids = np.frombuffer(x.as_buffer(), np.uint16)
                sizes.append(len(ids))
                weights.append(int(g[ids].sum()) // len(ids) if len(ids) else 0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_words"), pa.array(sizes, pa.int64()), pa.array(weights, pa.int64()), b.column("rest")], names=["doc_id", "n_words", "n_features", "weight", "rest"])

    schema = features.select("doc_id", "n_words", F.lit(0).cast("bigint").alias("n_features"), F.lit(0).cast("bigint").alias("weight"), "rest").schema
    return features.mapInArrow(run, schema)


def with_noise(rows: DataFrame, seed: int = SEED) -> DataFrame:
    """score: weight plus 1000-fold Gumbel noise from a hash of the seed and doc_id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint")
    return rows.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("bigint"))


def ranked(rows: DataFrame, n_drawn: int) -> DataFrame:
    """rank 1, 2, ... of the n_drawn highest scores, ties to the smaller doc_id; null for the others."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    dealt = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(parts, *order)
    dealt = dealt.withColumn("part", F.spark_partition_id()).sortWithinPartitions(*order)

    def number(batches):
        n = 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.arange(n + 1, n + b.num_rows + 1))], names=[*b.schema.names, "place"])
            n += b.num_rows

    numbered = stored(dealt.mapInArrow(number, dealt.withColumn("place", F.lit(0).cast("bigint")).schema), "resample-order")
    sizes = numbered.groupBy("part").agg(F.count(F.lit(1)).alias("size")).collect()  # one row a partition
    before, starts = 0, []
    for part, size in sorted(map(tuple, sizes)):
        starts.append((part, before))
        before += size
    start = F.broadcast(spark.createDataFrame(starts, "part int, start bigint"))
    place = F.col("start") + F.col("place")
    return numbered.join(start, "part").withColumn("rank", F.when(place <= n_drawn, place)).drop("row", "part", "place", "start")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, ngram: int = NGRAM, n_buckets: int = N_BUCKETS, min_words: int = MIN_WORDS, seed: int = SEED, keep: Sequence[str] = ()
) -> DataFrame:
    """Every row: doc_id, n_features, weight, score, rank (null if not drawn), n_words, rest (the columns of keep).

    floor(percent * N / 100) of the N rows of min_words or more are drawn. target needs a column text."""
    features = stored(featured(docs, ngram, n_buckets, keep), "resample-features")
    wanted = featured(target.select(F.lit(None).alias("doc_id"), "text"), ngram, n_buckets)
    gain = gains(bucket_counts(features, n_buckets), bucket_counts(wanted, n_buckets), n_buckets)
    rows = with_noise(weighed(features, gain, n_buckets), seed)
    enough = F.col("n_words") >= min_words
    n_drawn = percent * features.where(enough).count() // 100
    out = ranked(rows.where(enough), n_drawn).unionByName(rows.where(~enough).withColumn("rank", F.lit(None).cast("bigint")))
    return out.select("doc_id", "n_features", "weight", "score", "rank", "n_words", "rest")


def drawn(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The documents drawn, with all their columns."""
    out = resample(docs, target, keep=docs.columns, **options).where("rank IS NOT NULL")
    return out.select([F.col("rest").getField(c).alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    """op11: weight, score and rank of every document; the benchmark's texts are the target."""
    out = resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = rf"""
WITH dw AS (SELECT doc_id, {_WORDS} AS w FROM documents), bw AS (SELECT {_WORDS} AS w FROM benchmark),
df AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM dw),
bf AS (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM bw),
tbl AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))
), names AS (SELECT DISTINCT f, hex(encode(f)) AS h FROM (SELECT f FROM df UNION ALL SELECT f FROM bf)),
hashed AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(h), 2), lambda i: ('0x' || h[i:i + 1])::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) % 10000 AS b FROM names, tbl
), dn AS (SELECT b, count(*) AS s FROM df JOIN hashed USING (f) GROUP BY b), bn AS (SELECT b, count(*) AS t FROM bf JOIN hashed USING (f) GROUP BY b),
totals AS (SELECT coalesce((SELECT sum(s) FROM dn), 0)::BIGINT AS big_s, coalesce((SELECT sum(t) FROM bn), 0)::BIGINT AS big_t),
gain AS (
  SELECT b, floor(1000 * ln(((coalesce(t, 0) + 1) * (big_s + 10000))::DOUBLE / ((coalesce(s, 0) + 1) * (big_t + 10000))::DOUBLE))::BIGINT AS g
  FROM range(10000) r(b) LEFT JOIN dn USING (b) LEFT JOIN bn USING (b), totals
), sums AS (SELECT doc_id, count(*) AS n, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight FROM df JOIN hashed USING (f) JOIN gain USING (b) GROUP BY doc_id),
scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || sha256('7:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM dw LEFT JOIN sums USING (doc_id)
), places AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 25 * n // 100 THEN place END AS rank FROM scored LEFT JOIN places USING (doc_id)
"""
