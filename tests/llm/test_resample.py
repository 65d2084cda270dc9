"""Importance resampling: suffix-array features against plain ones, edge cases, ranks."""

import collections
import zlib

import numpy as np
import pytest

from tests.llm.test_edges import CLASH, ROWS, SCHEMA
from webloom.llm import resample
from webloom.llm.decontaminate import words_of

TEXTS = ["The cat sat. The cat sat! the cat", None, "", " .,; ", "one", "a a a a a", "é 中文 é 中文", "cat sat the"]


@pytest.mark.parametrize("ngram", [1, 2, 3, 5])
def test_features_against_plain(ngram):
    counts, buckets = resample.bucket_ids(TEXTS, ngram, 1000)
    for text, n, got in zip(TEXTS, counts, buckets, strict=True):
        w = words_of(text)
        plain = collections.Counter(zlib.crc32(b" ".join(w[i : i + k])) % 1000 for k in range(1, ngram + 1) for i in range(len(w) - k + 1))
        assert n == len(w) and collections.Counter(got.tolist()) == plain


def test_suffix_array_sorts_to_depth():
    ids = np.random.default_rng(1).integers(0, 5, 300)
    for depth in (1, 2, 3, 4):
        order = resample.suffix_array(ids, depth)

        def key(i, depth=depth):
            part = ids[i : i + depth].tolist()
            return part[: part.index(0)] if 0 in part else part

        assert [key(i) for i in order] == sorted(key(i) for i in range(len(ids)))
        has, shared = resample.lcp_lengths(ids, order, depth)
        for at in range(1, len(ids)):
            a, b = key(order[at - 1]), key(order[at])
            assert has[at] == len(b) and shared[at] == next((k for k in range(len(b)) if k >= len(a) or a[k] != b[k]), len(b))


@pytest.fixture(scope="module")
def docs(spark):
    from pyspark.sql import functions as F

    rows = [*ROWS, *[(100 + i, "words of a common text that repeat " * (3 + i % 2), "en", "a", 1) for i in range(40)], (7, "words of a common text that repeat " * 3, "en", "a", 1)]
    return spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(i).alias(c) for i, c in enumerate((*CLASH, "a.b", "rank", "buckets", "part"))]).repartition(3)


def test_edges(spark, docs):
    bench = spark.createDataFrame([("words of another text", 1), (None, 2)], "text string, s int")
    rows = resample.resample(docs, bench).collect()
    assert len(rows) == docs.count()
    long = [r for r in rows if r.n_words >= 20]
    ranks = sorted((r.rank, -r.score, r.doc_id if r.doc_id is not None else 1 << 62) for r in rows if r["rank"])
    assert [r[0] for r in ranks] == list(range(1, len(long) * 25 // 100 + 1))
    assert [r[1:] for r in ranks] == sorted((-r.score, r.doc_id if r.doc_id is not None else 1 << 62) for r in long)[: len(ranks)]
    empty = [r for r in rows if r.doc_id in (2, 3, 6)]
    assert all(r.n_features == r.weight == 0 and r["rank"] is None for r in empty) and len(empty) == 3
    assert resample.resample(docs.limit(0), bench).count() == 0
    assert resample.resample(docs, bench.limit(0)).count() == docs.count()


def test_drawn_keeps_columns(spark, docs):
    bench = spark.createDataFrame([("words of a common text",)], "text string")
    out = resample.drawn(docs, bench, percent=50)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes and out.count() > 0
    assert out.exceptAll(docs).count() == 0


def test_target_like_documents_are_preferred(spark):
    like = [(i, "alpha beta gamma delta " * 6) for i in range(100)]
    other = [(100 + i, "some other words of no use at all " * 4) for i in range(300)]
    docs, bench = spark.createDataFrame(like + other, "doc_id bigint, text string"), spark.createDataFrame([("alpha beta gamma delta " * 3,)] * 5, "text string")
    got = [r.doc_id for r in resample.drawn(docs, bench).collect()]
    assert len(got) == 100 and sum(d < 100 for d in got) > 75  # 25 by chance; the noise leaves some others
