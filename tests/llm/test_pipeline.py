"""The pipeline against a plain version of its stages."""

import collections

import corpus_pipeline
from pyspark.sql import functions as F

from tests.llm.test_operators import brute_hits, brute_links, rows_of
from webloom.llm import line_dedup, quality


def test_stages_keep_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        assert stage(spark, docs.limit(0), sf).count() == 0, name


def test_run_against_plain_version(spark, sf):
    rows = rows_of(sf, "select doc_id, text, source from documents order by doc_id")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    texts = {d: t for d, t, _ in rows if model.score(quality.features(t)[None])[0] >= quality.THRESHOLD}
    holders = collections.defaultdict(set)
    for d, t in texts.items():
        for k in line_dedup.line_keys(t):
            if k:
                holders[k].add(d)
    for d, t in texts.items():
        lines = [line for line, k in zip(t.split("\n"), line_dedup.line_keys(t), strict=True) if not k or len(holders[k]) < 3 or d == max(holders[k])]
        texts[d] = "\n".join(lines)
    texts = {d: texts[d] for d, (root, _, _) in brute_links(texts).items() if root == d}
    hit = brute_hits(texts, rows_of(sf, "select item_id, text from benchmark"))
    texts = {d: t for d, t in texts.items() if not hit[d][4]}
    sizes = {d: len([w for w in t.replace("\t", " ").replace("\n", " ").split(" ") if w]) for d, t in texts.items()}
    source, total = {d: s for d, _, s in rows}, collections.Counter()
    for d, n in sizes.items():
        total[source[d]] += n
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert {d: r["size"] for d, r in got.items()} == sizes
    assert all(r.source_size == total[source[d]] for d, r in got.items())
    taken = collections.Counter()
    for d, r in got.items():
        taken[source[d]] += r.taken
    assert all(abs(taken[source[d]] - r.target) <= 1 for d, r in got.items())


def test_stages_on_awkward_rows(spark, sf):
    """One table with nulls in every column, empty and very long texts, repeated ids and rows, ties, many rows without id, and columns
    whose names clash with the operators' own or have a dot."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kind = docs.schema
    nothing = spark.createDataFrame([(None,) * len(kind)] * 3, kind)
    bare = docs.select(*[F.lit(None).cast(f.dataType).alias(f.name) if f.name in ("doc_id", "source", "lang") else F.col(f.name) for f in kind])
    text = lambda t: docs.limit(2).withColumn("text", F.lit(t))
    long = " ".join(f"w{i % 5000}" for i in range(60_000)) + "\n" + "a line that stands in this text many times\n" * 500
    odd = docs.unionByName(docs).unionByName(nothing).unionByName(bare).unionByName(text("")).unionByName(text(" \n\t")).unionByName(text(long))
    clash = ("a.b", "row", "rest", "key_id", "ks", "score", "c0", "node", "k", "size", "position")
    odd = odd.select("*", *[F.lit(i).alias(c) for i, c in enumerate(clash)]).repartition(5)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, sf)
        assert out.columns == odd.columns and out.dtypes == odd.dtypes, name
        got = out.collect()
        assert 0 < len(got) <= odd.count() and {(r["a.b"], r["row"], r["c0"]) for r in got} == {(0, 1, 6)}, name
        odd = corpus_pipeline.stored(out, f"awkward-{name}")
    plan = corpus_pipeline.STAGES[-1][1](spark, odd, sf)
    assert plan.count() == odd.count()
