"""Every operator on nulls, empty and long texts, repeated rows, ties, an empty table and clashing extra columns."""

import hashlib

import pytest
from pyspark.sql import functions as F

from webloom.llm import decontaminate, html_text, jaccard_join, language, licenses, line_dedup, media, mixing, pii, quality

LONG = "the long line of words goes on and on " * 4000
ROWS = [
    (1, "the cat sat on the mat near the door", "en", "a", 10), (2, None, "en", "a", None), (3, "", None, None, 0), (4, LONG, "en", "b", 9),
    (5, "le chat est sur la table dans la cuisine", "fr", None, 1), (5, "le chat est sur la table dans la cuisine", "fr", None, 1),
    (None, "der hund ist im garten und schläft", "de", "b", 2), (None, None, None, None, None), (6, "   \n\t ", "en", "a", 3), (7, "12345 !!! ²", "en", "a", 4),
    (8, "the cat sat on the mat near the door", "en", "", 10),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASH = ("score", "k", "ks", "node", "size", "rest", "t", "x", "base", "found", "position", "gone_id", "text_id", "cluster", "kind", "okey", "spans", "row", "host")


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASH)]).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def bench(spark):
    rows = [(1, "cat sat on the mat", 1), (2, None, 2), (None, "le chat est sur la table", 3), (4, "", 4), (4, "cat sat on the mat", 5)]
    return spark.createDataFrame(rows, "item_id int, text string, n_hit int")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 1), (5, 1, None), (5, 0, 0), (None, 1, 1), (7, None, 0), (8, 1, 0)], "doc_id bigint, quality int, toxic int")


def by_id(df):
    return {r.doc_id: r for r in df.collect() if r.doc_id is not None}


def test_licenses(docs, none):
    assert licenses.license_scan(docs).count() == len(ROWS) and licenses.license_scan(none).count() == 0
    assert by_id(licenses.license_scan(docs))[2].found == []


def test_language(docs, none):
    model = language.fit(docs)
    rows = language.identify(docs, model).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    got = {r.doc_id: r for r in rows}
    assert [got[i].lang_pred for i in (2, 3, 6, 7)] == ["und"] * 4 and got[2].score == 0 and got[3].spans == []
    assert {r.lang_pred for r in language.identify(docs, language.fit(none)).collect()} == {"und"}
    assert language.identify(none, model).count() == 0


def test_mixing(docs, none):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(ROWS) and mixing.mix(none).count() == 0
    assert all(0 <= r.taken <= 2 * r["size"] and (r.position is None) == (r.taken == 0) for r in rows)
    assert sorted(map(tuple, mixing.mix(docs).collect()), key=str) == sorted(map(tuple, rows), key=str)
    assert mixing.mix(docs.where("doc_id in (2, 3)")).agg(F.sum("taken")).first()[0] == 0
    assert mixing.training_order(mixing.mix(docs)).count() == sum(len(r.positions) for r in rows)


def test_jaccard(docs, none):
    rows = jaccard_join.near_duplicates(docs).collect()
    assert len(rows) == len(ROWS)
    got = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert got[8].class_id == got[1].class_id == 1 and got[8].n_copies == 2
    assert got[2].class_id == got[3].class_id == got[6].class_id == 2 and got[2].n_links == 0
    assert got[4].class_id == 4 and got[5].n_copies == 2
    kept = [r.doc_id for r in jaccard_join.keep_one(docs).collect()]
    assert sorted(x for x in kept if x) == [1, 2, 4, 5, 7] and kept.count(None) == 1  # the null text without id is a copy of 2
    assert jaccard_join.near_duplicates(none).count() == 0 and jaccard_join.keep_one(none).count() == 0


def test_jaccard_keeps_one_of_each_class(spark):
    v, w, near = LONG[:300], " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(60))
    rows = [(5, w), (7, w), (5, v), (2, v), (9, near), (9, near + " x"), (None, near), (None, w + " y"), (None, "alone here"), (None, "alone here"), (8, "twice"), (8, "twice")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id bigint, text string, key_id int").repartition(3)
    kept = sorted(((r.doc_id, r.text) for r in jaccard_join.keep_one(df).collect()), key=str)
    assert len(kept) == 5 and sum(k[0] == 9 for k in kept) == 1
    assert [k for k in kept if k[0] != 9] == [(2, v), (5, w), (8, "twice"), (None, "alone here")]
    assert jaccard_join.near_duplicates(df).count() == len(rows)


def test_line_dedup(docs, none):
    index = line_dedup.LineIndex.build(docs)
    rows = index.dedup(docs, ("lang", "score")).collect()
    assert len(rows) == len(ROWS) and all(r.text is not None for r in rows)
    got = {r.doc_id: r for r in rows}
    assert (got[2].n_lines, got[2].n_dropped, got[6].n_lines) == (1, 0, 2) and got[5].rest.lang == "fr"
    assert line_dedup.LineIndex.build(none).dedup(none).count() == 0


def test_line_dedup_counts_documents(spark, monkeypatch):
    """Repeated rows are one holder, and rows without doc_id are none; the same as the SQL, with one block of filters or many."""
    import duckdb

    line = lambda k: f"this line is long enough {k}"
    rows = [(1, line(0)), (8, line(0)), (8, line(0)), (None, line(0)), (1, line(1)), (2, line(1) + "\n" + line(2)), (3, line(1)), (3, line(1)), (None, line(1) + "\nx"), (4, None), (4, "")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id bigint, text string, k int, ks int").repartition(3)
    result = lambda index, d: sorted(((r.doc_id, r.text) for r in index.dedup(d).collect()), key=str)
    want = sorted([(1, line(0)), (8, line(0)), (8, line(0)), (None, line(0)), (1, ""), (2, line(2)), (3, line(1)), (3, line(1)), (None, "x"), (4, ""), (4, "")], key=str)
    documents = df.toPandas()[["doc_id", "text"]]  # noqa: F841
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    digest = sorted((str(None if d != d or d is None else int(d)), n, h) for d, n, h in duckdb.sql(line_dedup.SQL).project("doc_id, n_dropped, kept_sha256").fetchall())
    for block in (32 << 20, 1):
        monkeypatch.setattr(line_dedup, "FILTER_BLOCK_BYTES", block)
        monkeypatch.setattr(line_dedup, "KEYS_PER_SHARD", 1 if block == 1 else 1 << 15)
        index = line_dedup.LineIndex.build(df)
        assert result(index, df) == want
        got = index.dedup(df).select("doc_id", "n_dropped", F.sha2(F.col("text").cast("binary"), 256)).collect()
        assert sorted((str(r[0]), r[1], r[2]) for r in got) == digest
        again = index.insert(df.where("doc_id = 3"))  # it is there already
        assert result(again, df) == want and result(index.insert(df.limit(0)), df) == want


@pytest.mark.parametrize("block", [32 << 20, 1])
def test_line_dedup_of_many_rows_without_id(spark, monkeypatch, block):
    """100,000 rows without doc_id and as many with one and the same, each with common lines: each row meets its own keys only."""
    monkeypatch.setattr(line_dedup, "FILTER_BLOCK_BYTES", block)
    monkeypatch.setattr(line_dedup, "KEYS_PER_SHARD", 8 if block == 1 else 1 << 15)
    common = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda k: F.concat(F.lit("a line that many documents hold "), ((k + F.col("id")) % 40).cast("string")))
    n = 100_000
    ids = F.when(F.col("id") % 2 == 0, F.lit(None)).when(F.col("id") < 20, F.col("id")).otherwise(F.lit(-5))
    docs = spark.range(2 * n).select(ids.cast("bigint").alias("doc_id"), F.concat_ws("\n", common, F.concat(F.lit("own"), F.col("id").cast("string"))).alias("text"), F.col("id").alias("row"))
    index = line_dedup.LineIndex.build(docs)
    holders = [[i for i in range(1, 20, 2) if (j - i) % 40 < 20] for j in range(40)]  # and -5 holds all
    lost = {i: sum(len(holders[(k + i) % 40]) >= 2 for k in range(20)) for i in range(40)}
    out = index.dedup(docs, ("row",)).select("doc_id", F.col("rest.row").alias("row"), "n_lines", "n_dropped")
    got = out.groupBy("doc_id", (F.col("row") % 40).alias("i")).agg(F.count(F.lit(1)).alias("n"), F.min("n_dropped").alias("least"), F.max("n_dropped").alias("most"), F.max("n_lines").alias("lines")).collect()
    assert sum(r.n for r in got) == 2 * n and {r.lines for r in got} == {21}
    assert all(r.least == r.most == lost[r.i] for r in got if r.doc_id is None or r.doc_id == -5)
    keeps = {r.doc_id: r.least for r in got if r.doc_id is not None and r.doc_id > 0}
    assert keeps == {i: sum(len(h := holders[(k + i) % 40]) >= 2 and max(h) != i for k in range(20)) for i in range(1, 20, 2)}


def test_line_filters_grow(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "KEYS_PER_SHARD", 64)
    text = lambda a, b: "\n".join(f"a line that many documents hold {k}" for k in range(a, b))
    few = spark.createDataFrame([(i, text(0, 10)) for i in range(3)], "doc_id bigint, text string")
    many = spark.createDataFrame([(i, text(0, 500)) for i in range(3, 6)], "doc_id bigint, text string")
    index = line_dedup.LineIndex.build(few).insert(many)
    filters = [line_dedup.CuckooFilter(data=bytes(r[0])) for r in index.filters.select("filter").collect()]
    assert index.n_shards >= 5 and not any(f.stash for f in filters)
    everything = few.unionByName(many)
    result = lambda index: sorted(map(tuple, index.dedup(everything).collect()))
    assert result(index) == result(line_dedup.LineIndex.build(everything))


def test_html(spark):
    rows = [(1, None, None), (2, "http://a/", ""), (2, "http://a/", ""), (None, "::bad", "<p>x"), (3, "http://a/", "<p>" + "<b>y</b> " * 50000), (4, "http://a/", "<!-- " + "z" * 99999)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").select("*", F.lit(1).alias("row"), F.lit("q").alias("text"), F.lit(2).alias("outer"))
    out = html_text.extract(pages).collect()
    assert len(out) == 6 and all(r.text is not None for r in out)
    assert {r.page_id: r.text[:4] for r in out} == {1: "", 2: "", None: "x", 3: "y y ", 4: ""}
    assert html_text.extract(pages.limit(0)).count() == 0


def test_media(docs, none):
    rows = media.media_columns(docs).collect()
    assert len(rows) == len(ROWS) and media.media_columns(none).count() == 0
    for r in rows:
        payload = media.from_wav(bytes(r.media))
        assert len(payload) == r.payload_bytes > 0 and len(payload) % 192 == 0 and hashlib.sha256(payload).hexdigest() == r.payload_sha256
    texts = {(r.doc_id, r.payload_sha256, tuple(r.fp_code)) for r in rows if r.doc_id in (1, 8)}
    assert len({x[1:] for x in texts}) == 1


def test_quality(docs, none, labels):
    model = quality.fit(docs, labels)
    rows = quality.score(docs, model).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert quality.fit(docs, labels.limit(0)) is None and {r.score for r in quality.score(docs, None).collect()} == {0.5}
    assert quality.score(none, model).count() == 0 and quality.filter_quality(none, model).count() == 0
    assert quality.filter_quality(docs, model).columns == docs.columns


def test_decontamination(docs, none, bench):
    rows = decontaminate.hits(docs, bench).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(ROWS) and (got[1].n_hit, got[1].item_ids) == (5, ["1", "4"]) and (got[5].n_hit, got[5].item_ids) == (6, [""])
    assert ROWS[0][1][got[1].spans[0].start : got[1].spans[0].end] == "cat sat on the mat" and got[2].n_words == 0
    assert {r.n_hit for r in decontaminate.hits(docs, bench.limit(0)).collect()} == {0} and decontaminate.hits(none, bench).count() == 0
    assert decontaminate.drop_contaminated(docs, bench).count() == len(ROWS) - 4
    assert decontaminate.drop_contaminated(docs, bench.limit(0)).columns == docs.columns


def test_pii(docs, none):
    assert pii.personal_data(docs).count() == len(ROWS) and pii.personal_data(none).count() == 0
    assert by_id(pii.personal_data(docs))[2].spans == []


def test_stored_tables_can_be_dropped(spark):
    from webloom.llm import common

    df = common.stored(spark.range(3).toDF("n"), "some")
    path = df.inputFiles()[0].rsplit("/", 1)[0]
    assert df.count() == 3
    common.drop_stored(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
