"""Reversible line dedup: sharded cuckoo filters in front of exact reference-count tables.

A line's key is the line without white space at both ends, A-Z lower-cased; keys of at least MIN_CHARS code points count.
The index has three stored tables: postings (key digest, doc_id; a key once a document), reference counts (key digest,
documents that hold it, largest doc_id), and cuckoo filters (one a shard of keys) of the keys held by at least MIN_DOCS
documents. Inserting documents adds counts and inserts the keys that reach MIN_DOCS; deleting them subtracts, recomputes the
largest doc_id of touched keys from the remaining postings, and deletes the keys that fall below MIN_DOCS from their
filters. So deleting what was inserted restores the former results. A filter has room for GROWTH times KEYS_PER_SHARD keys;
when the shards hold more on average, the filters are built anew from the counts with more shards.

Dedup: a document's keys pass through the filters (sent to the tasks in blocks of at most FILTER_BLOCK_BYTES), the few that pass
are joined with the exact counts, and give the keys that each row loses. Rows are told apart by a number, never by doc_id, so
rows without one, or with the same one, meet only their own keys. With one block of filters, rows of which no line passes are
written where they are, and only the others are stored and shuffled to meet their lost keys. With several blocks all rows are
stored with their keys, each block reads the keys only, and all rows are shuffled once.

A hot line is one row a map task after partial aggregation; in the join with the counts adaptive execution splits it.

Edge cases: null or empty text is one empty line; documents are counted by doc_id, so repeated rows are one holder and get
equal results, and all rows with the largest doc_id keep the line; a row without doc_id is no holder, and loses the lines
that others repeat; a document whose lines all go has text ''; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StructField, StructType

from webloom.llm.common import map_slices, stored

MIN_CHARS, MIN_DOCS = 20, 3
SPACE = b" \t\n\x0b\x0c\r"
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
KEYS_PER_SHARD = 1 << 15
FILTER_BLOCK_BYTES = 32 << 20
SLOTS, KICKS, GROWTH = 4, 200, 1.5


def line_keys(text: str | None) -> list[bytes | None]:
    """For each line its key's digest, or None for keys that are too short."""
    out: list[bytes | None] = []
    for line in (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split(b"\n"):
        key = line.strip(SPACE)
        long = len(key) >= MIN_CHARS and (key.isascii() or len(key.decode("utf-8", "surrogatepass")) >= MIN_CHARS)
        out.append(xxhash.xxh3_128_digest(key) if long else None)
    return out


class CuckooFilter:
    """16-bit fingerprints, 4 a bucket, two buckets a key; what finds no place goes to a stash, so nothing is lost."""

    def __init__(self, n_keys: int = 0, data: bytes | None = None):
        if data is None:
            n = 1 << max(0, (int(n_keys / (SLOTS * 0.85)) + 1 - 1).bit_length())
            self.table, self.stash = np.zeros((n, SLOTS), np.uint16), []
        else:
            n, extra = np.frombuffer(data[:16], np.int64)
            self.table = np.frombuffer(data[16 : 16 + int(n) * SLOTS * 2], np.uint16).reshape(int(n), SLOTS).copy()
            self.stash = [tuple(x) for x in np.frombuffer(data[16 + int(n) * SLOTS * 2 :], np.int64).reshape(int(extra), 2).tolist()]

    def to_bytes(self) -> bytes:
        head = np.array([len(self.table), len(self.stash)], np.int64).tobytes()
        return head + self.table.tobytes() + np.array(self.stash, np.int64).reshape(-1, 2).tobytes()

    @staticmethod
    def parts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash and fingerprint (1 to 65535) of digests given as an array of two 64-bit words."""
        return keys[:, 0], (keys[:, 1] % np.uint64(65535)).astype(np.int64) + 1

    def spots(self, h: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = len(self.table) - 1
        i = (h & np.uint64(mask)).astype(np.int64)
        return i, i ^ ((fp * 0x5BD1E995) & mask)

    def insert(self, keys: np.ndarray) -> None:
        h, fp = self.parts(keys)
        first, second = self.spots(h, fp)
        mask, table = len(self.table) - 1, self.table
        for i, j, f in zip(first.tolist(), second.tolist(), fp.tolist(), strict=True):
            at, value = (i if (table[i] == 0).any() else j), f
            for kick in range(KICKS):
                free = np.flatnonzero(table[at] == 0)
                if len(free):
                    table[at, free[0]] = value
                    break
                slot = (kick * 7 + value) % SLOTS
                value, table[at, slot] = int(table[at, slot]), value
                at ^= (value * 0x5BD1E995) & mask
            else:
                self.stash.append((min(at, at ^ ((value * 0x5BD1E995) & mask)), value))

    def delete(self, keys: np.ndarray) -> None:
        h, fp = self.parts(keys)
        first, second = self.spots(h, fp)
        for i, j, f in zip(first.tolist(), second.tolist(), fp.tolist(), strict=True):
            for at in (i, j):
                found = np.flatnonzero(self.table[at] == f)
                if len(found):
                    self.table[at, found[0]] = 0
                    break
            else:
                self.stash.remove((min(i, j), f))

    def contains(self, keys: np.ndarray) -> np.ndarray:
        h, fp = self.parts(keys)
        i, j = self.spots(h, fp)
        hit = ((self.table[i] == fp[:, None]) | (self.table[j] == fp[:, None])).any(axis=1)
        if self.stash:
            hit |= np.isin(np.minimum(i, j) << 16 | fp, [at << 16 | f for at, f in self.stash])
        return hit


def as_words(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)


class Filters:
    """Cuckoo filters of all shards in one block, for use in a task."""

    def __init__(self, rows: list[tuple[int, bytes]], n_shards: int):
        self.shards, self.n = dict(rows), n_shards
        self.open: dict[int, CuckooFilter] = {}

    def contains(self, digests: list[bytes]) -> np.ndarray:
        keys = as_words(digests)
        out, shard = np.zeros(len(keys), bool), shard_of(keys, self.n)
        order = np.argsort(shard, kind="stable")
        cuts = np.flatnonzero(np.diff(shard[order])) + 1
        for part in np.split(order, cuts) if len(order) else ():
            k = int(shard[part[0]])
            if k not in self.open and k in self.shards:
                self.open[k] = CuckooFilter(data=self.shards[k])
            if k in self.open:
                out[part] = self.open[k].contains(keys[part])
        return out


def shard_of(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys[:, 0] >> np.uint64(32)) % np.uint64(n)).astype(np.int64)


def postings_of(docs: DataFrame) -> DataFrame:
    """k, doc_id: each key once a row."""

    def make():
        def f(cols):
            return {"doc_id": cols["doc_id"], "ks": [list({k for k in line_keys(t) if k}) for t in cols["text"]]}

        return f

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return map_slices(rows, "text", make, "doc_id bigint, ks array<binary>").select(F.explode("ks").alias("k"), "doc_id")


def distinct_postings(docs: DataFrame) -> DataFrame:
    """k, doc_id: each key once a document. Only the postings of ids that several rows have are shuffled for it."""
    postings = postings_of(docs)
    repeated = docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1")
    if repeated.isEmpty():
        return postings
    repeated = stored(repeated.select("doc_id"), "line-repeated")
    return postings.join(repeated, "doc_id", "left_anti").unionByName(postings.join(repeated, "doc_id", "left_semi").distinct()).select("k", "doc_id")


def counts_of(postings: DataFrame) -> DataFrame:
    """Documents that hold a key (rows without doc_id don't count), and the largest of them."""
    return postings.where("doc_id IS NOT NULL").groupBy("k").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc"))


def _with_shard(keys: DataFrame, n_shards: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.column("k")
            yield pa.RecordBatch.from_arrays([pa.array(shard_of(as_words(k.to_pylist()), n_shards), pa.int64()), k, b.column("op")], names=["shard", "k", "op"])

    return keys.select("k", "op").mapInArrow(run, "shard bigint, k binary, op int")


class LineIndex:
    """Postings, exact reference counts and cuckoo filters; insert and delete give a new index."""

    def __init__(self, postings: DataFrame, counts: DataFrame, filters: DataFrame, n_shards: int):
        self.postings, self.counts, self.filters, self.n_shards = postings, counts, filters, n_shards

    @classmethod
    def build(cls, docs: DataFrame) -> LineIndex:
        postings = stored(distinct_postings(docs), "line-postings")
        counts = stored(counts_of(postings), "line-counts")
        filters, n_shards = cls._filled(counts)
        return cls(postings, counts, filters, n_shards)

    @staticmethod
    def _filled(counts: DataFrame) -> tuple[DataFrame, int]:
        """New filters of the keys that MIN_DOCS documents hold, and their number."""
        heavy = counts.where(F.col("n_docs") >= MIN_DOCS)
        n_shards = max(1, -(-heavy.count() // KEYS_PER_SHARD))

        def fill(pdf: pd.DataFrame) -> pd.DataFrame:
            out = CuckooFilter(max(len(pdf), GROWTH * KEYS_PER_SHARD))
            out.insert(as_words(sorted(pdf["k"])))
            return pd.DataFrame({"shard": pdf["shard"].iloc[:1], "filter": [out.to_bytes()]})

        shards = _with_shard(heavy.select("k", F.lit(1).alias("op")), n_shards)
        return stored(shards.groupBy("shard").applyInPandas(fill, "shard bigint, filter binary"), "line-filters"), n_shards

    def _changed(self, postings: DataFrame, counts: DataFrame) -> LineIndex:
        """With new counts; keys that cross MIN_DOCS enter or leave their filter."""
        counts = stored(counts, "line-counts")
        heavy = F.col("n_docs") >= MIN_DOCS
        if counts.where(heavy).count() > GROWTH * KEYS_PER_SHARD * self.n_shards:
            return LineIndex(postings, counts, *self._filled(counts))
        before, now = self.counts.where(heavy).select("k"), counts.where(heavy).select("k")
        moved = now.join(before, "k", "left_anti").withColumn("op", F.lit(1)).unionByName(before.join(now, "k", "left_anti").withColumn("op", F.lit(-1)))

        def apply(old: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
            out = CuckooFilter(data=old["filter"].iloc[0]) if len(old) else CuckooFilter(GROWTH * KEYS_PER_SHARD)
            for op, change in ((-1, out.delete), (1, out.insert)):
                if len(ks := sorted(keys["k"][keys["op"] == op])):
                    change(as_words(ks))
            return pd.DataFrame({"shard": [(old if len(old) else keys)["shard"].iloc[0]], "filter": [out.to_bytes()]})

        filters = self.filters.groupBy("shard").cogroup(_with_shard(moved, self.n_shards).groupBy("shard")).applyInPandas(apply, "shard bigint, filter binary")
        return LineIndex(postings, counts, stored(filters, "line-filters"), self.n_shards)

    def insert(self, docs: DataFrame) -> LineIndex:
        """With more documents; a document that is there already adds only the keys that it didn't have."""
        new = stored(distinct_postings(docs).join(self.postings, ["k", "doc_id"], "left_anti"), "line-postings")
        counts = self.counts.unionByName(counts_of(new)).groupBy("k").agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))
        return self._changed(self.postings.unionByName(new), counts)

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """Without all rows of these doc_ids."""
        ids = doc_ids.select("doc_id").distinct()
        gone = counts_of(self.postings.join(ids, "doc_id", "left_semi")).select("k", F.col("n_docs").alias("n_gone"))
        left = stored(self.postings.join(ids, "doc_id", "left_anti"), "line-postings")
        last = counts_of(left.join(gone, "k", "left_semi")).select("k", F.col("last_doc").alias("last_left"))
        counts = self.counts.join(gone, "k", "left").join(last, "k", "left").select(
            "k", (F.col("n_docs") - F.coalesce("n_gone", F.lit(0))).alias("n_docs"),
            F.when(F.col("n_gone").isNull(), F.col("last_doc")).otherwise(F.col("last_left")).alias("last_doc"),
        ).where("n_docs > 0")
        return self._changed(left, counts)

    def _blocks(self) -> list:
        """Filters in blocks of bounded size: (first shard, last shard, broadcast)."""
        spark = self.filters.sparkSession
        sizes = self.filters.select("shard", F.octet_length("filter").alias("n")).orderBy("shard")
        blocks, size = [], FILTER_BLOCK_BYTES + 1
        for shard, n in ((r[0], r[1]) for r in sizes.toLocalIterator()):
            if size + n > FILTER_BLOCK_BYTES:
                blocks.append([shard, shard])
                size = 0
            blocks[-1][1], size = shard, size + n
        out = []
        for a, b in blocks:
            rows = [(r[0], bytes(r[1])) for r in self.filters.where(F.col("shard").between(a, b)).collect()]
            out.append(spark.sparkContext.broadcast(Filters(rows, self.n_shards)))
        return out

    def dedup(self, docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
        """doc_id, text (kept lines), n_lines, n_dropped, and rest: the columns to carry along, as a struct (else null)."""
        rest = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.lit(None).cast("string")
        docs = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint"), F.col("text").cast("string"), rest.alias("rest"))
        blocks = self._blocks()
        untouched = None
        if len(blocks) <= 1:
            untouched = _kept(_split(docs, blocks, False).drop("row").withColumn("ks", F.array().cast("array<binary>")))
            touched = stored(_split(docs, blocks, True), "line-touched")
            found = touched.select("row", "doc_id", F.explode("ks").alias("k"))
        else:
            touched = stored(_split(docs, None, True), "line-touched")
            keys = touched.select("row", "doc_id", F.explode("ks").alias("k"))
            found = _passing(keys, blocks[0])
            for b in blocks[1:]:
                found = found.unionByName(_passing(keys, b))
        heavy = self.counts.where(F.col("n_docs") >= MIN_DOCS).select("k", "last_doc")
        lost = found.join(heavy, "k").where(~F.col("doc_id").eqNullSafe(F.col("last_doc"))).groupBy("row").agg(F.collect_list("k").alias("ks"))  # a row's own lines
        joined = touched.drop("ks").join(lost, "row", "left").select("doc_id", "text", "rest", F.coalesce("ks", F.array().cast("array<binary>")).alias("ks"))
        joined = _kept(joined)
        return joined if untouched is None else untouched.unionByName(joined)


def _passing(keys: DataFrame, block) -> DataFrame:
    """The rows of keys whose k passes a filter of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = block.value
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(filters.contains(b.column("k").to_pylist())))

    return keys.mapInArrow(run, keys.schema)


def _split(docs: DataFrame, blocks: list | None, touched: bool) -> DataFrame:
    """The documents of which some line passes a filter, with the keys (each once) that pass, or the others without keys; without blocks
    all documents with all their keys."""

    def make():
        filters = blocks[0].value if blocks else None

        def f(cols):
            keys = [list({k for k in line_keys(t) if k}) for t in cols["text"]]
            if blocks is not None:
                owner = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
                flat, passing = [k for ks in keys for k in ks], [[] for _ in keys]
                for at in np.flatnonzero(filters.contains(flat)).tolist() if filters is not None and flat else ():
                    passing[owner[at]].append(flat[at])
                keys = passing
            keep = [i for i, ks in enumerate(keys) if blocks is None or bool(ks) == touched]
            return {c: [values[i] for i in keep] for c, values in cols.items()} | {"ks": [keys[i] for i in keep]}

        return f

    return map_slices(docs, "text", make, StructType([*docs.schema.fields, StructField("ks", ArrayType(BinaryType()))]))


def _kept(rows: DataFrame) -> DataFrame:
    """Drop the lines whose key is in ks."""

    def make():
        def f(cols):
            out = {"doc_id": cols["doc_id"], "rest": cols["rest"], "text": [], "n_lines": [], "n_dropped": []}
            for text, ks in zip(cols["text"], cols["ks"], strict=True):
                text, lost = text or "", set(ks)
                lines = text.split("\n")
                if lost:
                    kept = [line for line, k in zip(lines, line_keys(text), strict=True) if k is None or k not in lost]
                    out["text"].append("\n".join(kept))
                    out["n_dropped"].append(len(lines) - len(kept))
                else:
                    out["text"].append(text)
                    out["n_dropped"].append(0)
                out["n_lines"].append(len(lines))
            return out

        return f

    schema = StructType(rows.select("doc_id", "text", "rest").schema.fields).add("n_lines", "long").add("n_dropped", "long")
    return map_slices(rows, "text", make, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op5: line counts of every document and the digest of what is kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = LineIndex.build(docs).dedup(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (
  SELECT r, doc_id, u.i AS i, u.line AS line,
         translate(regexp_replace(regexp_replace(u.line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT r, doc_id, unnest(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: {'i': i, 'line': x})) AS u
        FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents))
), c AS (
  SELECT k, max(doc_id) AS last_doc FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), m AS (
  SELECT r, l.doc_id, i, line, c.k IS NOT NULL AND l.doc_id IS DISTINCT FROM c.last_doc AS gone FROM l LEFT JOIN c ON l.k = c.k
)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r
"""
