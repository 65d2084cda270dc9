"""Benchmark decontamination: an FM-index per training shard, searched backwards for every test phrase.

A test phrase is a window of 13 consecutive words of a benchmark item (a shorter item is one phrase). A shard is what one
Python task holds at a time. Its documents become one stream of word numbers; a word that no phrase has cannot be inside
an occurrence, so a run of such words becomes one separator, and runs shorter than the shortest phrase are left out. Over
the stream stand a suffix array (prefix doubling), its Burrows-Wheeler transform in a wavelet matrix, and suffix positions
sampled at run starts and every SAMPLE-th place. All phrases whose words all stand in the shard are searched at once from
their last word backwards; each occurrence is located by steps to a sampled position, and its words are marked. Marked words
merge into removal spans.

No shuffle: documents stay in their partition, and the phrases (bounded: BLOCK_BYTES of benchmark text a pass, more
passes beyond it) go to the tasks.

Edge cases: null or empty text has no words (n_words 0, nothing hit, not contaminated); an item without words gives no
phrase; equal items are all reported; a null item_id counts as the empty string; an empty benchmark hits nothing; rows are
independent, so repeated rows get equal results; other columns are not read. With several passes the documents are stored
with row numbers, and what the passes hit is united per row, so results don't depend on the number of passes.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import map_columns, map_slices, slices, stored

N = 13
SAMPLE = 16
BLOCK_BYTES = 16 << 20
SCHEMA = "row bigint, doc_id bigint, n_words bigint, n_hit bigint, item_ids array<string>, word_spans array<struct<start:int,end:int>>, spans array<struct<start:int,end:int>>"

#: Bytes of a word stay (A-Z as a-z), all others become a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


class WaveletMatrix:
    """rank(c, i): how often c is among the first i symbols, for arrays of c and i."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.levels = []
        current = symbols
        for bit in range(max(1, int(n_symbols).bit_length()) - 1, -1, -1):
            ones = (current >> bit) & 1
            before = np.concatenate(([0], np.cumsum(ones)))
            zeros = len(current) - int(before[-1])
            self.levels.append((bit, before, zeros))
            current = np.concatenate((current[ones == 0], current[ones == 1]))

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        lo, hi = np.zeros_like(i), i
        for bit, before, zeros in self.levels:
            one = ((c >> bit) & 1).astype(bool)
            lo1, hi1 = before[lo], before[hi]
            lo, hi = np.where(one, zeros + lo1, lo - lo1), np.where(one, zeros + hi1, hi - hi1)
        return hi - lo


class FMIndex:
    """Over symbols 1.. in runs that 0 ends; every run must be ended, the last one too."""

    def __init__(self, stream: np.ndarray, n_symbols: int):
        n = len(stream)
        ends = stream == 0
        rank = np.where(ends, np.cumsum(ends) - 1, stream + ends.sum()).astype(np.int64)  # each end is a symbol of its own
        step = 1
        while True:
            after = np.zeros(n, np.int64)
            after[: n - step] = rank[step:] + 1 if step < n else 0
            values, new = np.unique(rank * (int(rank.max()) + 2 if n else 1) + after, return_inverse=True)
            rank = new.astype(np.int64)
            if len(values) == n:
                break
            step *= 2
        order = np.empty(n, np.int64)
        order[rank] = np.arange(n)
        self.bwt = stream[order - 1]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(stream, minlength=n_symbols + 1))))
        self.tree = WaveletMatrix(self.bwt, n_symbols)
        self.sampled = (self.bwt == 0) | (order % SAMPLE == 0)
        self.place = np.cumsum(self.sampled) - 1
        self.positions = order[self.sampled]

    def search(self, stream: np.ndarray, ends: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [lo, hi) of the suffixes that start with each phrase, which is stream[end - length : end]."""
        lo, hi = np.zeros(len(ends), np.int64), np.full(len(ends), len(self.bwt), np.int64)
        live, j = np.arange(len(ends)), 0
        while len(live := live[(lengths[live] > j) & (hi[live] > lo[live])]):
            c = stream[ends[live] - 1 - j].astype(np.int64)
            lo[live] = self.first[c] + self.tree.rank(c, lo[live])
            hi[live] = self.first[c] + self.tree.rank(c, hi[live])
            j += 1
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        rows, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.empty(len(rows), np.int64)
        live = np.arange(len(rows))
        while len(live):
            known = self.sampled[rows[live]]
            done = live[known]
            out[done] = self.positions[self.place[rows[done]]] + steps[done]
            live = live[~known]
            c = self.bwt[rows[live]]
            rows[live] = self.first[c] + self.tree.rank(c, rows[live])
            steps[live] += 1
        return out


class Phrases:
    """The windows of a block of benchmark items, and the items that have each.

    The items' words are one stream of word numbers, and a phrase is the place where its first occurrence ends: some 20 bytes
    a word of benchmark text, besides the distinct words."""

    def __init__(self, items: list[tuple[str, str | None]]):
        self.items = [item for item, _ in items]
        self.vocabulary: dict[bytes, int] = {}
        streams, ends, lengths, owners, base = [], [], [], [], 0
        for k, (_, text) in enumerate(items):
            w = words_of(text)
            if not w:
                continue
            n = max(1, len(w) - N + 1)
            streams.append(np.fromiter((self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in w), np.int32, len(w)))
            lengths.append(np.full(n, min(N, len(w)), np.int32))
            ends.append(base + min(N, len(w)) + np.arange(n))
            owners.append(np.full(n, k, np.int32))
            base += len(w)
        empty = np.empty(0, np.int32)
        self.stream = np.concatenate([empty, *streams])
        all_ends, all_lengths, all_owners = (np.concatenate([empty, *x]) for x in (ends, lengths, owners))
        rows = np.zeros((len(all_ends), N + 1), np.int32)  # equal phrases have equal rows
        for j in range(N):
            rows[:, j] = np.where(all_lengths > j, self.stream[all_ends - 1 - j] if len(all_ends) else 0, 0)
        rows[:, N] = all_lengths
        _, first, which = np.unique(np.ascontiguousarray(rows).view(f"V{4 * (N + 1)}").ravel(), return_index=True, return_inverse=True)
        self.ends, self.lengths = all_ends[first].astype(np.int64), all_lengths[first].astype(np.int64)
        pairs = np.unique(np.stack([which.astype(np.int64), all_owners.astype(np.int64)], 1), axis=0)
        self.owners, self.offsets = pairs[:, 1].astype(np.int32), np.searchsorted(pairs[:, 0], np.arange(len(first) + 1))
        self.shortest = int(self.lengths.min()) if len(first) else 0

    def within(self, shard: np.ndarray) -> np.ndarray:
        """The phrases of which all words stand in a shard's stream; no other one can occur there, and most don't."""
        present = np.zeros(len(self.vocabulary) + 1, bool)
        present[shard] = True
        absent = np.concatenate(([0], np.cumsum(~present[self.stream])))
        return np.flatnonzero(absent[self.ends] == absent[self.ends - self.lengths])

    def owners_of(self, phrase: int) -> list[int]:
        return self.owners[self.offsets[phrase] : self.offsets[phrase + 1]].tolist()


def search_shard(texts: list, phrases: Phrases) -> tuple[list[int], dict[int, np.ndarray], dict[int, set[int]]]:
    """Words of each text; for texts with occurrences, the marks of their words and the items found."""
    get, counts = phrases.vocabulary.get, []
    streams, docs, offsets = [], [], []
    for k, text in enumerate(texts):
        w = words_of(text)
        counts.append(len(w))
        if not phrases.shortest or len(w) < phrases.shortest:
            continue
        ids = np.fromiter(map(get, w, repeat(0)), np.int64, len(w))
        edges = np.flatnonzero(np.diff(np.concatenate(([0], ids > 0, [0])).astype(np.int8)))
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            if b - a >= phrases.shortest:
                streams += [ids[a:b], np.zeros(1, np.int64)]
                docs += [k]
                offsets += [a]
    marks: dict[int, np.ndarray] = {}
    items: dict[int, set[int]] = {}
    if not streams:
        return counts, marks, items
    whole = np.concatenate(streams)
    possible = phrases.within(whole)
    if not len(possible):
        return counts, marks, items
    index = FMIndex(whole, len(phrases.vocabulary))
    starts = np.cumsum([0] + [len(s) + 1 for s in streams[::2]])
    lo, hi = index.search(phrases.stream, phrases.ends[possible], phrases.lengths[possible])
    found = np.flatnonzero(hi > lo)
    if not len(found):
        return counts, marks, items
    times = (hi - lo)[found]
    which = np.repeat(possible[found], times)
    rows = np.repeat(lo[found] - np.concatenate(([0], np.cumsum(times)[:-1])), times) + np.arange(times.sum())
    at = index.locate(rows)
    run = np.searchsorted(starts, at, side="right") - 1
    for p, r, pos in zip(which.tolist(), run.tolist(), (at - starts[run]).tolist(), strict=True):
        k, a = docs[r], offsets[r] + pos
        if k not in marks:
            marks[k], items[k] = np.zeros(counts[k] + 1, np.int64), set()
        marks[k][a] += 1
        marks[k][a + phrases.lengths[p]] -= 1
        items[k].update(phrases.owners_of(p))
    return counts, {k: np.cumsum(m[:-1]) > 0 for k, m in marks.items()}, items


def text_spans(text: str, word_spans: list[tuple[int, int]]) -> list[dict]:
    """Code points [start, end) of spans given by words."""
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in re.finditer(rb"[^ ]+", raw.translate(FOLD))]
    size = lambda n: len(raw[:n].decode("utf-8", "surrogatepass"))
    return [{"start": size(at[a][0]), "end": size(at[b - 1][1])} for a, b in word_spans]


def hits(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: words, hit words, items with occurrences, and merged removal spans (words, code points)."""
    docs = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    parts = _phrase_blocks(benchmark, block_bytes)
    if len(parts) == 1:
        return _hits_of_block(docs, parts[0]).drop("row")
    rows = stored(docs.withColumn("row", F.monotonically_increasing_id()), "decontaminate-rows")
    return _united(rows, parts).drop("row")


def _phrase_blocks(benchmark: DataFrame, block_bytes: int) -> list[DataFrame]:
    bench = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string"))
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    return [bench.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).orderBy("item_id", "text") for b in range(blocks)]


def _united(rows: DataFrame, parts: list[DataFrame]) -> DataFrame:
    """Of documents with row numbers: the union of what the blocks hit, by row."""
    out = _hits_of_block(rows, parts[0])
    for p in parts[1:]:
        out = out.unionByName(_hits_of_block(rows, p).where("n_hit > 0"))
    both = F.transform(
        F.arrays_zip("word_spans", "spans"),
        lambda s: F.struct(s["word_spans"]["start"].alias("start"), s["word_spans"]["end"].alias("end"), s["spans"]["start"].alias("from"), s["spans"]["end"].alias("to")),
    )
    merged = out.withColumn("both", both).groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.max("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"),
        _merged("both").alias("both"),
    )
    n_hit = F.aggregate("both", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])
    cut = lambda a, b: F.transform("both", lambda s: F.struct(s[a].alias("start"), s[b].alias("end")))
    return merged.select("row", "doc_id", "n_words", n_hit.alias("n_hit"), "item_ids", cut("start", "end").alias("word_spans"), cut("from", "to").alias("spans"))


def _merged(name: str):
    """Union of the spans of several passes; those that overlap or touch by words are joined, as in one pass."""
    spans = F.array_sort(F.flatten(F.collect_list(name)))
    kind = "array<struct<start:int,end:int,from:int,to:int>>"

    def add(done, s):
        last = F.element_at(done, -1)
        whole = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["from"].alias("from"), F.greatest(last["to"], s["to"]).alias("to"))
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(whole))
        return F.when(F.size(done) == 0, F.array(s)).when(s["start"] <= last["end"], joined).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(spans, F.array().cast(kind), add)


def _hits_of_block(docs: DataFrame, bench: DataFrame) -> DataFrame:
    phrases = docs.sparkSession.sparkContext.broadcast(Phrases([(r[0], r[1]) for r in bench.collect()]))
    if "row" not in docs.columns:
        docs = docs.withColumn("row", F.lit(0).cast("bigint"))

    def make():
        block = phrases.value

        def f(cols):
            counts, marks, items = search_shard(cols["text"], block)
            n = len(counts)
            out = {"row": cols["row"], "doc_id": cols["doc_id"], "n_words": counts, "n_hit": [0] * n, "item_ids": [[]] * n, "word_spans": [[]] * n, "spans": [[]] * n}
            for k, hit in marks.items():
                edges = np.flatnonzero(np.diff(np.concatenate(([0], hit, [0])).astype(np.int8))).tolist()
                by_word = list(zip(edges[::2], edges[1::2], strict=True))
                out["n_hit"][k] = int(hit.sum())
                out["item_ids"][k] = sorted({block.items[i] for i in items[k]})
                out["word_spans"][k] = [{"start": a, "end": b} for a, b in by_word]
                out["spans"][k] = text_spans(cols["text"][k], by_word)
            return out

        return f

    return map_slices(docs, "text", make, SCHEMA)


#: A document is contaminated if at least one word in 20 is hit.
CONTAMINATED = "n_hit > 0 AND 20 * n_hit >= n_words"


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that are not contaminated by what all blocks of phrases hit together, all columns kept."""
    parts = _phrase_blocks(benchmark, block_bytes)
    if len(parts) == 1:
        return _without_hits(docs, docs.sparkSession.sparkContext.broadcast(Phrases([(r[0], r[1]) for r in parts[0].collect()])))
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("rest"))
    rows = stored(numbered, "decontaminate-rows")
    texts = rows.select("row", F.lit(None).cast("bigint").alias("doc_id"), F.col("rest")["text"].cast("string").alias("text"))
    out = rows.join(_united(texts, parts).where(CONTAMINATED).select("row"), "row", "left_anti")
    return out.select([F.col("rest").getField(c).alias(c) for c in docs.columns])


def _without_hits(docs: DataFrame, phrases) -> DataFrame:
    at = docs.columns.index("text")

    def run(batches):
        block = phrases.value
        for batch in batches:
            for part in slices(batch, at):
                counts, marks, _ = search_shard(part.column(at).to_pylist(), block)
                keep = np.ones(len(counts), bool)
                for k, hit in marks.items():
                    keep[k] = 20 * int(hit.sum()) < counts[k]
                yield part.filter(pa.array(keep))

    return map_columns(docs, run)


def query(spark, sf_dir: str) -> DataFrame:
    """op9: hit counts of every document and the digest of the items found."""
    out = hits(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    ids = F.array_sort("item_ids")
    return out.select(
        "doc_id", "n_words", "n_hit", F.size(ids).cast("bigint").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        F.expr(CONTAMINATED).alias("contaminated"),
    )


SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), iw AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS k
  FROM iw, unnest(generate_series(1, greatest(len(w) - 12, 1))) u(i) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM dw, sizes, unnest(generate_series(1, len(w) - n + 1)) u(i)
), hits AS (SELECT DISTINCT doc_id, n, i, item_id FROM places JOIN windows USING (n, k)),
marks AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN marks ON marks.doc_id = dw.doc_id LEFT JOIN found ON found.doc_id = dw.doc_id
"""
