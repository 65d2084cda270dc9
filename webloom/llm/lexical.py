"""Ranked lexical search: the k best documents for each query, by inverted treaps with exact pruning.

1. Statistics. One pass counts documents with terms (N), their terms (L) and, for the terms that queries hold, the documents
   holding each (df): counted per task, then summed.
2. Inverted treaps. A task gathers documents into a shard (SHARD_DOCS, SHARD_POSTINGS), orders them by doc_id and builds for
   each query term a treap of its postings: search order is the document's place, heap order its impact (ties broken by a
   hash of the place, which keeps the treaps flat).
3. Search. Per query all its terms' treaps are traversed together, best bound first. A state is a range of documents with
   each term's subtree root inside it; its bound is the sum of weight times impact of these roots. A state whose bound is
   below the k-th best score so far is pruned with all its subtrees. Else the document of the root that contributes most is
   scored and splits the range; ranges of at most LEAF postings are scored whole. The k-th best score goes on from
   shard to shard of a task.
4. Merge. Each task gives at most k documents a query; they meet per query in two steps (salted, then whole).

Documents are not shuffled; the queries' text goes to the tasks in blocks of at most BLOCK_BYTES (more passes beyond it).

Edge cases: null and empty texts have no terms and aren't counted in N; a query without terms has no rows; each row of
queries is a query of its own, also with repeated or null ids; documents of equal score go by ascending doc_id, null last, and
repeated rows are ranked as documents of their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm.common import slices
from webloom.llm.decontaminate import words_of

TOP = 20
#: Length share of the impact in percent, and its saturation in hundredths.
LENGTH_PERCENT, SATURATION = 25, 12
BLOCK_BYTES = 16 << 20
SHARD_DOCS, SHARD_POSTINGS = 1 << 16, 1 << 22
LEAF = 4096
SALTS = 32
#: Stands for a null doc_id in comparisons: after all others.
LAST = 1 << 63


class Queries:
    """A block of queries: the numbers of their terms, and each query's distinct terms with their repeats."""

    def __init__(self, texts: Sequence[str | None]):
        self.vocabulary: dict[bytes, int] = {}
        self.terms, self.repeats = [], []
        for text in texts:
            w = words_of(text)
            ids = np.fromiter((self.vocabulary.setdefault(x, len(self.vocabulary)) for x in w), np.int64, len(w))
            terms, repeats = np.unique(ids, return_counts=True)
            self.terms.append(terms)
            self.repeats.append(repeats)


def postings_of(texts: Sequence[str | None], vocabulary: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of each text, and its postings among the vocabulary: place of the text, term, occurrences (by place, term)."""
    get, sizes, found, places = vocabulary.get, [], [], []
    for k, text in enumerate(texts):
        w = words_of(text)
        sizes.append(len(w))
        ids = np.fromiter(map(get, w, repeat(-1)), np.int64, len(w))
        ids, times = np.unique(ids[ids >= 0], return_counts=True)
        found.append(np.stack((ids, times)))
        places.append(np.full(len(ids), k, np.int64))
    both = np.concatenate([np.empty((2, 0), np.int64), *found], axis=1)
    return np.array(sizes, np.int64), np.concatenate([np.empty(0, np.int64), *places]), both[0], both[1]


def cartesian(heap: list[int], starts: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """left, right child of each posting and root of each term's treap; -1 for none. starts: each term's first posting, and the end."""
    left, right, roots = [-1] * len(heap), [-1] * len(heap), []
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        spine: list[int] = []
        for i in range(a, b):
            below, v = -1, heap[i]
            while spine and heap[spine[-1]] < v:
                below = spine.pop()
            left[i] = below
            if spine:
                right[spine[-1]] = i
            spine.append(i)
        roots.append(spine[0] if spine else -1)
    return np.array(left, np.int64), np.array(right, np.int64), np.array(roots, np.int64)


class Shard:
    """Inverted treaps of all terms of a vocabulary over some documents, in order of doc_id."""

    def __init__(self, doc_ids: list[int], place: np.ndarray, term: np.ndarray, impact: np.ndarray, n_terms: int):
        order = sorted(range(len(doc_ids)), key=doc_ids.__getitem__)
        self.doc_ids = [doc_ids[i] for i in order]
        moved = np.empty(len(doc_ids), np.int64)
        moved[order] = np.arange(len(doc_ids))
        place = moved[place]
        by = np.lexsort((place, term))
        self.doc, self.impact = place[by], impact[by]
        self.n_docs, self.n_terms = len(doc_ids), n_terms
        self.start = np.searchsorted(term[by], np.arange(n_terms + 1))
        self.key = term[by] * self.n_docs + self.doc  # ascending: finds a term's posting of a document
        priority = (self.doc * 0x9E3779B1) & 0xFFFFF
        self.left, self.right, self.root = cartesian(((self.impact << 20) | priority).tolist(), self.start.tolist())

    def _descend(self, node: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The highest posting in [lo, hi) on the way down from each node: the root of the treap of that range."""
        node = np.where(hi > lo, node, -1)
        while True:
            before, after = (node >= 0) & (node < lo), node >= hi
            if not (before.any() or after.any()):
                return node
            node = np.where(before, self.right[node], np.where(after, self.left[node], node))

    def search(self, terms: np.ndarray, weights: np.ndarray, best: list[tuple[int, int]], k: int, leaf: int = LEAF) -> int:
        """Add this shard's documents to best, a heap of at most k (score, -doc_id); returns the number of states looked at."""
        here = self.start[terms + 1] > self.start[terms]
        terms, weights = terms[here], weights[here]
        if not len(terms):
            return 0
        lo, hi, node = self.start[terms], self.start[terms + 1], self.root[terms]
        bound = lambda n: int((weights * np.where(n >= 0, self.impact[n], 0)).sum())
        queue = [(-bound(node), 0, lo, hi, node)]
        made, seen = 1, 0
        while queue:
            top, _, lo, hi, node = heapq.heappop(queue)
            if len(best) == k and -top < best[0][0]:
                break  # the other states' bounds are no higher
            seen += 1
            if (hi - lo).sum() <= leaf:
                self._score_all(lo, hi, weights, best, k)
                continue
            live = node >= 0
            gain = np.where(live, weights * self.impact[node], -1)
            d = self.doc[node[int(gain.argmax())]]
            at = np.clip(np.searchsorted(self.key, terms * self.n_docs + d), lo, hi)
            has = (at < hi) & (self.doc[np.minimum(at, len(self.doc) - 1)] == d)
            offer(best, k, int((weights * self.impact[np.minimum(at, len(self.doc) - 1)])[has].sum()), self.doc_ids[d])
            for a, b in ((lo, at), (at + has, hi)):
                child = self._descend(node, a, b)
                most = bound(child)
                if most and not (len(best) == k and most < best[0][0]):
                    heapq.heappush(queue, (-most, made, a, b, child))
                    made += 1
        return seen

    def _score_all(self, lo: np.ndarray, hi: np.ndarray, weights: np.ndarray, best: list, k: int) -> None:
        n = hi - lo
        at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        docs, where = np.unique(self.doc[at], return_inverse=True)
        scores = np.zeros(len(docs), np.int64)
        np.add.at(scores, where, np.repeat(weights, n) * self.impact[at])
        if len(docs) > k:
            least = max(np.partition(scores, len(scores) - k)[len(scores) - k], best[0][0] if len(best) == k else 0)
            docs, scores = docs[scores >= least], scores[scores >= least]
        for d, s in zip(docs.tolist(), scores.tolist(), strict=True):
            offer(best, k, s, self.doc_ids[d])


def offer(best: list[tuple[int, int]], k: int, score: int, doc_id: int) -> None:
    if score <= 0:
        return
    if len(best) < k:
        heapq.heappush(best, (score, -doc_id))
    elif (score, -doc_id) > best[0]:
        heapq.heapreplace(best, (score, -doc_id))


def impacts(times: np.ndarray, size: np.ndarray, n_docs: int, n_words: int) -> np.ndarray:
    """Saturating term frequency of postings in documents of these sizes, in millionths at most."""
    m = 100 - LENGTH_PERCENT + LENGTH_PERCENT * size * n_docs // n_words
    return (1_000_000_000 * times) // (1000 * times + SATURATION * m)


def statistics(docs: DataFrame, queries) -> tuple[int, int, np.ndarray]:
    """Documents with terms, their terms, and the documents holding each term of the (broadcast) queries."""

    def run(batches):
        block = queries.value
        total = np.zeros(len(block.vocabulary) + 2, np.int64)
        for batch in batches:
            for part in slices(batch, 1):
                sizes, _, term, _ = postings_of(part.column(1).to_pylist(), block.vocabulary)
                total[:-2] += np.bincount(term, minlength=len(block.vocabulary))
                total[-2:] += (int((sizes > 0).sum()), int(sizes.sum()))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["k", "n"])

    total = np.zeros(len(queries.value.vocabulary) + 2, np.int64)
    for r in docs.mapInArrow(run, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).collect():  # a row a query term
        total[r.k] = r.n
    return int(total[-2]), int(total[-1]), total[:-2]


def term_weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)


def _search_block(docs: DataFrame, items: list, k: int, leaf: int) -> DataFrame:
    """query (place in the block), doc_id, score: the k best documents of each task for each query."""
    sc = docs.sparkSession.sparkContext
    queries = sc.broadcast(Queries([r.text for r in items]))
    n_docs, n_words, df = statistics(docs, queries)
    weight = sc.broadcast(term_weights(df, n_docs))

    def run(batches):
        block, w = queries.value, weight.value
        best: list[list[tuple[int, int]]] = [[] for _ in block.terms]
        held: list[tuple] = []
        ids: list[int] = []

        def flush():
            if not held:
                return
            place, term, times, size = (np.concatenate(x) for x in zip(*held, strict=True))
            shard = Shard(ids, place, term, impacts(times, size, n_docs, n_words), len(block.vocabulary))
            for q, (terms, repeats) in enumerate(zip(block.terms, block.repeats, strict=True)):
                shard.search(terms, w[terms] * repeats, best[q], k, leaf)
            held.clear()
            ids.clear()

        for batch in batches:
            for part in slices(batch, 1):
                sizes, place, term, times = postings_of(part.column(1).to_pylist(), block.vocabulary)
                if ids and (len(ids) + len(sizes) > SHARD_DOCS or sum(len(x[0]) for x in held) + len(place) > SHARD_POSTINGS):
                    flush()
                held.append((place + len(ids), term, times, sizes[place]))
                ids += [LAST if x is None else x for x in part.column(0).to_pylist()]
        flush()
        out = [(q, None if -d == LAST else -d, s) for q, b in enumerate(best) for s, d in b]
        columns = zip(*out, strict=True) if out else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query", "doc_id", "score"])

    return docs.mapInArrow(run, "query bigint, doc_id bigint, score bigint")


def _best(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, queries: DataFrame, k: int = TOP, leaf: int = LEAF, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id (as in queries), rank, doc_id, score of the k best documents (doc_id, text) for each query (item_id, text)."""
    docs = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    wanted = queries.select("item_id", F.col("text").cast("string"))
    size = wanted.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    out = None
    for b in range(blocks):
        items = wanted.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).collect()  # about block_bytes
        rows = _search_block(docs, items, k, leaf).withColumn("salt", F.pmod(F.xxhash64("doc_id", F.spark_partition_id()), F.lit(SALTS)))
        top = _best(_best(rows, ["query", "salt"], k), ["query"], k)
        names = docs.sparkSession.createDataFrame([(i, r.item_id) for i, r in enumerate(items)], f"query bigint, item_id {wanted.schema['item_id'].dataType.simpleString()}")
        top = top.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")
        out = top if out is None else out.unionByName(top)
    return out


def query(spark, sf_dir: str) -> DataFrame:
    """op12: the 20 best documents for each benchmark item."""
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = rf"""
WITH dw AS (SELECT doc_id, {_TERMS} AS w FROM documents), dt AS (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM dw),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM dt GROUP BY ALL),
qt AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
totals AS (SELECT count(*)::BIGINT AS all_n, sum(len(w))::BIGINT AS all_l FROM dw WHERE len(w) > 0),
weights AS (SELECT term, floor(1000 * ln((2 * all_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, totals GROUP BY term, all_n),
scored AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * all_n) // all_l))))::BIGINT AS score
  FROM qt JOIN tf USING (term) JOIN weights USING (term), totals GROUP BY item_id, doc_id
), places AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM places WHERE rank <= 20
"""
