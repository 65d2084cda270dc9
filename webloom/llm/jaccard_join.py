"""N-gram Jaccard self-join by chosen paths: near-duplicate documents on sets of five-word shingles, similarity 0.8 or more.

1. Copies. Documents with equal word sequences (lower case) are one node, a 64-bit hash of the words. (Two of N texts
   share a hash with a chance of N * N / 2**65.) A node keeps a MinHash of COORDS values of its shingle set; the pairs
   (coordinate, value) are the tokens that similar sets share, about a similarity's part of them.
2. Chosen paths. Each run samples a token of every set and puts the set in that token's bucket. A bucket of one set is
   dropped; a bucket of over LIMIT sets is split again: BRANCH coordinates are sampled by a hash of the path, and each set
   goes to the buckets of its tokens there, up to DEPTH times. One run keeps a pair of similarity SIMILARITY together with
   a chance of at least SIMILARITY * (1 - (1 - SIMILARITY) ** BRANCH) ** DEPTH; runs_for() repeats runs until no more than
   1 - recall of such pairs are expected to miss all of them.
3. Buckets are brute-forced on byte sketches of the MinHash (agreement of at least SKETCH_MIN, over four standard
   deviations below 0.8); sets found alike are joined to their bucket's smallest, so a bucket gives fewer rows than sets.
   What DEPTH splits leave above LIMIT is dealt out as pairs of blocks, so no bucket is capped.
4. Clusters. Connected components of these links, by alternating large-star and small-star steps.
5. Exact check. The shingle sets of a cluster (64-bit hashes) meet in one task; all intersections are counted,
   5 * |A and B| >= 4 * |A or B| makes a link. A cluster of over CLUSTER_LIMIT sets is first written as differences from its
   smallest node's set (a few shingles a near copy), and pairs of blocks of these differences, dealt out by ranges, give the
   same intersections. Links are counted per node, never listed. A pair that missed all common buckets is still counted if a
   chain of others joins it.

Result: doc_id, text_id (smallest doc_id with the same words), n_copies, n_links (other texts at 0.8 or more), class_id
(smallest doc_id of the connected component), n_shingles.

Edge cases: a text of one to four words is one shingle of all its words; null and empty texts and texts of only white space
have none: they are copies of each other (one class) and link to nothing else; a null doc_id is ignored in minima, and a
class with no other id has class_id null; rows are told apart by doc_id and a hash of the text, so ids that repeat or are
null don't meet each other; repeated rows are copies; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import map_slices, stored

SHINGLE, COORDS, SIMILARITY = 5, 64, 0.8
RECALL, LIMIT, BRANCH, DEPTH, BLOCK = 0.9999, 512, 2, 3, 512
SKETCH_MIN = 38
CLUSTER_LIMIT, DELTA_ROWS = 256, 64
#: Tables of up to this many rows (of two to five numbers) are broadcast to pick rows of large tables; beyond it both are shuffled.
BROADCAST_ROWS = 2_000_000
WORD_CACHE = 1 << 19
EMPTY = np.uint64(0)

_RNG = np.random.default_rng(20240229)
MULT = _RNG.integers(1, 2**63, COORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _RNG.integers(0, 2**63, COORDS, dtype=np.uint64)
POWERS = np.array([pow(0x9E3779B97F4A7C15, i, 2**64) for i in range(SHINGLE)], np.uint64)


def runs_for(recall: float) -> int:
    """Runs after which a pair of similarity SIMILARITY shared a bucket of some run with a chance of recall, at the deepest split."""
    kept = SIMILARITY * (1 - (1 - SIMILARITY) ** BRANCH) ** DEPTH
    return min(COORDS, max(1, math.ceil(math.log(1 - recall) / math.log(1 - kept))))


def _small(df: DataFrame, n_rows: int) -> DataFrame:
    return F.broadcast(df) if n_rows <= BROADCAST_ROWS else df


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def shingles(text: str | None, hashes: WordHashes) -> tuple[int, np.ndarray]:
    """The node (hash of all words) and the sorted distinct shingle hashes."""
    words = (text or "").lower().split()
    if not words:
        return 0, np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    node = int(xxhash.xxh3_64_intdigest(w.tobytes()))
    if len(w) < SHINGLE:
        return node, mixed((w * POWERS[: len(w)]).sum(keepdims=True))
    n = len(w) - SHINGLE + 1
    h = np.zeros(n, np.uint64)
    for i in range(SHINGLE):
        h += w[i : i + n] * POWERS[i]
    return node, np.unique(mixed(h))


def minhash(s: np.ndarray) -> np.ndarray:
    out = np.full(COORDS, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(s), 4096):
        part = (s[at : at + 4096, None] * MULT + ADD) >> np.uint64(32)
        out = np.minimum(out, part.min(axis=0).astype(np.uint32))
    return out


def as_long(h: int) -> int:
    return h - 2**64 if h >= 2**63 else h


def signatures(docs: DataFrame) -> DataFrame:
    def make():
        hashes = WordHashes()

        def f(cols):
            out = {"doc_id": cols["doc_id"], "thash": cols["thash"], "node": [], "n_shingles": [], "sig": []}
            for text in cols["text"]:
                node, s = shingles(text, hashes)
                out["node"].append(as_long(node))
                out["n_shingles"].append(len(s))
                out["sig"].append(minhash(s).tobytes() if len(s) else None)
            return out

        return f

    return map_slices(docs, "text", make, "doc_id bigint, thash bigint, node bigint, n_shingles int, sig binary")


def _matrix(column: pa.Array, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _root_paths(nodes: DataFrame, runs: int) -> DataFrame:
    """path, node: in each run the bucket of one sampled token."""
    chosen = np.random.default_rng(7).permutation(COORDS)[:runs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sig = _matrix(b.column("sig"), np.uint32, COORDS)[:, chosen].astype(np.uint64)
                path = mixed(mixed(sig + np.uint64(0x632BE59BD9B4E019)) + chosen.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                node = np.repeat(b.column("node").to_numpy(zero_copy_only=False), runs)
                yield pa.RecordBatch.from_arrays([pa.array(path.ravel().view(np.int64)), pa.array(node)], names=["path", "node"])

    return nodes.select("node", "sig").mapInArrow(run, "path bigint, node bigint")


def _split_paths(members: DataFrame, branch: int) -> DataFrame:
    """Children of (path, node, sig): buckets of the tokens at coordinates sampled by the path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sig = _matrix(b.column("sig"), np.uint32, COORDS)
                path = b.column("path").to_numpy(zero_copy_only=False).view(np.uint64)
                node, here = b.column("node").to_numpy(zero_copy_only=False), np.arange(len(path))
                for k in range(branch):
                    at = mixed(path + np.uint64(2 * k + 1)) % np.uint64(COORDS)
                    child = mixed(mixed(path ^ sig[here, at.astype(np.int64)].astype(np.uint64)) + at)
                    yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), pa.array(node)], names=["path", "node"])

    return members.mapInArrow(run, "path bigint, node bigint")


def in_groups(rows: DataFrame, keys: list[str], f: Callable[[list[pa.RecordBatch]], dict | None], schema: str, by_range: bool = False) -> DataFrame:
    """f(batches of one group) for each group of keys: rows are dealt out and sorted by keys, one group in memory at a time.

    by_range is for few large groups, which then don't share a task while there are tasks enough."""
    names = [x.split()[0] for x in schema.split(", ")]
    types = {"bigint": pa.int64(), "int": pa.int32(), "array<bigint>": pa.list_(pa.int64()), "string": pa.string()}
    kinds = [types[x.split()[1]] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, current, out, size = [], None, {n: [] for n in names}, 0

        def flush():
            nonlocal size
            got = f(held) if held else None
            if got:
                for n, t in zip(names, kinds, strict=True):
                    out[n].append(pa.array(got[n], t))
                size += max(len(got[names[0]]), sum(out[n][-1].nbytes for n in names) // 256)  # long texts count as more rows

        def emit():
            nonlocal out, size
            columns = [pa.concat_arrays(out[n]) if out[n] else pa.array([], t) for n, t in zip(names, kinds, strict=True)]
            out, size = {n: [] for n in names}, 0
            return pa.RecordBatch.from_arrays(columns, names=names)

        for b in batches:
            if not b.num_rows:
                continue
            key = np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in keys], 1)
            cuts = np.concatenate(([0], np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, [len(key)]))
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                this = tuple(key[i])
                if this != current:
                    flush()
                    held, current = [], this
                    if size > 50_000:
                        yield emit()
                held.append(b.slice(i, j - i))
        flush()
        yield emit()

    dealt = rows.repartitionByRange(*keys) if by_range else rows.repartition(*keys)
    return dealt.sortWithinPartitions(*keys).mapInArrow(run, schema)


def _stars(n: int, pairs: Iterator[tuple[int, np.ndarray]]) -> np.ndarray:
    """Root (smallest index) of each of n items under links (i, items linked with i)."""
    root = np.arange(n)
    for i, others in pairs:
        if len(others):
            old = np.unique(np.append(root[others], root[i]))
            if len(old) > 1:
                root[np.isin(root, old)] = old[0]
    return root


def _alike(batches: list[pa.RecordBatch]) -> dict | None:
    """Links (node, smallest node alike) inside a bucket, or between the two blocks of a pair of blocks."""
    node = np.concatenate([b.column("node").to_numpy(zero_copy_only=False) for b in batches])
    if len(node) < 2:
        return None
    side = np.concatenate([b.column("side").to_numpy(zero_copy_only=False) for b in batches])
    sketch = np.concatenate([_matrix(b.column("sketch"), np.uint8, COORDS) for b in batches])
    _, first = np.unique(node, return_index=True)  # sorted by node: the smallest index is the smallest node
    node, side, sketch = node[first], side[first], sketch[first]
    two = side.min() != side.max()

    def pairs():
        for i in range(len(node) - 1):
            like = np.flatnonzero((sketch[i + 1 :] == sketch[i]).sum(axis=1) >= SKETCH_MIN) + i + 1
            yield i, like[side[like] != side[i]] if two else like

    root = _stars(len(node), pairs())
    moved = np.flatnonzero(root != np.arange(len(node)))
    return {"a": node[moved], "b": node[root[moved]]} if len(moved) else None


def candidate_links(nodes: DataFrame, runs: int) -> DataFrame:
    """a, b: links between nodes that share a bucket of the chosen paths and agree in their sketches."""
    members, leaves = stored(_root_paths(nodes, runs), "paths"), []
    for depth in range(DEPTH + 1):
        counts = stored(members.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
        n_big, all_rows, n_rows = counts.agg(F.count_if(F.col("n") > LIMIT), F.sum("n"), F.sum(F.when(F.col("n") > LIMIT, F.col("n")))).first()
        kept = members.join(counts, "path")
        if not n_big or depth == DEPTH:
            leaves.append((kept, n_big))
            break
        leaves.append((kept.where(F.col("n") <= LIMIT), 0))
        big = _small(kept.where(F.col("n") > LIMIT).select("path", "node"), n_rows).join(nodes.select("node", "sig"), "node")
        members = stored(_split_paths(big, BRANCH).distinct(), "paths")
    found = None
    for leaf, n_big in leaves:
        small = leaf.where(F.col("n") <= LIMIT).select("path", "node", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"))
        parts = [in_groups(small.join(nodes.select("node", "sketch"), "node"), ["path", "i", "j"], _alike, "a bigint, b bigint")]
        if n_big:
            large = leaf.where(F.col("n") > LIMIT).select("path", "node", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
            large = stored(large.join(nodes.select("node", "sketch"), "node"), "large-buckets")
            parts.append(in_groups(_pairs_of_blocks(large), ["path", "i", "j"], _alike, "a bigint, b bigint", by_range=True))
        for p in parts:
            found = p if found is None else found.unionByName(p)
    return found.distinct()


def _pairs_of_blocks(rows: DataFrame) -> DataFrame:
    """Rows of groups of so many blocks, once for each pair i, j of blocks that theirs (side) belongs to."""
    side = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    rows = rows.withColumn("side", side).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumn("i", F.least("side", "other")).withColumn("j", F.greatest("side", "other")).drop("other")


def components(links: DataFrame) -> DataFrame:
    """node, root (its component's smallest node) for all nodes of the links a, b."""
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.where("u != v").distinct(), "edges")
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        small = stored(small, "edges")
        sums = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        done = sums(small) == sums(edges)
        edges = small
        if done:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _set_rows(batches: list[pa.RecordBatch], columns: tuple[str, ...]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The columns and the sets of a group's rows, one a node, sorted by node."""
    got = [np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in batches]) for c in columns]
    sets = [np.asarray(x.values) for b in batches for x in b.column("s")]
    _, first = np.unique(got[0], return_index=True)
    return [c[first] for c in got], [sets[k] for k in first]


def _differences(batches: list[pa.RecordBatch]) -> dict | None:
    """Sets of a cluster written as differences from its center's: what it lacks and what it has besides (never in both)."""
    center = next(np.asarray(x.values) for b in batches for x, is_center in zip(b.column("s"), b.column("center").to_pylist(), strict=True) if is_center)
    batches = [b.filter(pa.array([not x for x in b.column("center").to_pylist()])) for b in batches]
    if not sum(b.num_rows for b in batches):
        return None
    (node, cluster, blocks), sets = _set_rows(batches, ("node", "cluster", "blocks"))
    lacks = [np.setdiff1d(center, s, assume_unique=True) for s in sets]
    extra = [np.setdiff1d(s, center, assume_unique=True) for s in sets]
    return {
        "cluster": cluster, "blocks": blocks, "node": node, "size": [len(s) for s in sets], "inside": [len(center) - len(x) for x in lacks],
        "center_size": np.full(len(node), len(center)), "s": [np.concatenate(x) for x in zip(lacks, extra, strict=True)],
    }


def _verified(batches: list[pa.RecordBatch]) -> dict | None:
    """Exact links of a cluster, or between two of its blocks: counts per node, and the smallest node linked by a chain.

    Rows hold sets, or differences from a center: |A and B| = |center| - lacks(A) - lacks(B) + |differences of A and of B|;
    inside is |center| - lacks, and 0 for sets (their center is the empty set)."""
    (node, side, sizes, inside, most), sets = _set_rows(batches, ("node", "side", "size", "inside", "center_size"))
    n, lengths = len(node), np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(n), lengths)
    _, token, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[token] > 1
    owner, token = owner[shared], (np.cumsum(times > 1) - 1)[token[shared]]
    order = np.argsort(token, kind="stable")
    owner, token, width = owner[order], token[order], int((times > 1).sum())
    both = np.zeros((n, n), np.float32)
    step = max(64, (1 << 22) // max(n, 1))
    for at in range(0, width, step):
        a, b = np.searchsorted(token, [at, at + step])
        x = np.zeros((n, min(step, width - at)), np.float32)
        x[owner[a:b], token[a:b] - at] = 1
        both += x @ x.T
    linked = np.empty((n, n), bool)
    for i in range(n):
        common = both[i] + inside[i] + inside - most
        linked[i] = 5 * common >= 4 * (sizes + sizes[i] - common)
    linked &= ~np.eye(n, dtype=bool)
    if side.min() != side.max():
        linked &= side[:, None] != side[None, :]
    root = _stars(n, ((i, np.flatnonzero(linked[i, i + 1 :]) + i + 1) for i in range(n)))
    return {"node": node, "links": linked.sum(axis=1), "root": node[root]}


def _shingle_sets(texts: DataFrame) -> DataFrame:
    """Shingle sets of the rows whose words are the node's; a node once a task."""

    def make():
        hashes, seen = WordHashes(), set()

        def f(cols):
            out = {k: [] for k in ("cluster", "blocks", "node", "size", "s")}
            for k, text in enumerate(cols["text"]):
                if cols["node"][k] in seen:
                    continue
                node, s = shingles(text, hashes)
                if as_long(node) == cols["node"][k]:
                    seen.add(cols["node"][k])
                    for c in ("cluster", "blocks", "node"):
                        out[c].append(cols[c][k])
                    out["size"].append(len(s))
                    out["s"].append(s.view(np.int64))
            return out

        return f

    return map_slices(texts, "text", make, "cluster bigint, blocks int, node bigint, size int, s array<bigint>")


LINKS = "node bigint, links bigint, root bigint"


def _links_of_clusters(docs: DataFrame, picked: DataFrame) -> tuple[DataFrame, bool]:
    """Exact links per node, and whether a cluster was dealt out in blocks; picked: cluster, blocks, node, key_id, key_hash."""
    n_rows, n_large = picked.agg(F.count(F.lit(1)), F.count_if(F.col("blocks") > 1)).first()
    same = F.col("doc_id").eqNullSafe(F.col("key_id")) & (F.col("thash") == F.col("key_hash"))
    fetch = lambda keys, n: docs.join(_small(keys, n), same).select("cluster", "blocks", "node", "text")
    zero = lambda name: F.lit(0).alias(name)
    whole = _shingle_sets(fetch(picked.where("blocks = 1"), n_rows - n_large))
    whole = whole.select("cluster", "node", zero("side"), "size", zero("inside"), zero("center_size"), "s")
    links = in_groups(whole, ["cluster"], _verified, LINKS)
    if not n_large:
        return links, False
    sets = stored(_shingle_sets(fetch(picked.where("blocks > 1"), n_large)), "sets")
    parts = F.col("blocks") * -(-CLUSTER_LIMIT // DELTA_ROWS)
    rows = sets.select("cluster", "blocks", F.pmod(F.xxhash64("node"), parts).cast("int").alias("part"), "node", "s", F.lit(False).alias("center"))
    centers = sets.where("node = cluster").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    rows = rows.unionByName(centers.select("cluster", "blocks", "part", "node", "s", F.lit(True).alias("center")))
    found = in_groups(rows, ["cluster", "part"], _differences, "cluster bigint, blocks int, node bigint, size int, inside int, center_size int, s array<bigint>")
    dealt = _pairs_of_blocks(stored(found, "differences"))
    return links.unionByName(in_groups(dealt, ["cluster", "i", "j"], _verified, LINKS, by_range=True)), True


def classified(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """doc_id, thash of every row with its node, classes and links; first: the least (no id, doc_id, thash) of the class."""
    keyed = stored(signatures(docs), "signatures")
    nodes = keyed.groupBy("node").agg(
        F.min("doc_id").alias("text_id"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "thash")).alias("first"),
        F.count(F.lit(1)).alias("n_copies"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"),
    )

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sketch = [None if x is None else np.frombuffer(x, np.uint32).astype(np.uint8).tobytes() for x in b.column("sig").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sketch, pa.binary())], names=[*b.schema.names, "sketch"])

    kinds = "node bigint, text_id bigint, first struct<none:boolean,doc_id:bigint,thash:bigint>, n_copies bigint, n_shingles int, sig binary, sketch binary"
    nodes = stored(nodes.mapInArrow(sketched, kinds), "nodes")
    clusters = stored(components(candidate_links(nodes.where("sig IS NOT NULL"), runs_for(recall))), "clusters")

    sizes = stored(clusters.groupBy("root").agg(F.count(F.lit(1)).alias("n")), "sizes")
    blocks = F.ceil(F.col("n") / CLUSTER_LIMIT).cast("int")
    picked = clusters.join(sizes, "root").join(nodes.select("node", "first"), "node")
    picked = picked.select(F.col("root").alias("cluster"), blocks.alias("blocks"), "node", F.col("first.doc_id").alias("key_id"), F.col("first.thash").alias("key_hash"))
    links, in_blocks = _links_of_clusters(docs, stored(picked, "candidates"))
    links = stored(links, "links")
    found = links.groupBy("node").agg(F.sum("links").alias("n_links"), F.min("root").alias("root"))
    if in_blocks:  # chains may run through several pairs of blocks
        chains = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
        found = found.drop("root").join(chains, "node", "left")
    known = nodes.join(found, "node", "left").select(
        "node", "text_id", "first", "n_copies", "n_shingles", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("root", "node").alias("root")
    )
    known = stored(known, "known")
    classes = stored(known.groupBy("root").agg(F.min("text_id").alias("class_id"), F.min("first").alias("first")), "classes")
    known = stored(known.drop("first").join(classes, "root").drop("root"), "known")
    return keyed.select("doc_id", "thash", "node").join(known, "node")


def _plain(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("thash"))


def near_duplicates(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """One row per document with its classes and number of links."""
    return classified(_plain(docs), recall).select("doc_id", "class_id", "text_id", "n_copies", "n_links", "n_shingles")


def query(spark, sf_dir: str) -> DataFrame:
    """op4: class and links of every document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class stays, all columns kept: the one with the smallest doc_id (rows without one come last), of
    several texts with that id the one with the smallest text hash; of repeated rows with one doc_id and text any one."""
    found = stored(classified(_plain(docs)), "classes")
    stays = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.thash") == F.col("thash"))
    keys = [F.col("doc_id").alias("key_id"), F.col("thash").alias("key_hash")]
    gone = stored(found.where(~stays).select(*keys).distinct(), "dropped")
    again = stored(found.where(stays).groupBy(*keys).count().where("count > 1").drop("count"), "repeated")
    n_again = again.count()
    same = lambda k: docs["doc_id"].cast("bigint").eqNullSafe(k["key_id"]) & (F.xxhash64(docs["text"].cast("string")) == k["key_hash"])
    gone, again = _small(gone, gone.count()), _small(again, n_again)
    left = docs.join(gone, same(gone), "left_anti")
    if not n_again:
        return left
    twice = left.join(again, same(again), "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(again, same(again), "left_anti").unionByName(twice)
