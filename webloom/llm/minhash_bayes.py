"""MinHash near-duplicates with sequential Bayesian verification: documents whose sets of three-word shingles are alike by 85 %.

1. Sets. Documents with equal shingle sets are one node, a 64-bit hash of the set. A node keeps a MinHash signature: BANDS keys,
   each a hash of ROWS coordinates, and one byte of each coordinate (its sketch). A pair at the threshold shares no band with a
   chance of (1 - 0.85 ** ROWS) ** BANDS, 4 in a million.
2. Candidates. Nodes with a band key in common form a bucket; of buckets with the same members one is kept.
3. Sequential verification. Two members' sketches are compared a batch of coordinates at a time. After each batch the posterior
   chance (uniform prior) that their similarity reaches the threshold is bounded by the agreements so far; below MISS the pair
   is pruned. Pairs that stay join their bucket's members, as links to few; components of these links are the clusters.
4. Exact check. In a cluster, pairs that pass the same sequential test are compared by their whole sets; 100 * |A and B| >= 85 *
   |A or B| is a link. Components of the links are the result.

Large buckets and clusters are never in one task, and never listed as pairs. First every member is compared with a few leaders (of a
cluster those that share most bands). What is linked with the largest group of leaders is one component already, so only the
rest, usually little, is compared with all members, block by block. So work grows with the members and not with their
square while most of a group hangs together, and no pair is left out where it doesn't.

Edge cases: a text of one or two words is one shingle; null and empty texts and texts of only white space have no set and link with
nothing, not even with each other; a null doc_id is ignored in minima (a component with no id has component_id null, and its rows
are kept); rows are told apart by doc_id and a hash of the text; repeated rows are copies; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm.common import map_slices, stored
from webloom.llm.jaccard_join import WordHashes, _matrix, _small, as_long, components, in_groups, mixed

SHINGLE, PERCENT = 3, 85
BANDS, ROWS, BATCH, MISS = 32, 7, 32, 1e-7
COORDS = BANDS * ROWS
#: Sets a group may have to be compared in one task; leaders of a larger one, and the parts its members are dealt out in.
LIMIT, LEADERS, PART = 512, 16, 256

_RNG = np.random.default_rng(13)
MULT = (_RNG.integers(1, 2**31, COORDS, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
ADD = _RNG.integers(0, 2**32, COORDS, dtype=np.uint32)[:, None]
POWERS = np.array([pow(0x9E3779B97F4A7C15, i, 2**64) for i in range(max(SHINGLE, ROWS))], np.uint64)


def least_agreements(percent: int = PERCENT, miss: float = MISS) -> list[int]:
    """After each batch, the fewest agreements at which the posterior chance of the threshold is at least miss.

    Bytes of unequal coordinates agree once in 256. With a uniform prior, a of m agreements leave the chance
    P(Binomial(m + 1, t) <= a) that the rate of agreement is t or more."""
    t, out = percent / 100 + (1 - percent / 100) / 256, []
    for m in range(BATCH, COORDS + 1, BATCH):
        below, a = (1 - t) ** (m + 1), 0
        while below < miss:
            a += 1
            below += math.comb(m + 1, a) * t**a * (1 - t) ** (m + 1 - a)
        out.append(a)
    return out


LEAST = least_agreements()


def shingle_set(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes; words are runs without ASCII white space, A-Z lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if len(w) < SHINGLE:
        return mixed((w * POWERS[: len(w)]).sum(keepdims=True) + np.uint64(len(w)))
    n = len(w) - SHINGLE + 1
    h = np.zeros(n, np.uint64)
    for i in range(SHINGLE):
        h += w[i : i + n] * POWERS[i]
    return np.unique(mixed(h))


class ByteHashes(WordHashes):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 19:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def node_of(s: np.ndarray) -> int:
    return as_long(xxhash.xxh3_64_intdigest(s.tobytes())) if len(s) else 0


def signature(s: np.ndarray) -> np.ndarray:
    """The least of each of COORDS linear permutations of the hashes' upper halves."""
    x, out = (s >> np.uint64(32)).astype(np.uint32), np.full(COORDS, 2**32 - 1, np.uint32)
    for at in range(0, len(x), 1024):
        out = np.minimum(out, (MULT * x[at : at + 1024] + ADD).min(axis=1))
    return out


def bands_of(sig: np.ndarray) -> np.ndarray:
    h = (mixed(sig.astype(np.uint64) + np.uint64(1)).reshape(BANDS, ROWS) * POWERS[:ROWS]).sum(axis=1)
    return mixed(h + np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


def sketch_of(sig: np.ndarray) -> bytes:
    return ((sig ^ (sig >> np.uint32(16))) & np.uint32(255)).astype(np.uint8).tobytes()


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, thash, node, n_shingles, bands, sketch of every row; no shuffle."""

    def make():
        hashes = ByteHashes()

        def f(cols):
            out = {"doc_id": cols["doc_id"], "thash": cols["thash"], "node": [], "n_shingles": [], "bands": [], "sketch": []}
            for text in cols["text"]:
                s = shingle_set(text, hashes)
                sig = signature(s) if len(s) else None
                out["node"].append(node_of(s))
                out["n_shingles"].append(len(s))
                out["bands"].append(None if sig is None else bands_of(sig))
                out["sketch"].append(None if sig is None else sketch_of(sig))
            return out

        return f

    return map_slices(docs, "text", make, "doc_id bigint, thash bigint, node bigint, n_shingles bigint, bands array<bigint>, sketch binary")


def alike(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Indices of the sketches that the sequential test keeps as possibly linked with one."""
    live, agreed = np.arange(len(others)), np.zeros(len(others), np.int64)
    for k, least in enumerate(LEAST):
        part = slice(k * BATCH, (k + 1) * BATCH)
        agreed = agreed + (others[live, part] == one[part]).sum(axis=1)
        stay = agreed >= least
        live, agreed = live[stay], agreed[stay]
        if not len(live):
            break
    return live


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """The exact test on whole sets."""
    if 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


class Group:
    """The members of a bucket or cluster in one task: node, sketch, and sets where links are exact."""

    def __init__(self, batches: list[pa.RecordBatch], exact: bool, lead: bool | None = None):
        if lead is not None:
            batches = [b.filter(b.column("lead").cast(pa.bool_()) if lead else pa.array([not x for x in b.column("lead").to_pylist()])) for b in batches]
        node = np.concatenate([np.empty(0, np.int64), *[b.column("node").to_numpy(zero_copy_only=False) for b in batches]])
        self.node, first = np.unique(node, return_index=True)
        sketches = [np.empty((0, COORDS), np.uint8), *[_matrix(b.column("sketch"), np.uint8, COORDS) for b in batches if b.num_rows]]
        self.sketch = np.concatenate(sketches)[first]
        self.sets = None
        if exact:
            sets = [np.asarray(x.values) for b in batches for x in b.column("s")]
            self.sets = [sets[i] for i in first]

    def links(self, one: np.ndarray, one_set: np.ndarray | None, among: np.ndarray) -> Iterator[int]:
        """Those of the members among that are linked (or alike, without sets) with one."""
        for j in among[alike(one, self.sketch[among])].tolist():
            if one_set is None or linked(one_set, self.sets[j]):
                yield j

    def joined(self) -> np.ndarray:
        """Index of the first member of each member's component; pairs known to be joined are not compared."""
        n, root = len(self.node), np.arange(len(self.node))
        for i in range(n):
            there = np.flatnonzero(root != root[i])
            there = there[there > i]
            for j in there[alike(self.sketch[i], self.sketch[there])].tolist() if len(there) else ():
                if root[j] != root[i] and (self.sets is None or linked(self.sets[i], self.sets[j])):
                    a, b = sorted((root[i], root[j]))
                    root[root == b] = a
        return root


def _whole(exact: bool) -> Callable:
    """Links of a small group, one for each member that is not its component's first."""

    def f(batches: list[pa.RecordBatch]) -> dict | None:
        g = Group(batches, exact)
        root = g.joined()
        moved = np.flatnonzero(root != np.arange(len(root)))
        return {"a": g.node[moved], "b": g.node[root[moved]]} if len(moved) else None

    return f


def _with_leaders(exact: bool) -> Callable:
    """grp, node, root: members of a part that are linked with a leader; root: the first leader of that leader's component."""

    def f(batches: list[pa.RecordBatch]) -> dict | None:
        grp = next(b.column("grp")[0].as_py() for b in batches if b.num_rows)
        lead, rest = Group(batches, exact, True), Group(batches, exact, False)
        root, owner = lead.joined(), np.full(len(rest.node), -1)
        first = [lead.node[r] for r in root]
        chains: set[tuple[int, int]] = set()
        for i in range(len(lead.node)):  # a member may join components of leaders: each such link is given
            among = np.flatnonzero(owner != root[i])
            for j in rest.links(lead.sketch[i], lead.sets[i] if exact else None, among):
                if owner[j] >= 0:
                    chains.add((int(first[i]), int(lead.node[owner[j]])))
                else:
                    owner[j] = root[i]
        at = np.flatnonzero(owner >= 0)
        node = [*rest.node[at].tolist(), *[a for a, _ in chains]]
        return {"grp": [grp] * len(node), "node": node, "root": [*lead.node[owner[at]].tolist(), *[b for _, b in chains]]} if node else None

    return f


def _with_rest(exact: bool) -> Callable:
    """Links between a block of the rest (lead) and a part of all members."""

    def f(batches: list[pa.RecordBatch]) -> dict | None:
        rest, members = Group(batches, exact, True), Group(batches, exact, False)
        a, b = [], []
        everyone = np.arange(len(members.node))
        for i in range(len(rest.node)):
            for j in members.links(rest.sketch[i], rest.sets[i] if exact else None, everyone):
                if members.node[j] != rest.node[i]:
                    a.append(rest.node[i])
                    b.append(members.node[j])
        if not a:
            return None
        nodes, at = np.unique(np.array([a, b]), return_inverse=True)
        at = at.reshape(2, -1)
        root = np.arange(len(nodes))
        for x, y in zip(at[0].tolist(), at[1].tolist(), strict=True):
            if root[x] != root[y]:
                low, high = sorted((root[x], root[y]))
                root[root == high] = low
        moved = np.flatnonzero(root != np.arange(len(root)))
        return {"a": nodes[moved], "b": nodes[root[moved]]}

    return f


def links_in_groups(members: DataFrame, exact: bool, name: str, limit: int = LIMIT) -> DataFrame:
    """a, b: links whose components are those of all links inside the groups. members: grp, node, n (members of the group), rank
    (leaders are the lowest), sketch and, if exact, s."""
    data = ["sketch", "s"] if exact else ["sketch"]
    small = in_groups(members.where(F.col("n") <= limit).select("grp", "node", *data), ["grp"], _whole(exact), "a bigint, b bigint")
    large = stored(members.where(F.col("n") > limit), f"{name}-large")
    if large.isEmpty():
        return small
    parts = F.ceil(F.col("n") / PART).cast("int")
    part = F.pmod(F.xxhash64("node"), parts).cast("int")
    copies = lambda df: df.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    keyed = lambda df, lead, *keys: df.select("grp", *keys, F.lit(lead).alias("lead"), "node", *data)

    best = Window.partitionBy("grp").orderBy("rank", "node")
    leaders = large.select("grp", "node", "rank").withColumn("k", F.row_number().over(best)).where(F.col("k") <= LEADERS).select("grp", "node")
    leaders = large.join(F.broadcast(leaders) if _few(large, LIMIT) else leaders, ["grp", "node"], "left_semi")
    dealt = keyed(large.withColumn("part", part), False, "part").unionByName(keyed(copies(leaders), True, "part"))
    joined = stored(in_groups(dealt, ["grp", "part"], _with_leaders(exact), "grp bigint, node bigint, root bigint", by_range=True), f"{name}-joined")

    main = joined.groupBy("grp", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("grp").agg(F.max_by("root", F.struct("n", "root")).alias("root"))
    rest = stored(large.join(joined.join(main, ["grp", "root"], "left_semi").select("grp", "node"), ["grp", "node"], "left_anti"), f"{name}-rest")
    blocks = rest.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("blocks"))
    theirs = rest.join(blocks, "grp").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    every = large.join(blocks, "grp").withColumn("part", part).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = keyed(every, False, "block", "part").unionByName(keyed(copies(theirs), True, "block", "part"))
    more = in_groups(pairs, ["grp", "block", "part"], _with_rest(exact), "a bigint, b bigint", by_range=True)
    return small.unionByName(joined.select(F.col("node").alias("a"), F.col("root").alias("b"))).unionByName(more)


def _few(large: DataFrame, limit: int) -> bool:
    """Whether the leaders of all large groups are few enough to broadcast: a group has over limit members and at most LEADERS leaders."""
    return large.count() // limit * LEADERS <= 100_000


def candidate_buckets(nodes: DataFrame) -> DataFrame:
    """grp, node, n: nodes that share a band key; of buckets with equal members one."""
    members = nodes.select(F.explode("bands").alias("grp"), "node")
    buckets = members.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least"), F.bit_xor(F.xxhash64("node")).alias("mix")).where("n > 1")
    buckets = stored(buckets.groupBy("n", "least", "mix").agg(F.min("grp").alias("grp")).select("grp", "n"), "bayes-buckets")
    return members.join(buckets, "grp")


def _sets(docs: DataFrame, picked: DataFrame) -> DataFrame:
    """grp, node, n, rank, sketch and the shingle set (s) of the nodes picked, from the texts of key_id, key_hash."""
    same = F.col("doc_id").eqNullSafe(F.col("key_id")) & (F.col("thash") == F.col("key_hash"))
    texts = docs.join(_small(picked, picked.count()), same).select("text", "grp", "node", "n", "rank", "sketch")

    def make():
        hashes, seen = ByteHashes(), set()

        def f(cols):
            out = {k: [] for k in ("grp", "node", "n", "rank", "sketch", "s")}
            for k, text in enumerate(cols["text"]):
                if cols["node"][k] in seen:
                    continue
                s = shingle_set(text, hashes)
                if node_of(s) == cols["node"][k]:
                    seen.add(cols["node"][k])
                    for c in ("grp", "node", "n", "rank", "sketch"):
                        out[c].append(cols[c][k])
                    out["s"].append(s.view(np.int64))
            return out

        return f

    return map_slices(texts, "text", make, "grp bigint, node bigint, n bigint, rank bigint, sketch binary, s array<bigint>")


def classified(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, thash, node, n_shingles, root (of the component; null without a set) and component_id of every row."""
    keyed = stored(signed(docs), "bayes-signed")
    nodes = keyed.where("n_shingles > 0").groupBy("node").agg(
        F.min("doc_id").alias("least_id"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "thash")).alias("first"),
        F.first("bands").alias("bands"), F.first("sketch").alias("sketch"),
    )
    nodes = stored(nodes, "bayes-nodes")

    found = stored(candidate_buckets(nodes), "bayes-members")
    sketched = found.withColumn("rank", F.xxhash64("node", "grp")).join(nodes.select("node", "sketch"), "node")
    clusters = stored(components(links_in_groups(sketched, False, "bayes-buckets", limit).distinct()), "bayes-clusters")

    shared = found.groupBy("node").agg((-F.sum("n")).alias("rank"))  # the fuller a node's buckets, the nearer it is to the middle
    sizes = clusters.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    picked = clusters.join(sizes, "root").join(nodes.select("node", "first", "sketch"), "node").join(shared, "node")
    picked = picked.select(F.col("root").alias("grp"), "node", "n", "rank", "sketch", F.col("first.doc_id").alias("key_id"), F.col("first.thash").alias("key_hash"))
    sets = _sets(docs, stored(picked, "bayes-picked"))
    links = links_in_groups(stored(sets, "bayes-sets"), True, "bayes-clusters", limit)
    roots = components(links.distinct())

    known = nodes.select("node", "least_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    known = stored(known, "bayes-known")
    least = known.groupBy("root").agg(F.min("least_id").alias("component_id"))
    known = known.join(least, "root").select("node", "root", "component_id")
    out = keyed.select("doc_id", "thash", "node", "n_shingles").join(stored(known, "bayes-known"), "node", "left")
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.withColumn("component_id", own)


def near_duplicates(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id that links reach), kept of every row."""
    text = F.col("text").cast("string")
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("thash"))
    return classified(plain, limit).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    """op13: component of every document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH RECURSIVE dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) END AS s FROM dw
), nodes AS (SELECT min(doc_id) AS node, s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
items AS (SELECT node, n, unnest(s) AS x FROM nodes),
meet AS (SELECT a.node AS a, b.node AS b, count(*) AS c, any_value(a.n + b.n) AS n FROM items a JOIN items b USING (x) WHERE a.node <> b.node GROUP BY ALL),
links AS (SELECT a, b FROM meet WHERE 100 * c >= 85 * (n - c)),
reach(node, r) AS (SELECT node, node FROM nodes UNION SELECT reach.node, links.b FROM reach JOIN links ON links.a = reach.r),
classes AS (SELECT node, min(r) AS c FROM reach GROUP BY node)
SELECT sets.doc_id, len(sets.s)::BIGINT AS n_shingles, coalesce(c, sets.doc_id) AS component_id, coalesce(c, sets.doc_id) = sets.doc_id AS kept
FROM sets LEFT JOIN nodes ON nodes.s = sets.s LEFT JOIN classes ON classes.node = nodes.node
"""
