"""MinHash near-duplicates: the sequential test, large groups in parts, brute force, edge cases."""

import math
import random
import re

import numpy as np
import pytest

from webloom.llm import minhash_bayes as mb


def plain_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w)} if 0 < len(w) < 3 else {tuple(w[i : i + 3]) for i in range(len(w) - 2)}


def brute(rows):
    """(doc_id, n_shingles, component_id) by comparing all pairs."""
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * min(len(sets[i]), len(sets[j])) >= 85 * max(len(sets[i]), len(sets[j])):
                both = len(sets[i] & sets[j])
                if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                    root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def family(r, n, words, edits, start):
    """n edited copies of a text, each with so many words changed, in places of its own."""
    base = [f"x{r.randrange(10**6)}" for _ in range(words)]
    out = []
    for i in range(n):
        w = list(base)
        for at in r.sample(range(words), edits if isinstance(edits, int) else r.randint(*edits)):
            w[at] = f"y{r.randrange(10**9)}"
        out.append((start + i, " ".join(w)))
    return [*out, (start + n, " ".join(base))]


def got(df, **o):
    rows = mb.near_duplicates(df, **o).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=str)


def test_sequential_test_keeps_links():
    """The chance to lose a pair of the threshold's similarity, by its own distribution, and what pairs far below it cost."""
    t, alive, gone = 0.85 + 0.15 / 256, {0: 1.0}, 0.0
    for k, least in enumerate(mb.LEAST):
        after = {}
        for a, p in alive.items():
            for x in range(mb.BATCH + 1):
                after[a + x] = after.get(a + x, 0) + p * math.comb(mb.BATCH, x) * t**x * (1 - t) ** (mb.BATCH - x)
        gone += sum(p for a, p in after.items() if a < least)
        alive = {a: p for a, p in after.items() if a >= least}
        assert least <= (k + 1) * mb.BATCH * 0.85
    assert gone < 1e-5
    r = np.random.default_rng(0)
    one = r.integers(0, 256, mb.COORDS).astype(np.uint8)
    others = np.where(r.random((200, mb.COORDS)) < 0.5, one, r.integers(0, 256, (200, mb.COORDS))).astype(np.uint8)
    assert not len(mb.alike(one, others)) and mb.alike(one, np.stack([others[0], one])).tolist() == [1]
    assert (1 - 0.85**mb.ROWS) ** mb.BANDS < 5e-6


def test_signature_estimates_similarity():
    r = random.Random(4)
    texts = [t for _, t in family(r, 30, 400, 12, 0)]
    hashes = mb.ByteHashes()
    sets = [mb.shingle_set(t, hashes) for t in texts]
    sigs = [mb.signature(s) for s in sets]
    off = [(sigs[i] == sigs[-1]).mean() - len(np.intersect1d(sets[i], sets[-1])) / len(np.union1d(sets[i], sets[-1])) for i in range(30)]
    assert abs(np.mean(off)) < 0.02 and max(map(abs, off)) < 0.12


@pytest.mark.parametrize("limit", [mb.LIMIT, 20])
def test_against_brute_force(spark, limit, monkeypatch):
    """Tight groups, groups whose copies hang together only by the original, groups around the threshold; whole and in parts."""
    r = random.Random(limit)
    rows = family(r, 90, 200, (0, 3), 0) + family(r, 60, 200, 5, 1000) + family(r, 60, 200, (4, 9), 2000) + family(r, 60, 150, (0, 40), 3000) + family(r, 3, 500, 2, 4000)
    rows += [(5000 + i, " ".join(f"z{r.randrange(10**6)}" for _ in range(50))) for i in range(60)] + [(6000 + i, rows[0][1]) for i in range(50)]
    r.shuffle(rows)
    monkeypatch.setattr(mb, "PART", 16)
    monkeypatch.setattr(mb, "LEADERS", 4)
    assert got(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), limit=limit) == brute(rows)


def test_edges(spark):
    long = " ".join(f"w{i % 7000}" for i in range(40_000))
    rows = [(1, "one"), (2, "ONE "), (3, "one two"), (4, "one  two\n"), (5, None), (6, ""), (7, " \t\n"), (7, ""), (8, long), (9, long + " end"), (9, long), (None, "a b c d"), (None, "a b c d"),
            (None, long), (None, None), (10, "É a b c"), (11, "é a b c"), (12, "two one"), (13, "one two x"), (14, "one\x1ctwo x")]
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id bigint, text string, `node.x` int, grp int").repartition(3)
    want = [(d, n, c if n else d) for d, n, c in brute(rows)]
    assert got(df) == sorted(want, key=str)
    assert mb.near_duplicates(df.limit(0)).count() == 0
