"""Ranked lexical search: treaps and traversal against brute force, edge cases."""

import collections
import heapq
import math
import random

import numpy as np
import pytest

from webloom.llm import lexical
from webloom.llm.decontaminate import words_of


def brute(docs, items, k=lexical.TOP):
    counts = [(d, collections.Counter(words_of(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n_docs, n_words = len(counts), sum(sum(c.values()) for _, c in counts)
    df = collections.Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in counts:
            m = 75 + 25 * sum(c.values()) * n_docs // n_words
            s = sum(r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, r in collections.Counter(words_of(text)).items() if c[t])
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(item, i + 1, None if none else d, -s) for i, (s, none, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def sample(n, seed=3):
    r = random.Random(seed)
    words = [f"w{min(int(r.paretovariate(0.7)), 400)}" for _ in range(4000)]
    docs = [(i, " ".join(r.choice(words) for _ in range(r.randint(1, 60)))) for i in range(n)]
    return docs, [(i, " ".join(r.choice(words) for _ in range(r.randint(1, 15)))) for i in range(20)]


def test_treap_order():
    heap = [random.Random(5).randint(0, 9) for _ in range(50)]
    starts = [0, 20, 20, 50]
    left, right, roots = lexical.cartesian(heap, starts)
    assert roots[1] == -1

    def walk(i):
        if i < 0:
            return []
        assert all(c < 0 or heap[c] <= heap[i] for c in (left[i], right[i]))
        return [*walk(left[i]), i, *walk(right[i])]

    assert walk(roots[0]) == list(range(20)) and walk(roots[2]) == list(range(20, 50))


@pytest.mark.parametrize("leaf", [1, 7, 4096])
def test_traversal_prunes_and_is_exact(leaf):
    docs, items = sample(600)
    queries = lexical.Queries([t for _, t in items])
    sizes, place, term, times = lexical.postings_of([t for _, t in docs], queries.vocabulary)
    shard = lexical.Shard([d for d, _ in docs], place, term, lexical.impacts(times, sizes[place], len(docs), int(sizes.sum())), len(queries.vocabulary))
    df = np.bincount(term, minlength=len(queries.vocabulary))
    weights, plain, pruned = lexical.term_weights(df, len(docs)), {}, 0
    for item, rank, d, s in brute(docs, items, 5):
        plain.setdefault(item, {})[rank] = (s, -d)
    for q, (terms, repeats) in enumerate(zip(queries.terms, queries.repeats, strict=True)):
        best = []
        seen = shard.search(terms, weights[terms] * repeats, best, 5, leaf)
        assert heapq.nlargest(5, best) == [plain[q][r] for r in sorted(plain[q])]
        pruned += seen < df[terms].sum() // 2
    assert leaf > 1 or pruned > len(items) // 2


def test_against_brute_force(spark, monkeypatch):
    docs, items = sample(300, 8)
    docs += [(None, docs[0][1]), (None, docs[1][1]), (5, docs[5][1]), (1000, None), (1001, ""), (1002, ".,;"), (1003, docs[4][1] + " ÄÖ é"), (1004, "w1 " * 5000)]
    items += [(50, None), (51, "!"), (None, docs[3][1]), (53, "unseen"), (54, "w1 W1 w2")]
    frame, queries = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, score int")
    want = brute(docs, items)
    got = lambda **o: sorted((tuple(r) for r in lexical.search(frame, queries, **o).collect()), key=str)
    assert got() == want
    assert got(leaf=3, block_bytes=300) == want
    assert lexical.search(frame.limit(0), queries).count() == 0 and lexical.search(frame, queries.limit(0)).count() == 0


def test_several_shards_share_their_best():
    docs, items = sample(500, 11)
    queries = lexical.Queries([t for _, t in items])
    sizes, place, term, times = lexical.postings_of([t for _, t in docs], queries.vocabulary)
    impact = lexical.impacts(times, sizes[place], len(docs), int(sizes.sum()))
    weights = lexical.term_weights(np.bincount(term, minlength=len(queries.vocabulary)), len(docs))
    parts = []
    for a in range(0, 500, 100):
        here = (place >= a) & (place < a + 100)
        parts.append(lexical.Shard(list(range(a, a + 100)), place[here] - a, term[here], impact[here], len(queries.vocabulary)))
    plain = collections.defaultdict(list)
    for item, _, d, s in brute(docs, items, 4):
        plain[item].append((s, -d))
    for q, (terms, repeats) in enumerate(zip(queries.terms, queries.repeats, strict=True)):
        best = []
        for p in parts:
            p.search(terms, weights[terms] * repeats, best, 4, 16)
        assert sorted(best) == sorted(plain[q])
