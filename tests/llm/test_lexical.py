"""Ranked lexical search: against brute force on random tables with ties, copies and nulls; pruning; empty tables."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from piisift.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    known = [(key, Counter(ts), len(ts)) for key, t in docs if (ts := terms(t))]
    n_docs, n_terms = len(known), sum(n for _k, _c, n in known)
    df = Counter(t for _k, c, _n in known for t in c)
    want = {}
    for item, t in items:
        want.setdefault(item, set()).update(terms(t))
    out = []
    for item, ts in want.items():
        found = []
        for key, c, n in known:
            m = 100 - 50 + (50 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) *
                        ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in ts if t in c)
            if score > 0:
                found.append((-score, key is None, key or 0))
        out += [(item, r + 1, None if none else key, -s) for r, (s, none, key) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def run(spark, docs, items, parts=3, **kw):
    d = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, score int").repartition(parts)
    i = spark.createDataFrame([(a, b, "x") for a, b in items], "item_id long, text string, term string")
    return sorted((tuple(r) for r in lexical.search(d, i, **kw).collect()), key=repr)


@pytest.mark.parametrize("seed,k,block", [(1, 5, 100_000), (2, 1, 7), (3, 50, 30)])
def test_random_tables(spark, seed, k, block):
    rnd = random.Random(seed)
    vocabulary = ["der", "The", "É", "日本", "x_y", "é", "a1", "b-c", "rare", *(f"w{i}" for i in range(40))]
    def text(n):
        return " ".join(rnd.choice(vocabulary[:rnd.choice([6, 49])]) for _ in range(rnd.randrange(n)))
    docs = [(i, text(60)) for i in range(300)]
    docs += [(1000 - i, docs[7][1]) for i in range(40)] + [(None, docs[7][1]), (None, "rare"), (5, docs[5][1]), (6, None), (7, " !")]
    items = [(i, text(12)) for i in range(30)] + [(3, "rare rare"), (None, "the"), (40, None), (41, "unknownword"), (42, "...")]
    assert run(spark, docs, items, k=k, block_terms=block) == brute(docs, items, k)


def test_many_equal_documents(spark):
    docs = [(i, "same words here") for i in range(400, 0, -1)] + [(0, "same"), (500, "other")]
    items = [(1, "same words"), (2, "here other")]
    assert run(spark, docs, items, parts=7) == brute(docs, items, 50)


def test_long_text(spark):
    docs = [(1, "alpha " * 500_000 + "beta"), (2, "beta"), (3, "gamma alpha"), (4, "y" * 2_000_000)]
    assert run(spark, docs, [(1, "alpha beta gamma")]) == brute(docs, [(1, "alpha beta gamma")], 50)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a")]) == run(spark, [(1, "a")], []) == run(spark, [(1, None)], [(1, "a")]) == []


def test_trees_prune_whole_batches():
    """Documents of another subject are left out by a bound of their whole subtree."""
    rng = np.random.default_rng(1)
    n, width = 4096, 400
    doc = np.repeat(np.arange(n), 10)
    term = np.concatenate([np.sort(rng.choice(100, 10, replace=False)) + 100 * (i % 4) for i in range(n)])
    impact = rng.integers(1, 1000, len(doc))
    weights = rng.integers(1, 5000, width)
    item, words = np.repeat(np.arange(40), 8), np.concatenate([rng.choice(100, 8, replace=False) + 100 * (i % 4) for i in range(40)])
    items, docs = lexical.ItemTree(item, words, weights), lexical.DocTree(doc, term, impact, weights)
    heaps = [[] for _ in range(40)]
    seen = lexical.search_trees(items, docs, np.zeros(40), heaps, 10)
    dense, query = np.zeros((n, width), dtype=np.int64), np.zeros((40, width), dtype=np.int64)
    dense[doc, term], query[item, words] = impact, weights[words]
    scores = dense @ query.T
    for at, heap in enumerate(heaps):
        i = items.order[at]
        best = sorted(((-int(s), d) for d, s in enumerate(scores[:, i]) if s > 0))[:10]
        assert sorted((-s, -o) for s, o in heap) == best
    assert seen < 0.8 * 40 * n / lexical.LEAF
