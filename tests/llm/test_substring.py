"""Substring dedup: against brute force on small vocabularies, several parts and blocks, and defined cases."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from piisift.llm import substring

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(texts, window):
    words = [WORD.findall(t or "") for t in texts]
    seen = defaultdict(list)
    for d, ws in enumerate(words):
        for i in range(len(ws) - window + 1):
            seen[tuple(ws[i:i + window])].append((d, i))
    gone = [set() for _ in words]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                gone[d].update(range(i, i + window))
    return [(len(ws), len(g), " ".join(w for i, w in enumerate(ws) if i not in g)) for ws, g in zip(words, gone)]


def run(spark, texts, **kw):
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part string, bucket string").repartition(3)
    got = substring.remove_repeats(docs, **kw).orderBy("doc_id").collect()
    return [(r["n_words"], r["n_removed"], r["kept"]) for r in got]


@pytest.mark.parametrize("seed,window,first", [(1, 5, 1), (2, 7, 2), (3, 35, 10), (4, 12, 12)])
def test_random_texts(spark, seed, window, first):
    rnd = random.Random(seed)
    vocabulary = ["a", "b", "é", "日本", "c1", "Z,"]
    texts = [rnd.choice([" ", "\n\t", " \x0b"]).join(rnd.choice(vocabulary) for _ in range(rnd.randrange(0, 60)))
             for _ in range(40)]
    passage = " ".join(f"p{i}" for i in range(window + 9))
    texts += [f"{rnd.random()} {passage} {rnd.random()}" for _ in range(6)] + texts[:3] + [None, "", " \n ", passage[:-1]]
    # small blocks: answers come back to many blocks of several parts
    assert run(spark, texts, window=window, first_level=first, block_bytes=200) == brute(texts, window)


def test_one_text_repeats_itself(spark):
    lines = " ".join(f"w{i}" for i in range(40))
    texts = [lines + " middle " + lines, "w " * 36, "w " * 35, "\x1c ".join(["same"] * 80)]
    assert run(spark, texts) == brute(texts, 35)


def test_long_text_and_long_word(spark):
    body = " ".join(str(i * 7919 % 100003) for i in range(300_000))
    texts = [body, "x" * 3_000_000, body[:400_000] + " end", "y" * 2_500_000 + " " + "z " * 40]
    assert run(spark, texts) == brute(texts, 35)


def test_no_rows_and_no_repeats(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert substring.remove_repeats(docs).collect() == []
    assert run(spark, ["a b c", "d e f"]) == [(3, 0, "a b c"), (3, 0, "d e f")]


def test_levels_at_most_double():
    for window in range(1, 80):
        for first in (1, 3, 10):
            lengths = substring.level_lengths(window, first)
            assert lengths[-1] == window and all(a < b <= 2 * a for a, b in zip(lengths, lengths[1:]))
            assert lengths[0] <= max(first, 1) or lengths == [window]


def test_hashes_do_not_depend_on_pieces(monkeypatch):
    texts = [b"a bb  ccc\n", b"", b"dd", b"e" * 50 + b" f"]
    whole, counts = substring.word_hashes(texts)
    monkeypatch.setattr(substring, "PIECE_BYTES", 3)
    cut, same = substring.word_hashes(texts)
    assert np.array_equal(whole, cut) and counts.tolist() == same.tolist() == [3, 0, 1, 2]
