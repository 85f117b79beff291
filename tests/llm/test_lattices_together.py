"""Lattices of many words at once against one word at a time; scores of documents end to end."""

import math
import random

import numpy as np
import public_tokenizers as P
import pytest

from piisift.llm import lattice_lm as L

PATH = P.path("piece_bpe_32k.model")


def words():
    rnd = random.Random(4)
    out = ["", "a", "the", "thedonor", "日本語", "naïve", "x" * 63, "x" * 64, "y" * 500, "\U0001f600", "a͸b", "\x00", "12345", "Straße"]
    return out + ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyzéüñß日本の0123") for _ in range(rnd.randrange(1, 30))) for _ in range(400)]


def test_scores_and_expectations():
    pieces = L.pieces_of(PATH)
    logp, ws = pieces.start, words()
    lattice = L.Lattice(pieces, ws)
    assert sorted([*lattice.taken.tolist(), *lattice.rest.tolist()]) == list(range(len(ws))) and len(lattice.taken) > 300
    want = [L.word_score(pieces, logp.tolist(), ws[i]) for i in lattice.taken]
    assert lattice.scores(logp) == pytest.approx(want, rel=1e-12)
    counts = np.arange(1, len(lattice.taken) + 1)
    got = np.zeros(pieces.n + 1)
    lattice.add_expected(logp, counts, got)
    one, prob = [0.0] * (pieces.n + 1), [math.exp(x) for x in logp]
    for i, c in zip(lattice.taken.tolist(), counts.tolist()):
        L.add_expected(pieces, logp.tolist(), prob, ws[i], c, one)
    assert got == pytest.approx(np.array(one), rel=1e-9, abs=1e-12)
    assert L.Lattice(pieces, []).scores(logp).tolist() == [] and len(L.Lattice(pieces, ["y" * 100]).rest) == 1


def test_documents_end_to_end(spark):
    """Scores from the fitted pieces, every word by itself."""
    rnd = random.Random(6)
    vocabulary = [w for w in words() if w and not any(c in " \t\n\r\x0b\x0c" for c in w)]
    docs = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(0, 40)))) for i in range(80)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in L.score_documents(df, PATH).collect()}
    import zlib
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in docs}
    split = {i: [w.decode("utf-8", "surrogatepass") for w in L.words_of(t)] for i, t in docs}
    pieces, ends = L.pieces_of(PATH), sum(not h for h in held.values())
    logp = pieces.start
    for _ in range(L.PASSES):
        uses, prob = [0.0] * (pieces.n + 1), [math.exp(x) for x in logp]
        for i, ws in split.items():
            for w in ws if not held[i] else []:
                L.add_expected(pieces, logp.tolist(), prob, w, 1, uses)
        total = np.array(uses) + L.SMOOTHING
        total[pieces.n] += ends
        logp = np.log(total / total.sum())
    for i, ws in split.items():
        want = (sum(L.word_score(pieces, logp.tolist(), w) for w in ws) + logp[-1]) / L.LN10
        assert got[i]["score"] == pytest.approx(want, rel=1e-9) and got[i]["held_out"] == held[i] and got[i]["n_tokens"] == len(ws) + 1
