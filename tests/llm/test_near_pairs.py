"""Pairs of the exact step of near duplicates: none that can reach the similarity is left out, few others are made."""

from collections import Counter

from piisift.llm import near


def _pairs(spark, texts):
    rows = [(bytes([i]), bytes([i]), t) for i, t in enumerate(texts)]
    got = near.remaining_pairs(spark.createDataFrame(rows, "digest binary, comp binary, t string")).collect()
    return {tuple(sorted((bytes(r.x)[0], bytes(r.y)[0]))) for r in got}


def test_pairs_are_met_at_their_rarest_common_part(spark):
    words = [f"w{i}" for i in range(90)]
    # neighbours share 7 of 8 k-mers: 7 / 9 is under the similarity
    texts = [" ".join(words[i:i + 12]) for i in range(60)]
    kmers = [near.labelled(near.shingles(near.words_of(t))).tolist() for t in texts]
    often = Counter(k for ks in kmers for k in ks)
    first = [min(((often[k], k - (1 << 64) if k >> 63 else k) for k in ks)) for ks in kmers]
    assert all(first[x] == first[y] for x, y in _pairs(spark, texts))


def test_no_pair_that_can_reach_the_similarity_is_left_out(spark):
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(words[at:at + n]) for at in (0, 2, 60, 61) for n in (30, 33, 36, 44)]
    texts += [t.replace(words[70], "x") for t in texts[8:]]
    kmers = [near.shingles(near.words_of(t)) for t in texts]
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if near.similarity(kmers[i], kmers[j])}
    assert want and want <= _pairs(spark, texts)
