"""Long words and dense texts: ids as tiktoken's, secrets as before, in seconds."""

import random
import time

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from piisift.llm import bpe_duck, bpe_ids, secret_scan

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def both():
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe_duck.load_ranks(RANKS), special_tokens={})
    return bpe_duck.DuckBpe(RANKS, P.PATTERN), lib


def same(both, text):
    (ids, raw), = both[0].run([text])
    return raw == text.encode() and ids == np.array(both[1].encode_ordinary(text), dtype="<u4").tobytes()


def test_long_words_of_many_kinds(both):
    rnd = random.Random(2)
    pools = ["ab", "aab", "abc", "the ing tion and er s st e t".split(), "あいうえおかきくけこのは", "etaoins", "-=", "0123456789", "éèê"]
    for pool in pools:
        for n in (65, 70, 300, 2000):
            assert same(both, "".join(rnd.choice(pool) for _ in range(n))), (pool, n)
    for _ in range(200):
        assert same(both, "".join(rnd.choice(rnd.choice(pools)) for _ in range(rnd.randrange(60, 400))))


@pytest.mark.parametrize("text", ["".join(random.Random(1).choices("abcdefghijklmnopqrstuvwxyz", k=2_000_000)),
                                  "".join(chr(0x4E00 + i * 7919 % 20000) for i in range(200_000))])
def test_two_million_letters_in_seconds(both, text):
    start = time.time()
    assert same(both, text)
    assert time.time() - start < 120


def test_ids_equal_a_fresh_tokenizer():
    """Special tokens' strings in a text are what the library's plain call makes of them."""
    from tokenizers import Tokenizer
    path = P.path("byte_bpe_50k.json")
    fresh, own = Tokenizer.from_file(path), bpe_ids.Ids(path)
    texts = ["plain text of words", "a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>\n\n  y", "", "tab\there é 日本", "don't  stop <|endof"]
    want = [np.array(fresh.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert own.encode(texts) == want
    assert 50256 in np.frombuffer(want[1], dtype="<u4")


@pytest.mark.parametrize("piece,n", [("MIL//wIBAAKC", 90_000), ("b3BlbnNz", 130_000), ("30820100", 130_000), ("MIIEvQIBADAN", 90_000),
                                     ("eyJhbGciOiJI.", 80_000), ("30ff", 260_000)])
def test_dense_text_in_seconds(piece, n):
    start = time.time()
    secret_scan.find(piece * n)
    assert time.time() - start < 60, piece
