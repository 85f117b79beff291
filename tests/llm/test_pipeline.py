"""The pipeline against a brute-force version, and its contract."""

import re
import zlib

import numpy as np
import public_tokenizers as P

import corpus_pipeline
from piisift.llm import near, quality, secret_scan


def _documents(spark, folder, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/documents.parquet")


def _rows():
    import random
    rng = random.Random(2)
    words = [f"w{i}" for i in range(500)]
    rows = []
    for i in range(60):
        text = [rng.choice(words) for _ in range(rng.randint(5, 300))]
        rows.append((i, " ".join(text)))
        if i % 5 == 0:
            rows.append((1000 + i, "  ".join(text)))  # an exact copy but for white space
        if i % 7 == 0 and len(text) > 60:
            rows.append((2000 + i, " ".join([*text[:30], "changed", *text[31:]])))
        if i % 9 == 0:
            rows.append((3000 + i, " ".join([*text, "password=abcdef123456", *(rng.choice(words) for _ in range(20))])))
    rows += [(4000, None), (4001, ""), (4002, "again and again " * 40), (0, rows[0][1]), (None, "nobody " + " ".join(words[:40]))]
    return [(d, t, "en", "s", len(t or "")) for d, t in rows]


def test_pipeline_equals_brute_force(spark, tmp_path):
    rows = _rows()
    _documents(spark, str(tmp_path), rows)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    def passes(text):
        m = quality.measure(text or "")
        base = m[0] < quality.MIN_WORDS or 100 * m[4] > quality.MAX_REPEAT_PERCENT * m[0]
        return not base  # one host, few of whose texts fail
    texts = {}
    for d, t, *_ in rows:
        if passes(t):
            texts.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), []).append((d is None, d or 0, t))
    left = [min(v) for v in texts.values()]
    kmers = [near.shingles(near.words_of(t)) for _, _, t in left]
    label = list(range(len(left)))
    for i in range(len(left)):
        for j in range(i):
            if near.similarity(kmers[i], kmers[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    final = [min(left[i] for i in range(len(left)) if label[i] == c) for c in set(label)]
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = {}
    for null, d, t in final:
        ids = lib.encode(secret_scan.masked(t, secret_scan.find(t)[1]), add_special_tokens=False).ids + [2]
        want[None if null else d] = (len(ids), zlib.crc32(np.array(ids[:len(ids) % 1024 or 1024], "<u4").tobytes()))
    assert {r["doc_id"] for r in got} == set(want)
    for r in got:
        if r["piece"] == 0:
            assert r["ids_crc32"] == want[r["doc_id"]][1]
    assert sum(r["length"] for r in got) == sum(n for n, _ in want.values())
    assert any("password" in t for _, _, t in final)


def test_stages_keep_the_columns_and_accept_empty_tables(spark, tmp_path):
    _documents(spark, str(tmp_path), _rows())
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact", "near", "secrets", "packing"]
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, str(tmp_path))
        assert out.count() == 0
        if name != "packing":
            assert out.columns == docs.columns
