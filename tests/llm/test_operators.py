"""Operators on a small hard table against brute force, and on empty tables."""

import hashlib
import math
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest

from piisift.llm import (bpe_duck, exact, html_text, lattice_lm, licences, near, packing, quality, secret_scan,
                         token_files)
from piisift.llm.common import scratch

JSON_VOCAB = P.path("byte_bpe_50k.json")
LONG = " ".join(f"word{i % 977}x{i}" for i in range(9000))
PROSE = " ".join(f"w{i}" for i in range(120))
NEAR = PROSE.replace("w60 ", "changed ")
ROWS = [  # doc_id, text, source
    (1, None, "a"), (2, "", None), (3, " \t\n", "a"), (4, "a  b\n", "a"), (5, "a b ", "b"), (5, "a b ", "b"),
    (6, PROSE, "a"), (7, NEAR, "b"), (8, NEAR, "b"), (None, PROSE, None), (None, "alone here", "c"),
    (9, LONG, "a"), (10, LONG + " tail", "a"), (11, "token = abcdef0123456789abcdef0123456789 ok", "d"),
    (12, "日本語 テスト é", "d"), (13, "Released under the MIT License.", "lic"), (14, "plain text in there", "lic"),
    (15, "spam " * 50, "spam"), (16, "A a\nA a\nA a", "spam"), (17, "a\x00b   c", "d"),
]
#: names used inside the operators: an extra column of the input must not disturb them
CLASH = ["key", "t", "row", "h", "norm", "word", "digest", "comp", "b", "f", "host", "kept", "n_words", "spans", "ids",
         "start", "length", "salt", "rank", "path", "dir", "page", "token", "n", "c", "buckets", "size", "bucket", "depth"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, "en", len(r[1] or ""), *(f"x{i}" for i in range(len(CLASH)))) for r in ROWS]
    names = "doc_id long, text string, source string, lang string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)
    return spark.createDataFrame(rows, names).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def _rows(df):
    return [r.asDict() for r in df.collect()]


def _by_row(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def _library():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(JSON_VOCAB)
    t.encode_special_tokens = True
    return t


def _norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_packing(docs, empty):
    got = _rows(packing.pack_documents(docs, JSON_VOCAB))
    lib, want, total = _library(), Counter(), 0
    for d, t, _ in ROWS:
        ids = lib.encode(t or "", add_special_tokens=False).ids + [2]
        total += len(ids)
        at, k = 0, 0
        while at < len(ids):
            to = at + ((len(ids) - at) % 1024 or 1024)
            want[d, k, at, to - at, zlib.crc32(np.array(ids[at:to], "<u4").tobytes())] += 1
            at, k = to, k + 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= -(-total // 1024) + 2
    assert packing.pack_documents(empty, JSON_VOCAB).count() == 0


def test_packing_with_many_salts_keeps_places_apart(docs, monkeypatch):
    monkeypatch.setattr(packing, "SALTS", 3)
    got = _rows(packing.pack_documents(docs.unionByName(docs).unionByName(docs), JSON_VOCAB, size=64, with_ids=True))
    places = Counter((r["sequence_id"], r["offset"]) for r in got)
    assert max(places.values()) == 1 and all(len(r["ids"]) == 4 * r["length"] for r in got)


def test_token_files_round_trip(spark, docs, empty):
    folder = scratch(spark, "test-tokens")
    index = token_files.write_token_files(docs, folder, JSON_VOCAB)
    got = token_files.read_token_files(index, folder).collect()
    lib = _library()
    want = Counter((d, np.array(lib.encode(t or "", add_special_tokens=False).ids + [0], "<u4").tobytes()) for d, t, _ in ROWS)
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) // 4
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert ids[:2] == [None, None] and ids[2:] == sorted(ids[2:])
    one = token_files.read_token_files(index.filter("doc_id = 12"), folder).collect()  # short-document access
    assert len(one) == 1 and want[12, bytes(one[0]["ids"])] == 1
    folder = scratch(spark, "test-tokens")
    assert token_files.read_token_files(token_files.write_token_files(empty, folder, JSON_VOCAB), folder).count() == 0


def test_bpe_duck(docs, empty):
    got = bpe_duck.encode_documents(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    lib = _library()
    want = Counter((d, np.array(lib.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes(), (t or "").encode())
                   for d, t, _ in ROWS)
    assert Counter((r["doc_id"], bytes(r["ids"]), bytes(r["decoded"])) for r in got) == want
    assert bpe_duck.encode_documents(empty, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def _exact_want():
    groups = defaultdict(list)
    for d, t, _ in ROWS:
        groups[_norm(t)].append(d)
    want = Counter()
    for d, t, _ in ROWS:
        ids = groups[_norm(t)]
        keep = min((i for i in ids if i is not None), default=None)
        want[d, keep, len(ids), d == keep, hashlib.sha256(_norm(t).encode()).hexdigest()] += 1
    return want


@pytest.mark.parametrize("capacity", [1, 4096])
def test_exact_groups(docs, capacity):
    got = exact.exact_groups(docs, capacity=capacity)
    assert _by_row(got, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == _exact_want()


def test_exact_index_splits_overfull_buckets(spark):
    many = spark.range(500).selectExpr("id as doc_id", "concat('text ', id % 400) as text")
    _, index = exact.build_index(many, capacity=16)
    per = index.groupBy("bucket", "depth").count().collect()
    assert max(r["count"] for r in per) <= 16 and sum(r["count"] for r in per) == 400
    spans = sorted((r["bucket"], r["depth"]) for r in per)
    for (low, depth), (following, _) in zip(spans, spans[1:]):
        assert low + 2 ** (63 - depth) <= following  # ranges of keys do not overlap


def test_exact_chains_texts_that_share_a_key(spark, monkeypatch):
    from pyspark.sql import functions as F
    few = spark.createDataFrame([(i, f"t{i % 5}") for i in range(20)], "doc_id long, text string")
    monkeypatch.setattr(exact.F, "xxhash64", lambda *c: F.lit(7).cast("long"))  # every key collides
    got = exact.exact_groups(few).collect()
    assert all(r["keep_id"] == r["doc_id"] % 5 and r["group_size"] == 4 for r in got) and len(got) == 20


def test_exact_drop_and_empty(docs, empty):
    kept = exact.drop_copies(docs)
    assert kept.columns == docs.columns
    want = Counter((d, _norm(t)) for d, t, _ in ROWS)
    staying = {(d, h) for (d, k, n, s, h) in _exact_want() if s}
    assert Counter((r["doc_id"], hashlib.sha256(_norm(r["text"]).encode()).hexdigest()) for r in kept.collect()) == Counter(staying)
    assert len(want) > len(staying)
    assert exact.exact_groups(empty).count() == 0 and exact.drop_copies(empty).count() == 0


def test_near_groups(docs, empty):
    got = _rows(near.near_groups(docs))
    assert len(got) == len(ROWS)
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[6]["class_id"] == by[7]["class_id"] == by[8]["class_id"] == 6 and by[6]["class_size"] == 4  # and a row without id
    assert by[9]["class_id"] == by[10]["class_id"] == 9 and by[10]["kept"] is False
    assert {by[i]["class_id"] for i in (1, 2, 3)} == {1} and {by[i]["class_id"] for i in (4, 5)} == {4}
    for i in (11, 12, 13, 14, 15, 16, 17):
        assert by[i]["class_id"] == i and by[i]["kept"]
    assert sorted(r["class_size"] for r in got if r["doc_id"] is None) == [1, 4]
    staying = near.drop_near(docs)
    assert staying.columns == docs.columns
    # one row of each class; a row repeated with its id once
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in staying.collect()) == [-1, 1, 4, 6, 9, 11, 12, 13, 14, 15, 16, 17]
    assert near.near_groups(empty).count() == 0 and near.drop_near(empty).count() == 0


def test_near_groups_equal_brute_force(spark):
    import random
    rng = random.Random(11)
    vocabulary = [f"v{i}" for i in range(300)]
    texts = []
    for _ in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(6, 160))]
        for _ in range(rng.randint(1, 8)):
            copy = list(base)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    shared = [rng.choice(vocabulary) for _ in range(60)]  # a passage in many texts links none of them
    texts += [" ".join(shared + [rng.choice(vocabulary) for _ in range(60)]) for _ in range(60)]
    kmers = [near.shingles(near.words_of(t)) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if texts[i] == texts[j] or near.similarity(kmers[i], kmers[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near.near_groups(frame).collect()}
    assert got == dict(enumerate(label))


def _score_want():
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = lambda d: zlib.crc32(str("" if d is None else d).encode()) % 10 == 0
    counts, ends = Counter(), 0
    for d, t, _ in ROWS:
        if not held(d):
            counts.update(words(t))
            ends += 1
    total, distinct = sum(counts.values()) + ends, len(counts) + 1
    base = lambda c: math.log10((c + 0.1) / (total + 0.1 * (distinct + 1)))
    out = Counter()
    for d, t, _ in ROWS:
        w = words(t)
        out[d, held(d), len(w) + 1, sum(counts[x] > 0 for x in w) + 1, total,
            round(sum(base(counts[x]) for x in w) + base(ends), 5)] += 1
    return out


def test_scores(docs, empty, monkeypatch):
    path = P.path("piece_bpe_32k.model")
    columns = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens")
    all_ways = []
    for frequent in (100_000, 5):  # words scored where they are read, and words joined
        monkeypatch.setattr(lattice_lm, "FREQUENT_WORDS", frequent)
        got = lattice_lm.score_documents(docs, path).collect()
        assert Counter((*(r[c] for c in columns), round(r["base_score"], 5)) for r in got) == _score_want()
        assert all(r["score"] < 0 for r in got)
        all_ways.append(sorted(round(r["score"], 6) for r in got))
    assert all_ways[0] == all_ways[1]
    assert lattice_lm.score_documents(empty, path).count() == 0


def test_scores_learn_from_the_training_texts(spark):
    path = P.path("piece_bpe_32k.model")
    rows = [(i, " ".join(f"zorblax{k % 7} quindle" for k in range(i % 9 + 3))) for i in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r for r in lattice_lm.score_documents(frame, path).collect() if r["held_out"]]
    untrained = lattice_lm.pieces_of(path)
    start = untrained.start.tolist()
    for r in got:
        before = sum(lattice_lm.word_score(untrained, start, w) for w in rows[r["doc_id"]][1].split()) / lattice_lm.LN10
        assert r["score"] > before  # held-out texts of the kind become more likely


def test_secrets(docs, empty):
    got = secret_scan.scan_secrets(docs).collect()
    spans = Counter((r["doc_id"], tuple((s["kind"], s["start"], s["end"], s["base"]) for s in r["spans"])) for r in got)
    want = Counter()
    for d, t, _ in ROWS:
        base, every = secret_scan.find(t or "")
        want[d, tuple((k, a, b, (a, b, k) in base) for a, b, k in every)] += 1
    assert spans == want and sum(len(s) for _, s in spans) == 2
    out = secret_scan.redact(docs, length="n_chars")
    assert out.columns == docs.columns
    after = {r["doc_id"]: r for r in out.collect()}
    assert after[11]["text"] == "[SECRET] ok" and after[11]["n_chars"] == 11
    assert after[1]["text"] is None and after[2]["text"] == ""
    same = [(d, t) for d, t, _ in ROWS if d != 11]
    assert Counter((r["doc_id"], r["text"]) for r in out.collect() if r["doc_id"] != 11) == Counter(same)
    assert secret_scan.scan_secrets(empty).count() == 0 and secret_scan.redact(empty).count() == 0


def test_quality(docs, empty):
    got = quality.host_rules(docs)
    want = Counter()
    for d, t, _ in ROWS:
        m = quality.measure(t or "")
        want[d, *m[:5], m[0] < 20 or 100 * m[4] > 30 * m[0]] += 1
    assert _by_row(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want
    assert not any(r["kept"] and r["base_failed"] for r in got.collect())
    staying = quality.keep_documents(docs)
    assert staying.columns == docs.columns
    assert sorted(r["doc_id"] or -1 for r in staying.collect()) == [-1, 6, 7, 8, 9, 10]
    assert quality.host_rules(empty).count() == 0 and quality.keep_documents(empty).count() == 0


def test_quality_spares_clean_documents_of_bad_hosts(spark):
    clean = " ".join(f"clean{i}" for i in range(40))
    symbols = " ".join(f"# $ bad{i}" for i in range(40))
    rows = [(i, symbols, "bad") for i in range(30)] + [(100, clean, "bad"), (101, symbols, "good")]
    rows += [(200 + i, clean + f" t{i}", "good") for i in range(30)] + [(300 + i, clean, f"h{i}") for i in range(10)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r["doc_id"]: r["kept"] for r in quality.host_rules(frame).collect()}
    assert not any(kept[i] for i in range(30))  # a failing host: its strict failures go
    assert kept[100] and kept[101] and all(kept[i] for i in range(200, 230))


def test_licences(docs, empty):
    found = licences.scan_licences(docs.selectExpr("*", "concat('/', source, '/sub/', doc_id) as place"), "place")
    by = {r["doc_id"]: r for r in found.collect()}
    assert found.count() == len(ROWS)
    assert by[13]["licence"] == "MIT" and by[13]["via"] == "file" and by[13]["licence_dir"] == "/lic/sub"
    assert by[14]["licence"] == "MIT" and by[14]["via"] == "directory"
    assert by[6]["licence"] is None and by[1]["via"] is None
    assert licences.scan_licences(empty.withColumn("place", empty["source"]), "place").count() == 0


def test_licence_inheritance_takes_the_nearest_directory(spark):
    notice = dict(reversed(licences.TEMPLATES))
    rows = [(1, "/LICENSE", notice["Apache-2.0"]), (2, "/a/b/LICENSE", notice["MIT"]), (3, "/a/x.py", "print(1)"),
            (4, "/a/b/c/y.py", "print(2)"), (5, "/a/b/z.py", "# " + licences.TEMPLATES[-4][1] + "\n" + "code = 1\n" * 200),
            (6, None, "nowhere"), (7, "/top", None), (8, "/q/copy", "All rights\nCopyright 2020 nobody\nreserved")]
    frame = spark.createDataFrame(rows, "doc_id long, path string, text string")
    by = {r["doc_id"]: r for r in licences.scan_licences(frame, "path").collect()}
    assert (by[1]["licence"], by[1]["via"]) == ("Apache-2.0", "file") and (by[2]["licence"], by[2]["via"]) == ("MIT", "file")
    assert (by[3]["licence"], by[3]["licence_dir"]) == ("Apache-2.0", "") and (by[4]["licence"], by[4]["licence_dir"]) == ("MIT", "/a/b")
    assert by[5]["via"] == "header" and by[5]["licence"] == licences.TEMPLATES[-4][0]
    assert by[6]["licence"] is None and by[7]["licence"] == "Apache-2.0" and by[8]["licence"] == "Apache-2.0"


def test_licences_of_parts_names_and_whole_files(spark):
    def wrapped(text, width=70):
        return "\n".join("# " + line for line in textwrap.wrap(text, width))

    notice = dict(licences.NOTICES)
    full = dict(reversed(licences.full_texts()))
    prose = "This library parses tables quickly. Released under the MIT License. Bug reports are welcome at any time of day."
    headers = {  # path: (text, licence)
        "a": ("Copyright (c) 2021 Acme Corporation\nReleased under the MIT License.", "MIT"),
        "b": ("# Copyright 2020 The Authors. All rights reserved.\n# Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
        "c": ("# SPDX-License-Identifier: Apache-2.0\n" + "x = 1\n" * 90, "Apache-2.0"),
        "d": ("/* SPDX-License-Identifier: MIT */\n" + "int x;\n" * 90, "MIT"),
        "e": ("# SPDX-License-Identifier: GPL-2.0-or-later\n" + "x = 1\n" * 90, "GPL-2.0"),
        "f": ("# SPDX-License-Identifier: MIT OR Zlib and more\n" + "x = 1\n" * 90, "MIT OR Zlib"),
        "g": (prose, "MIT"),
        "h": ("This package is distributed under the terms of the GNU GPL version 3 and hosted by us", "GPL-3.0"),
        "i": ("# Copyright (c) 2019 J. Doe, Example Street 5\n" + wrapped(notice["MIT"]) + "\n" + "x = 1\n" * 90, "MIT"),
        "j": (wrapped(notice["LGPL-2.1"]) + "\n" + "x = 1\n" * 90, "LGPL-2.1"),
        "k": ("This is not licensed under the MIT license at all, ask the authors of this fine program before use", None),
        "l": ("# SPDX-License-Identifier: Foo-9\n" + "x = 1\n" * 90, "Foo-9"),
    }
    rows = [(i, f"/{k}/x.py", text) for i, (k, (text, _)) in enumerate(headers.items())]
    wholes = {f"/full{i}": name for i, name in enumerate(full)}
    rows += [(100 + i, f"/full{i}/COPYING", "Copyright (c) 2020 Some One\n\n" + text) for i, text in enumerate(full.values())]
    rows += [(200 + i, f"/full{i}/src/y.py", "y = 2") for i in range(len(full))]
    frame = spark.createDataFrame(rows, "doc_id long, path string, text string")
    by = {r["path"]: r for r in licences.scan_licences(frame, "path").collect()}
    assert {k: by[f"/{k}/x.py"]["licence"] for k in headers} == {k: want for k, (_, want) in headers.items()}
    assert {d: (by[d + "/COPYING"]["licence"], by[d + "/COPYING"]["via"]) for d in wholes} == {
        d: (name, "file") for d, name in wholes.items()}
    assert {d: (by[d + "/src/y.py"]["licence"], by[d + "/src/y.py"]["licence_dir"]) for d in wholes} == {
        d: (name, d) for d, name in wholes.items()}
    assert by["/a/x.py"]["via"] == "file" and by["/c/x.py"]["via"] == "header" and by["/g/x.py"]["via"] == "header"


def _page(i, body, extra=""):
    return (f"<html><head><title>x</title></head><body><nav><a href='/'>Home {i}</a></nav><div class='ad'>Buy {i}</div>"
            f"{body}<footer>&copy; {i}</footer>{extra}</body></html>")


def test_pages(spark):
    rows = [(i, "http://A.example.com:80/x", _page(i, f"<article><h1>T{i}</h1><p>Body &lt;{i}&gt;\n text<p>the same line</article>"), "c")
            for i in range(8)]
    # a host whose containers carry no names: the evidence of its pages decides
    rows += [(100 + i, "https://b.example.org/", f"<body><div><ul><li><a href=1>One</a><li><a href=2>Two {i}</a></ul></div>"
              f"<div><div>Fixed words of the site</div><section><p>{'long words of page %d ' % i * 20}</section></div></body>", "c")
             for i in range(8)]
    rows += [(200, None, None, "c"), (201, "", "", "c"), (202, "http://one.example/", "just text", "c"),
             (203, "http://A.example.com/", _page(9, "<article><p>cut off <b>here"), "c"),
             (204, "http://A.example.com/", "<p>" + "long " * 20000, "c"), (0, rows[0][1], rows[0][2], "c")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    out = html_text.extract_pages(frame).collect()
    by = {r["page_id"]: r["text"] for r in out}
    assert len(out) == len(rows)
    for i in range(8):
        assert by[i] == f"T{i}\nBody <{i}> text\nthe same line"
        assert by[100 + i] == ("long words of page %d " % i * 20).strip()
    assert by[200] == by[201] == "" and by[202] == "just text" and by[203].startswith("cut off here")
    assert by[204] == ("long " * 20000).strip()
    assert html_text.extract_pages(frame.limit(0)).count() == 0


def test_cosine_before_names(spark):
    """A notice that the cosine finds outranks licences named beside it; a name that is denied counts for nothing."""
    mit = dict(licences.full_texts())["MIT"]
    texts = {"a": (mit + "\nParts are released under the Apache License 2.0", "MIT"),
             "b": ("We never said this is distributed under the GPL version 2", None),
             "c": ("Our competitor's tool is licensed under the MIT License", None),
             "d": ("Released under the Apache License 2.0", "Apache-2.0"),
             "e": ("x = 1  # SPDX-License-Identifier: MPL-2.0", "MPL-2.0")}
    frame = spark.createDataFrame([(i, f"/{k}/x.py", t) for i, (k, (t, _)) in enumerate(texts.items())], "doc_id long, path string, text string")
    by = {r["path"][1]: r["licence"] for r in licences.scan_licences(frame, "path").collect()}
    assert by == {k: want for k, (_, want) in texts.items()}
