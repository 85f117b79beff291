"""Conversation repair: every sequence of edits by brute force, chunked search against whole, runs over many tasks."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from piisift.llm import dialogue

FULL = re.compile("[^\x20\x09-\x0d]")


def all_edits(turns, fault):
    """(cost, audit, lines) of every sequence of edits with at most two insertions at a place."""
    if not turns:
        for n in range(3):
            for roles in itertools.product(("user", "assistant"), repeat=n):
                yield 3 * n, "I" * n, [(r, "") for r in roles]
        return
    rest = list(all_edits(turns[1:], fault[1:]))
    role, text = turns[0]
    own = [(4, "D", [])]
    if fault[0] not in ("blank", "duplicate"):
        extra = 3 * (fault[0] == "truncated")
        own += [(extra, "K", [(role, text)])] + [(3 + extra, "R", [(r, text)]) for r in ("user", "assistant")]
    for n in range(3):
        for roles in itertools.product(("user", "assistant"), repeat=n):
            for c, a, x in own:
                for cost, audit, lines in rest:
                    yield 3 * n + c + cost, "I" * n + a + audit, [(r, "") for r in roles] + x + lines


def expected(turns):
    """Results for rows (turn, role, text) in order."""
    seen, fault = set(), []
    for _t, role, text in turns:
        solid = FULL.findall(text)
        fault.append("blank" if not solid else "duplicate" if (role, text) in seen else
                     "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    good = [e for e in all_edits([(r, x) for _t, r, x in turns], fault)
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _x in e[2])) and all(r for r, _x in e[2])]
    cost, audit, lines = min(good, key=lambda e: (e[0], e[1]))
    numbers = [t for t, _r, _x in turns if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    initials = [r[:1] for _t, r, _x in turns]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    sha = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in lines).encode()).hexdigest()
    return (gaps, *(fault.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha)


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        mine = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        mine += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return {c: sorted(ts, key=lambda t: (t[0] is not None, t[0] or 0)) for c, ts in out.items()}


def results(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, kinds string, seq int")
    whole, many = dialogue.repair(dialogue.damage(df.repartition(3)), **kw)
    out = {}
    for r in whole.collect():
        sha = hashlib.sha256("\n".join(f"{x['role']}:{x['text']}" for x in r["repaired"]).encode()).hexdigest()
        out[r["conv"]] = (*r[1:-1], sha)
    for r in many.collect():
        assert r["conv"] not in out
        out[r["conv"]] = tuple(r)[1:]
    return out


def conversations(seed, n, turns):
    rnd = random.Random(seed)
    rows = []
    for conv in range(n):
        at = 0
        for _ in range(rnd.randrange(1, turns + 1)):
            rows.append((conv, at, rnd.choice(["user", "assistant", "system", "user", "assistant", "tool", None, ""]),
                         rnd.choice(["a.", "b!", "c? ", "cut", " \n", "", None, "d.\x0b", "é", f"{rnd.random()}."])))
            at += rnd.choice([1, 1, 1, 2])
    return rows


def test_every_edit_by_brute_force(spark):
    rows = conversations(1, 150, 4) + [(None, 1, "user", "hello."), (None, None, "user", "first."), (500, None, "system", "only.")]
    want = {c: expected(ts) for c, ts in damaged(rows).items()}
    assert results(spark, rows) == want
    assert results(spark, rows, chunk=1, run_rows=1) == want


@pytest.mark.parametrize("chunk", [1, 2, 5, 32])
def test_chunks_give_the_vectors_of_one_search(chunk):
    rnd = random.Random(chunk)
    for _ in range(300):
        kinds = "".join(rnd.choice(rnd.choice(["suaxSUAXD", "uaua", "xx", "ssx", "DD"])) for _ in range(rnd.randrange(70)))
        whole = dialogue.backward(kinds, dialogue.END, 10_000)
        assert dialogue.backward(kinds, dialogue.END, chunk) == whole
        assert dialogue.walk(kinds, dialogue.backward(kinds, dialogue.END, chunk), 0) == dialogue.walk(kinds, whole, 0)


def test_vectors_are_few():
    known, new = {dialogue.END}, [dialogue.END]
    while new:
        v = new.pop()
        for kind in "suaxSUAXD":
            w = dialogue.back(v, kind)[0]
            if w not in known:
                known.add(w)
                new.append(w)
    assert len(known) < 100 and max(map(max, known)) <= 10


def test_one_conversation_of_most_rows(spark):
    """Runs of one conversation over many tasks, repeats among them, against one run."""
    rnd = random.Random(9)
    rows = [(1, i // 2, rnd.choice(["user", "assistant", "tool", "system"]), rnd.choice(["a.", "b", f"{i}.", f"{i}"])) for i in range(3000)]
    rows += [(1, 7, "tool", "same.")] * 300 + conversations(3, 40, 6)
    one = results(spark, rows, run_rows=10**6, run_bytes=10**9)
    assert results(spark, rows, run_rows=50) == one
    assert results(spark, rows, chunk=3, run_bytes=200) == one
    assert one[1][2] > 300 and len(one[1][6]) >= 3000


def test_long_text_and_empty_table(spark):
    rows = [(1, 0, "user", "x" * 3_000_000 + "."), (1, 2, "assistant", "y." * 1_000_000), (2, 0, "user", "q.")]
    assert results(spark, rows) == {c: expected(ts) for c, ts in damaged(rows).items()}
    assert results(spark, []) == {}


def test_query_equals_plain_damage(spark):
    import __spark_entry__ as entry
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"))
           for r in entry.queries()["op12_dialogue_repair"](spark, sf).collect()}
    want = damaged(rows)
    assert set(got) == set(want)
    short = {c: ts for c, ts in want.items() if len(ts) <= 5}
    assert short and all(got[c] == expected(ts) for c, ts in short.items())
