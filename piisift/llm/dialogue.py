"""Repair of conversations by a parallel Viterbi search over their turns.

A conversation's turns are edited, at least cost, until the initials of their roles read ``(s?(ua)+)?``: turns
are kept (0), get the role user or assistant (3), are deleted (4; blank and repeated turns must be), or empty
user/assistant turns are inserted (3); a turn whose text breaks off costs 3 more unless it is deleted.  Of equally
cheap edits those whose letters D, I, K, R in order are least in ASCII are taken.

States are what was emitted last (nothing, s, u, a).  Backward costs (cheapest way to the end from each state) are
computed in chunks of turns that all start at once, each from a speculative cost vector.  Two vectors that differ
only by a constant lead to the same edits, so vectors are kept less their minimum.  Fix-up then hands each chunk the
vector that really reaches its end and reruns it from there only until its vectors agree again with those
it had.  Stitched, the vectors of all turns drive one forward walk that takes the least letter among the optimal ones.

Turns are sorted over range partitions by conversation, turn, role, a hash of the text and row number, so a
conversation of a third of all rows lies on many tasks, as runs of at most ``RUN_ROWS`` turns.  Conversations that
lie whole inside one task are done there.  The runs of all others meet by small summaries: repeats by (conversation,
digest) keys counted per run first, cost vectors and states by chains over the runs of a conversation.  A pass
answers, for every run, the vectors that any chain has met; the passes end when no chain meets a new one, which
happens after a few, since a vector has four numbers of at most 10.

Defined cases: null role or text is one space; null turns come first and take no part in ``gaps``; turns of equal number
come by role, then hash of text; rows repeated whole are repeats of the first; conversations with null id are one
conversation; one all of whose rows are gone has zeros and empty results; an empty table gives no row; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_range, table, written

#: Turns per speculative chunk; turns and bytes of a run.
CHUNK, RUN_ROWS, RUN_BYTES = 32, 16_384, 4 << 20

#: States: nothing emitted, s, u, a.  What an inserted or renamed turn leads to, and what a kept one does.
NEXT = (2, 2, 3, 2)
KEEP = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None), "x": (None,) * 4}
ROLE = {2: "user", 3: "assistant"}
RENAME, DELETE, INSERT, BROKEN = 3, 4, 3, 3
#: Costs to end from each state, and the letters that do it.
END, TAIL = (0, 6, 3, 0), ("", "II", "I", "")

_FULL = re.compile("[^\x20\x09-\x0d]")
_BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"

Vector = tuple[int, int, int, int]


@lru_cache(maxsize=None)
def options(after: Vector, kind: str, state: int) -> list[tuple[int, str, int]]:
    """(cost to the end, letter, next state) of the ways to take a turn from a state, without insertions."""
    out = [(DELETE + after[state], "D", state)]
    if kind != "D":
        more = BROKEN if kind.isupper() else 0
        kept = KEEP[kind.lower()][state]
        if kept is not None:
            out.append((more + after[kept], "K", kept))
        out.append((RENAME + more + after[NEXT[state]], "R", NEXT[state]))
    return out


@lru_cache(maxsize=None)
def back(after: Vector, kind: str) -> tuple[Vector, tuple[int, ...]]:
    """The vector before a turn, less its minimum, and as it is relative to ``after``."""
    costs = [min(options(after, kind, s))[0] for s in range(4)]
    for _ in range(2):  # an insertion may come first, even two
        costs = [min(c, INSERT + costs[NEXT[s]]) for s, c in enumerate(costs)]
    low = min(costs)
    return tuple(c - low for c in costs), tuple(costs)


@lru_cache(maxsize=None)
def least(after: Vector, kind: str, state: int) -> tuple[str, int]:
    """Least optimal letters for a turn from a state (insertions before it included), and the state they lead to."""
    costs = back(after, kind)[1]
    letters = ""
    while True:
        best = {letter: to for cost, letter, to in options(after, kind, state) if cost == costs[state]}
        if "D" in best:
            return letters + "D", best["D"]
        if costs[state] == INSERT + costs[NEXT[state]]:
            letters, state = letters + "I", NEXT[state]
            continue
        letter = min(best)
        return letters + letter, best[letter]


def backward(kinds: str, end: Vector = END, chunk: int = CHUNK) -> list[Vector]:
    """Vectors before each turn and after the last, by speculative chunks and fix-up."""
    vectors: list[Vector] = [END] * (len(kinds) + 1)
    starts = range(0, len(kinds), chunk)
    speculated = {}
    for at in starts:  # every chunk begins at its end from the same guess
        v, stop = END, min(at + chunk, len(kinds))
        own = [v]
        for kind in reversed(kinds[at:stop]):
            v = back(v, kind)[0]
            own.append(v)
        speculated[at] = own[::-1]
    real = end
    for at in reversed(starts):  # fix-up: rerun from the real vector until it is parallel to the guess
        own = speculated[at]
        i = len(own) - 1
        while own[i] != real:
            own[i] = real
            if i == 0:
                break
            i -= 1
            real = back(real, kinds[at + i])[0]
        vectors[at:at + len(own)] = own
        real = own[0]
    vectors[len(kinds)] = end
    return vectors


def walk(kinds: str, vectors: list[Vector], state: int) -> tuple[list[str], int]:
    """Letters for each turn, and the state after the last, along the least optimal audit."""
    out = []
    for kind, after in zip(kinds, vectors[1:]):
        letters, state = least(after, kind, state)
        out.append(letters)
    return out, state


def digest(role: str, text: str) -> bytes:
    r = role.encode("utf-8", "surrogatepass")
    return hashlib.blake2b(len(r).to_bytes(8, "little") + r + text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def faults(turns: list[tuple], earlier: set[bytes] = frozenset()) -> tuple[str, int, int, int]:
    """(kinds, blank, duplicate, truncated) of (turn, role, text) rows; ``earlier`` has digests of turns before them."""
    seen, kinds, counts = set(), [], [0, 0, 0]
    for _turn, role, text in turns:
        if not _FULL.search(text):
            counts[0] += 1
            kinds.append("D")
            continue
        kind = role[:1] if role[:1] in ("s", "u", "a") else "x"
        if (role, text) in seen or (earlier and digest(role, text) in earlier):
            counts[1] += 1
            kind = "D"
        elif text.rstrip(_BLANKS)[-1] not in ".!?":
            counts[2] += 1
            kind = kind.upper()
        seen.add((role, text))
        kinds.append(kind)
    return "".join(kinds), *counts


def repaired(turns: list[tuple], kinds: str, letters: list[str], state: int) -> tuple[list[tuple[str, str]], int]:
    """(role, text) of the turns that the letters leave, and what the letters cost, from a state on."""
    out, cost = [], 0
    for (_turn, role, text), kind, each in zip(turns, kinds, letters):
        for letter in each:
            if letter == "D":
                cost += DELETE
                continue
            if letter == "I":
                state, cost = NEXT[state], cost + INSERT
                out.append((ROLE[state], ""))
                continue
            cost += BROKEN if kind.isupper() else 0
            if letter == "K":
                state = KEEP[kind.lower()][state]
                out.append((role, text))
            else:
                state, cost = NEXT[state], cost + RENAME
                out.append((ROLE[state], text))
    return out, cost


def tail(state: int) -> tuple[str, list[tuple[str, str]], int]:
    """Letters, turns and cost of ending from a state."""
    out = []
    for _ in TAIL[state]:
        state = NEXT[state]
        out.append((ROLE[state], ""))
    return "I" * len(out), out, INSERT * len(out)


def shape(turns: list[tuple]) -> dict:
    """Numbers of a run that add up over the runs of a conversation."""
    numbers = [t for t, _r, _x in turns if t is not None]
    initials = [r[:1] for _t, r, _x in turns]
    return {"lowest": min(numbers, default=None), "highest": max(numbers, default=None), "distinct": len(set(numbers)),
            "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            "first": initials[0] if turns else None, "final": initials[-1] if turns else None}


def joined_shapes(a: dict | None, b: dict) -> dict:
    """The numbers of two neighbouring runs as those of one; turns are in order, nulls first."""
    if a is None or a["first"] is None:
        return b
    if b["first"] is None:
        return a
    met = a["highest"] is not None and a["highest"] == b["lowest"]
    return {"lowest": b["lowest"] if a["lowest"] is None else a["lowest"],
            "highest": a["highest"] if b["highest"] is None else b["highest"],
            "distinct": a["distinct"] + b["distinct"] - met,
            "illegal": a["illegal"] + b["illegal"] + (a["final"] + b["first"] not in ("su", "ua", "au")),
            "first": a["first"], "final": b["final"]}


def gaps(s: dict) -> int:
    return 0 if s["lowest"] is None else s["highest"] - s["lowest"] + 1 - s["distinct"]


_TURNS = pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]))
_LINES = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_RESULT = [("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()),
           ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired", _LINES)]
RESULT = ("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
          "repaired array<struct<role:string,text:string>>")
TURNS = "array<struct<turn:long,role:string,text:string>>"
_MEMO = pa.list_(pa.struct([("vec", pa.string()), ("out", pa.string()), ("ends", pa.list_(pa.int32()))]))
MEMO = "array<struct<vec:string,out:string,ends:array<int>>>"


def _rows(rows: list[tuple], fields: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, (_n, t) in zip(zip(*rows), fields)], schema=pa.schema(fields))


def _whole(turns: list[tuple], chunk: int) -> tuple:
    """RESULT of a conversation that lies in one task."""
    kinds, blank, duplicate, truncated = faults(turns)
    letters, state = walk(kinds, backward(kinds, END, chunk), 0)
    lines, cost = repaired(turns, kinds, letters, 0)
    more, added, extra = tail(state)
    s = shape(turns)
    return gaps(s), blank, duplicate, truncated, s["illegal"], cost + extra, "".join(letters) + more, lines + added


def _sort_task(conv_type: pa.DataType, chunk: int, run_rows: int, run_bytes: int):
    """Whole conversations done, the first and last of a task and long ones as runs of turns."""
    fields = [("conv", conv_type), ("seq", pa.int64()), ("turns", _TURNS), *_RESULT]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        conv, turns, size, open_run, started, out = None, [], 0, True, False, []

        def close(is_open: bool) -> None:
            nonlocal number
            dicts = [{"turn": t, "role": r, "text": x} for t, r, x in turns] if is_open else None
            out.append((conv, (part << 32) + number if is_open else None, dicts, *((None,) * 8 if is_open else _whole(turns, chunk))))
            number += 1

        for batch in batches:
            for c, turn, role, text, gone in zip(*(col.to_pylist() for col in batch.columns)):
                if started and c != conv:
                    close(open_run)
                    turns, size, open_run = [], 0, False
                conv = c
                started = True
                if gone:
                    continue
                if len(turns) >= run_rows or (turns and size + len(text) > run_bytes):
                    open_run = True
                    close(True)
                    turns, size = [], 0
                turns.append((turn, role, text))
                size += len(text)
            if out:
                yield _rows(out, fields)
                out = []
        if started:
            close(True)
            yield _rows(out, fields)

    return run


def _tuples(turns: list[dict]) -> list[tuple]:
    return [(t["turn"], t["role"], t["text"]) for t in turns]


def _text(v: Vector) -> str:
    return ",".join(map(str, v))


def _vector(s: str) -> Vector:
    return tuple(map(int, s.split(",")))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct digests of each run's turns with text."""
    for batch in batches:
        for i, turns in enumerate(batch.column(2).to_pylist()):
            own = {digest(t["role"], t["text"]) for t in turns if _FULL.search(t["text"])}
            yield pa.record_batch([batch.column(0).take(pa.array([i] * len(own), pa.int64())),
                                   pa.array([batch.column(1)[i].as_py()] * len(own), pa.int64()),
                                   pa.array(sorted(own), pa.binary())], ["conv", "seq", "digest"])


def _mark(conv_type: pa.DataType):
    """Kinds of each run's turns, repeats of earlier runs known."""
    fields = [("conv", conv_type), ("seq", pa.int64()), ("turns", _TURNS), ("kinds", pa.string()),
              ("faults", pa.list_(pa.int64()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for conv, seq, turns, earlier in zip(*(c.to_pylist() for c in batch.columns)):
                kinds, *counts = faults(_tuples(turns), set(earlier or ()))
                yield _rows([(conv, seq, turns, kinds, counts)], fields)

    return run


def _pass(conv_type: pa.DataType, vectors: list[str], chunk: int):
    """For each run and each vector that may reach its end: the vector before it, and where each state leads."""
    fields = [("conv", conv_type), ("seq", pa.int64()), ("memo", _MEMO)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for conv, seq, kinds in zip(*(c.to_pylist() for c in batch.columns)):
                memo = []
                for v in vectors:
                    all_vectors = backward(kinds, _vector(v), chunk)
                    memo.append({"vec": v, "out": _text(all_vectors[0]),
                                 "ends": [walk(kinds, all_vectors, s)[1] for s in range(4)]})
                yield _rows([(conv, seq, memo)], fields)

    return run


def _by_conversation(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows of each conversation, from rows sorted by it."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and held[0][0] != row[0]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vector at the end and state at the start of every run, or the vector that a conversation lacks."""
    fields = [("seq", pa.int64()), ("vec", pa.string()), ("state", pa.int32()), ("missing", pa.string())]
    for runs in _by_conversation(batches):
        want, taken = _text(END), []
        for _conv, seq, memo in reversed(runs):
            known = {m["vec"]: m for m in memo}
            if want not in known:
                yield _rows([(None, None, None, want)], fields)
                break
            taken.append((seq, known[want]))
            want = known[want]["out"]
        else:
            state, out = 0, []
            for seq, m in reversed(taken):
                out.append((seq, m["vec"], state, None))
                state = m["ends"][state]
            yield _rows(out, fields)


def _pieces(conv_type: pa.DataType, chunk: int):
    """Letters, lines and numbers of each run, its vector and state known."""
    fields = [("conv", conv_type), ("seq", pa.int64()), ("state", pa.int32()), ("cost", pa.int64()), ("audit", pa.string()),
              ("lines", _LINES), ("faults", pa.list_(pa.int64())), ("lowest", pa.int64()), ("highest", pa.int64()),
              ("distinct", pa.int64()), ("illegal", pa.int64()), ("first", pa.string()), ("final", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for conv, seq, turns, kinds, counts, vec, state in zip(*(c.to_pylist() for c in batch.columns)):
                rows = _tuples(turns)
                letters, end = walk(kinds, backward(kinds, _vector(vec), chunk), state)
                lines, cost = repaired(rows, kinds, letters, state)
                lines = [{"role": r, "text": t} for r, t in lines]
                yield _rows([(conv, seq, end, cost, "".join(letters), lines, counts, *shape(rows).values())], fields)

    return run


PIECES = ("seq long, state int, cost long, audit string, lines array<struct<role:string,text:string>>, faults array<long>, "
          "lowest long, highest long, distinct long, illegal long, first string, final string")


def _line(role: str, text: str) -> bytes:
    return f"{role}:{text}".encode("utf-8", "surrogatepass")


def _stitch(conv_type: pa.DataType):
    """One row per conversation of many runs; its lines are hashed in order and never held together."""
    names = ["lowest", "highest", "distinct", "illegal", "first", "final"]
    fields = [("conv", conv_type), *_RESULT[:-1], ("repaired_sha256", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # conv, state, numbers, hash
        for batch in batches:
            for conv, _seq, state, cost, audit, lines, counts, *numbers in zip(*(c.to_pylist() for c in batch.columns)):
                if held is None or held["conv"] != conv:
                    if held is not None:
                        yield end(held)
                    held = {"conv": conv, "shape": None, "cost": 0, "audit": [], "faults": [0, 0, 0], "sha": hashlib.sha256(), "n": 0}
                held["state"], held["cost"] = state, held["cost"] + cost
                held["shape"] = joined_shapes(held["shape"], dict(zip(names, numbers)))
                held["audit"].append(audit)
                held["faults"] = [a + b for a, b in zip(held["faults"], counts)]
                add(held, [(x["role"], x["text"]) for x in lines])
        if held is not None:
            yield end(held)

    def add(held: dict, lines: list[tuple[str, str]]) -> None:
        for role, text in lines:
            held["sha"].update((b"\n" if held["n"] else b"") + _line(role, text))
            held["n"] += 1

    def end(held: dict) -> pa.RecordBatch:
        letters, lines, extra = tail(held["state"])
        add(held, lines)
        return _rows([(held["conv"], gaps(held["shape"]), *held["faults"], held["shape"]["illegal"], held["cost"] + extra,
                       "".join(held["audit"]) + letters, held["sha"].hexdigest())], fields)

    return run


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn, role, text, gone: every row damaged by a checksum of its ids (a dropped one stays, marked gone)."""
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col(conv).cast("string"), space), F.lit(":"), F.coalesce(F.col(turn).cast("string"), space))
    rows = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), space).alias("role"),
                       F.coalesce(F.col(text), space).alias("text"), (F.crc32(name.cast("binary")) % 20).alias("h"))
    return rows.select(
        "conv", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("h") <= 1, "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (F.col("h") == 0).alias("gone"),
        F.explode(F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def repair(rows: DataFrame, chunk: int = CHUNK, run_rows: int = RUN_ROWS, run_bytes: int = RUN_BYTES) -> tuple[DataFrame, DataFrame]:
    """(conversations with their repaired turns, conversations of many runs with the hash of theirs).

    ``rows``: conv, turn, role, text, gone (see :func:`damage`).  Both results have conv, gaps, blank, duplicate,
    truncated, illegal, cost and audit; the first has ``repaired``, the second ``repaired_sha256``.
    """
    conv_sql = rows.schema["conv"].dataType.simpleString()
    conv_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[conv_sql]
    keys = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("hash"), F.col("row")]
    known = rows.select("conv", F.col("turn").cast("long").alias("turn"), "role", "text", "gone", F.xxhash64("text").alias("hash"),
                        F.monotonically_increasing_id().alias("row"))
    dealt = by_range(known, *keys).sortWithinPartitions(*keys).select("conv", "turn", "role", "text", "gone")
    done = written(dealt.mapInArrow(_sort_task(conv_type, chunk, run_rows, run_bytes),
                                    f"conv {conv_sql}, seq long, turns {TURNS}, {RESULT}"), "dialogue-runs")
    open_runs = done.filter("seq is not null").select("conv", "seq", "turns")
    # repeats of turns in earlier runs: one key per run and text, so a text of a third of all turns is one row per run
    own = open_runs.mapInArrow(_digests, f"conv {conv_sql}, seq long, digest binary")
    own = written(own, "dialogue-digests")
    first = own.groupBy(F.col("conv").alias("of"), F.col("digest").alias("same")).agg(F.min("seq").alias("start"))
    later = own.join(first, F.col("conv").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("same")) & (F.col("seq") > F.col("start")))
    earlier = later.groupBy(F.col("seq").alias("run")).agg(F.collect_list("digest").alias("earlier"))
    marked = written(open_runs.join(earlier, F.col("seq") == F.col("run"), "left").select("conv", "seq", "turns", "earlier")
                     .mapInArrow(_mark(conv_type), f"conv {conv_sql}, seq long, turns {TURNS}, kinds string, faults array<long>"),
                     "dialogue-marked")
    vectors = [_text(END)]
    while True:  # as many passes as there are new vectors, which are few
        memo = marked.select("conv", "seq", "kinds").mapInArrow(_pass(conv_type, vectors, chunk), f"conv {conv_sql}, seq long, memo {MEMO}")
        chains = written(memo.repartition("conv").sortWithinPartitions("conv", "seq")
                         .mapInArrow(_chain, "seq long, vec string, state int, missing string"), "dialogue-chains")
        missing = sorted(r[0] for r in chains.select("missing").filter("missing is not null").distinct().collect())
        if not missing:
            break
        vectors += missing
    found = chains.select(F.col("seq").alias("run"), "vec", "state")
    pieces = (marked.join(found, F.col("seq") == F.col("run")).select("conv", "seq", "turns", "kinds", "faults", "vec", "state")
              .mapInArrow(_pieces(conv_type, chunk), f"conv {conv_sql}, {PIECES}"))
    many = pieces.repartition("conv").sortWithinPartitions("conv", "seq").mapInArrow(
        _stitch(conv_type), f"conv {conv_sql}, {RESULT.split(', repaired')[0]}, repaired_sha256 string")
    return done.filter("seq is null").drop("seq", "turns"), many


def op12_dialogue_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damage and repair of every conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256."""
    whole, many = repair(damage(table(spark, sf_dir, "conversations")))
    line = F.array_join(F.transform("repaired", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")
    whole = whole.withColumn("repaired_sha256", F.sha2(line.cast("binary"), 256)).drop("repaired")
    return whole.unionByName(many).withColumnRenamed("conv", "conv_id")
