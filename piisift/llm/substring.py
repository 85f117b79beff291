"""Removal of repeated passages by level-wise doubling of word windows.

A window is a run of consecutive words of one document.  Level one asks, for every window of a short
length, whether its word sequence also starts anywhere else; only windows repeated at one length are
extended to (at most) twice that length and asked again, until the asked length is reached or no candidate
survives.  A word goes when a repeated window of the asked length covers it.

Work is divided by Spark twice per level.  Tasks that own documents hash windows and send each distinct
hash of a block of documents once, to the bucket that owns the hash (``repartition`` by bucket).  Owners find the hashes that
came from more than one block and answer with one bit per hash; the answers go back to the documents'
tasks (``repartition`` by part).  A passage found in a third of all documents is therefore one hash per block
and never meets in one group of rows; no pairs are made.  Documents are copied once to the shared folder, so
each later level re-reads the same rows in the same order and carries no text through a shuffle.

Sieve levels compare the bucket and 40 bits of a hash, the last level the bucket and 80 bits: two different
windows of 35 words among 10^13 pass for equal with a probability below one in a hundred.

Defined cases: null text and text without a word have no words and keep the empty string; texts shorter than
the window lose nothing; equal texts, rows repeated with their key included, lose all words that a window covers;
rows come out one for one, null keys too; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, store_of, table, written

#: Words of a window, and the longest window of the first level.
WINDOW, FIRST_LEVEL = 35, 10
#: Bytes of text handled together in a task, and hashed at once.
BLOCK_BYTES, PIECE_BYTES = 8 << 20, 1 << 20
#: Bytes of text per bucket of hashes (about eight million windows), and the fewest buckets.
BUCKET_BYTES, MIN_BUCKETS = 48 << 20, 24

_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_IS_BLANK = np.zeros(256, dtype=bool)
_IS_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOW40 = np.uint64((1 << 40) - 1)
#: Two independent lanes of word hashes: random values of bytes, an odd base and its inverse modulo 2^64.
_RANDOM = np.random.default_rng(20240611)
_LANES = []
for _ in range(2):
    _base = int(_RANDOM.integers(1 << 62, dtype=np.uint64)) | 5
    _LANES.append((_RANDOM.integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1),
                   _base, pow(_base, -1, 1 << 64)))
_POWERS: dict[int, np.ndarray] = {}

WIRE = "bucket long, part long, block long, data binary, file string"
_WIRE = pa.schema([("bucket", pa.int64()), ("part", pa.int64()), ("block", pa.int64()), ("data", pa.binary()),
                   ("file", pa.string())])


def level_lengths(window: int = WINDOW, first: int = FIRST_LEVEL) -> list[int]:
    """Lengths of the levels, each at most twice the one before, ending at ``window``."""
    out = [window]
    while out[-1] > max(1, first):
        out.append((out[-1] + 1) // 2)
    return out[::-1]


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, PIECE_BYTES + 4096), base, dtype=np.uint64)
        steps[0] = 1
        have = _POWERS[base] = np.cumprod(steps, dtype=np.uint64)
    return have


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(29)
    return x


def _piece_words(raw: bytes, lane: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of a piece that begins and ends between words."""
    a = np.frombuffer(raw, dtype=np.uint8)
    edge = np.diff(np.concatenate([[True], _IS_BLANK[a], [True]]).astype(np.int8))
    s, e = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    values, base, inverse = _LANES[lane]
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(values[a] * _powers(base, len(a))[:len(a)], dtype=np.uint64)])
    return s, _mix((sums[e] - sums[s]) * _powers(inverse, len(a) + 1)[s], (e - s).astype(np.uint64))


def word_hashes(texts: list[bytes], lane: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words of all texts in order, words per text)."""
    raw = b"\n".join(texts)
    starts, hashes, at = [], [], 0
    while at < len(raw):
        cut = _BLANK.search(raw, at + PIECE_BYTES)
        end = cut.start() if cut else len(raw)
        s, h = _piece_words(raw[at:end], lane)
        starts.append(s + at)
        hashes.append(h)
        at = end
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    where = np.concatenate(starts) if starts else np.zeros(0, dtype=np.int64)
    counts = np.diff(np.searchsorted(where, bounds))
    return (np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)), counts


def doubled(cur: np.ndarray, have: int, want: int) -> np.ndarray:
    """Hashes of windows of ``want`` words from those of ``have``, by doubling; same length, the tail is void."""
    while have < want:
        step = min(have, want - have)
        nxt = np.zeros_like(cur)
        nxt[:len(cur) - step] = _mix(cur[:len(cur) - step], cur[step:]) if len(cur) > step else 0
        cur, have = nxt, have + step
    return cur


class Block:
    """Windows of a block of texts: hashes at a length, and where a window of that length may start."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        self.words, self.counts = word_hashes(texts)
        self.ends = np.repeat(np.cumsum(self.counts), self.counts)
        self.places = np.arange(len(self.words))

    def fits(self, n: int) -> np.ndarray:
        return self.places + n <= self.ends

    def keys(self, n: int, at: np.ndarray, buckets: int, last: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """(bucket and 40 bits, 40 more bits at the last level) of the windows of n words at the given places."""
        h = doubled(self.words, 1, n)[at]
        first = ((h >> np.uint64(40)) % np.uint64(buckets)) << np.uint64(40) | (h & _LOW40)
        if not last:
            return first, None
        return first, doubled(word_hashes(self.texts, 1)[0], 1, n)[at] & _LOW40


def distinct(first: np.ndarray, second: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order that sorts the keys, number of each sorted key among the distinct ones, their counts)."""
    order = np.argsort(first) if second is None else np.lexsort((second, first))
    a = first[order]
    new = np.ones(len(a), dtype=bool)
    new[1:] = a[1:] != a[:-1]
    if second is not None:
        b = second[order]
        new[1:] |= b[1:] != b[:-1]
    number = np.cumsum(new) - 1
    return order, number, np.bincount(number, minlength=0) if len(a) else np.zeros(0, dtype=np.int64)


def _five(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :5]


def _unfive(b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(b), 8), dtype=np.uint8)
    out[:, :5] = b
    return out.reshape(-1).view("<u8")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), _WIRE.types)], schema=_WIRE)


def requests(block: Block, n: int, at: np.ndarray, buckets: int, last: bool) -> Iterator[tuple[int, bytes]]:
    """(bucket, distinct keys in order) for every bucket that owns a window at the given places."""
    first, second = block.keys(n, at, buckets, last)
    order, number, counts = distinct(first, second)
    if not len(order):
        return
    heads = order[np.searchsorted(number, np.arange(len(counts)))]
    a = first[heads]
    data = _five(a) if second is None else np.concatenate([_five(a), _five(second[heads])], axis=1)
    bucket = (a >> np.uint64(40)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    for i, j in zip([0, *cuts], [*cuts, len(a)]):
        yield int(bucket[i]), data[i:j].tobytes()


def apply_answers(block: Block, n: int, at: np.ndarray, buckets: int, last: bool, answers: dict[int, bytes]) -> np.ndarray:
    """Places, of those asked, whose window also starts elsewhere."""
    first, second = block.keys(n, at, buckets, last)
    order, number, counts = distinct(first, second)
    if not len(order):
        return at
    heads = order[np.searchsorted(number, np.arange(len(counts)))]
    bucket = (first[heads] >> np.uint64(40)).astype(np.int64)
    again = counts > 1
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    for i, j in zip([0, *cuts], [*cuts, len(heads)]):
        bits = answers.get(int(bucket[i]))
        if bits is not None:
            again[i:j] |= np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=j - i).astype(bool)
    out = np.zeros(len(at), dtype=bool)
    out[order] = again[number]
    return at[out]


def _blocks(file: str, columns: list[str], block_bytes: int) -> Iterator[tuple[list, list[bytes]]]:
    """(keys, texts) of a file of the copy, block by block."""
    import pyarrow.parquet as pq
    store, path = store_of(file)
    keys, texts, size = [], [], 0
    with store.open_input_file(path) as source:
        for batch in pq.ParquetFile(source).iter_batches(batch_size=64, columns=columns):
            for i, body in enumerate(batch.column(0).to_pylist()):
                texts.append(body or b"")
                if len(columns) > 1:
                    keys.append(batch.column(1)[i])
                size += len(texts[-1])
                if size >= block_bytes:
                    yield keys, texts
                    keys, texts, size = [], [], 0
    if texts:
        yield keys, texts


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes | None, str, dict[int, bytes]]]:
    """(part, block, places asked, file, answers) from rows sorted by part, block and bucket."""
    held = None
    for batch in batches:
        for bucket, part, block, data, file in zip(*(c.to_pylist() for c in batch.columns)):
            if bucket < 0:
                if held is not None:
                    yield held
                held = (part, block, data, file, {})
            else:
                held[4][bucket] = data
    if held is not None:
        yield held


def _asked(data: bytes | None, words: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(data or b"", dtype=np.uint8), count=words)) if data else np.zeros(0, dtype=np.int64)


def _step(lengths: list[int], level: int, buckets: int, block_bytes: int):
    """Documents' side of a level: take the answers of the level before, ask for the windows that are left."""
    n, last = lengths[level], level == len(lengths) - 1

    def ask(block: Block, at: np.ndarray, part: int, number: int, file: str) -> Iterator[pa.RecordBatch]:
        mask = np.zeros(len(block.words), dtype=bool)
        mask[at] = True
        rows = [(-1, part, number, np.packbits(mask).tobytes() if len(at) else b"", file)]
        rows += [(b, part, number, data, None) for b, data in requests(block, n, at, buckets, last)]
        yield _rows(rows)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _block, _data, file, _answers in _groups(batches):
            for number, (_keys, texts) in enumerate(_blocks(file, ["body"], block_bytes)):
                block = Block(texts)
                yield from ask(block, np.flatnonzero(block.fits(n)), part, number, file)

    def later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, reader, opened = lengths[level - 1], None, None
        for part, number, data, file, answers in _groups(batches):
            if file != opened:
                reader, opened = _blocks(file, ["body"], block_bytes), file
            _keys, texts = next(reader)
            if not data:  # no candidate in this block
                yield _rows([(-1, part, number, b"", file)])
                continue
            block = Block(texts)
            at = apply_answers(block, before, _asked(data, len(block.words)), buckets, False, answers)
            left = np.zeros(len(block.words) + n, dtype=bool)
            left[at] = True
            at = at[left[at + n - before] & block.fits(n)[at]]
            yield from ask(block, at, part, number, file)

    return later if level else first


def _owners(width: int):
    """Owners' side of a level: one bit for each hash of each block, set when another block sent it too."""
    def answer(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        sizes = [len(r[3]) // width for r in rows]
        data = np.frombuffer(b"".join(r[3] for r in rows), dtype=np.uint8).reshape(-1, width)
        order, number, counts = distinct(_unfive(data[:, :5]), _unfive(data[:, 5:]) if width > 5 else None)
        shared = np.zeros(len(data), dtype=bool)
        shared[order] = counts[number] > 1
        out, at = [], 0
        for (bucket, part, block, _data, _file), size in zip(rows, sizes):
            bits = shared[at:at + size]
            at += size
            if bits.any():
                out.append((bucket, part, block, np.packbits(bits).tobytes(), None))
        if out:
            yield _rows(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            passing = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] < 0:
                    passing.append(row)
                    continue
                if held and held[0][0] != row[0]:
                    yield from answer(held)
                    held = []
                held.append(row)
            if passing:
                yield _rows(passing)
        if held:
            yield from answer(held)

    return run


def _finish(lengths: list[int], level: int, buckets: int, block_bytes: int):
    """What is left of every text, from the answers of the given level."""
    n = lengths[level]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, opened = None, None
        for _part, _number, data, file, answers in _groups(batches):
            if file != opened:
                reader, opened = _blocks(file, ["body", "key"], block_bytes), file
            keys, texts = next(reader)
            gone = counts = None
            if data and level == len(lengths) - 1:
                block = Block(texts)
                at = apply_answers(block, n, _asked(data, len(block.words)), buckets, True, answers)
                edge = np.zeros(len(block.words) + 1, dtype=np.int64)
                edge[at] += 1
                edge[at + n] -= 1
                gone, counts = np.cumsum(edge[:-1]) > 0, block.counts
            out, start = [], 0
            for i, text in enumerate(texts):
                words = text.split()  # bytes split at x20 and x09-x0D, no other white space
                n_removed = 0
                if gone is not None:
                    mask = gone[start:start + counts[i]]
                    start += counts[i]
                    n_removed = int(mask.sum())
                left = compress(words, ~mask) if n_removed else words
                out.append((keys[i].as_py(), len(words), n_removed, b" ".join(left)))
                if len(out) == 256 or i == len(texts) - 1:
                    k, w, r, t = zip(*out)
                    yield pa.record_batch([pa.array(k, keys[i].type), pa.array(w, pa.int64()), pa.array(r, pa.int64()),
                                           pa.array(t, pa.binary())], ["key", "n_words", "n_removed", "kept"])
                    out = []

    return run


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW,
                   first_level: int = FIRST_LEVEL, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: key, n_words, n_removed, kept (what is left, words joined by one space)."""
    spark = docs.sparkSession
    copy = scratch(spark, "substring-copy")
    rows = docs.select(F.col(text).cast("string").cast("binary").alias("body"), F.col(key).alias("key"))
    rows.write.option("compression", "zstd").parquet(copy)
    held = spark.read.schema(rows.schema).parquet(copy)
    size = held.agg(F.sum(F.octet_length("body"))).first()[0] or 0  # one number: sizes the partitions
    buckets = max(MIN_BUCKETS, size // BUCKET_BYTES)
    files = held.select(F.col("_metadata.file_path").alias("file")).distinct()
    state = files.select(F.lit(-1).cast("long").alias("bucket"),
                         F.regexp_extract("file", r"/part-(\d+)-[^/]*$", 1).cast("long").alias("part"),
                         F.lit(-1).cast("long").alias("block"), F.lit(None).cast("binary").alias("data"), "file")
    state = written(state, "substring-files")
    parts = max(1, state.count())

    def by_part(df: DataFrame) -> DataFrame:
        return df.repartition(parts, "part").sortWithinPartitions("part", "block", "bucket")

    lengths, level = level_lengths(window, first_level), 0
    while True:
        asked = by_part(state).mapInArrow(_step(lengths, level, buckets, block_bytes), WIRE)
        # what a task keeps of its own blocks travels with the questions, spread over the owners
        owner = F.when(F.col("bucket") < 0, F.xxhash64("part", "block")).otherwise(F.col("bucket"))
        dealt = asked.withColumn("owner", owner).repartition(buckets, "owner").sortWithinPartitions("bucket").drop("owner")
        width = 10 if level == len(lengths) - 1 else 5
        state = written(dealt.mapInArrow(_owners(width), WIRE), f"substring-level{lengths[level]}")
        # a level without a question, or without a repeated window, ends the search
        if level == len(lengths) - 1 or state.filter("bucket < 0 and octet_length(data) > 0").isEmpty():
            break
        level += 1
    key_type = docs.schema[key].dataType.simpleString()
    done = by_part(state).mapInArrow(_finish(lengths, level, buckets, block_bytes),
                                     f"key {key_type}, n_words long, n_removed long, kept binary")
    return done.select(F.col("key").alias(key), "n_words", "n_removed", F.col("kept").cast("string").alias("kept"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left of every document once passages of 35 words found elsewhere are gone: doc_id, n_words,
    n_removed, kept_sha256."""
    left = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP11_SQL = rf"""
with d as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws
           from documents),
g as (select doc_id, i, list_aggregate(list_slice(ws, i, i + {WINDOW - 1}), 'string_agg', ' ') as win
      from (select doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) as i from d where len(ws) >= {WINDOW})),
r as (select doc_id, i from (select doc_id, i, count(*) over (partition by win) as c from g) where c > 1),
x as (select distinct doc_id, i + k as i from r, range(0, {WINDOW}) o(k)),
w as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as i from d),
k as (select w.doc_id, count(*) as n_words, count(x.i) as n_removed,
             string_agg(word, ' ' order by w.i) filter (where x.i is null) as kept
      from w left join x on w.doc_id = x.doc_id and w.i = x.i group by w.doc_id)
select d.doc_id, cast(coalesce(n_words, 0) as bigint) as n_words, cast(coalesce(n_removed, 0) as bigint) as n_removed,
       sha256(coalesce(kept, '')) as kept_sha256
from d left join k on d.doc_id = k.doc_id
"""
