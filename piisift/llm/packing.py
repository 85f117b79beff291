"""Best-fit packing by exact-complement hashing.

A document's ids (with an end id) become pieces of at most ``size`` ids: only longer documents are cut,
and then the first piece is the short one.  Packing needs the lengths alone, so a histogram of at most
``size`` lengths is counted by Spark and planned on the driver: longest first, each gap is looked up in
an index of single lengths, of pair sums and of triple sums, and a combination that fills the gap exactly
is used as often as its counts allow; where none exists, the longest length that fits goes in and the
smaller gap is looked up again (best fit).  Of a few plans that differ in the widest gap that pairs and
triples may fill, the one of fewest sequences is taken.  The plan is a list of patterns with multiplicities; each step
uses up the count of at least one length, so the plan is bounded by ``size``, whatever the number of rows.

Pieces take their places by rank within their length.  Ranks come from salted counts: no length, however
frequent, meets in one task.

Defined cases: null text is empty and packs as the end id alone; ties and repeated rows are all packed;
rows with equal keys are told apart by their place in the table; an empty table gives no row; other
columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe_ids import TABLE_SIZE, ids_for
from .common import slices, table, text_of, written

SIZE = 1024
#: Ranks are counted in groups of a length and a salt: at least so many salts, and one more for so many pieces.
SALTS, PIECES_PER_SALT = 64, 200_000


def pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 2,
           size: int = SIZE, with_ids: bool = False, table_size: int = TABLE_SIZE) -> DataFrame:
    """key, piece, start, length, ids_crc32 (and ids) of every piece of every document; one narrow pass.

    ``table_size`` bounds what a worker keeps to encode faster (``bpe_ids``); the ids do not depend on it.
    """
    end = int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            row, piece, start, length, crc, body = [], [], [], [], [], []
            for i, ids in enumerate(ids_for(tokenizer, table_size).encode(b.column(1).to_pylist())):
                ids += end
                n = len(ids) // 4
                bounds = [0, *range(n % size or size, n + 1, size)]
                for k, (a, z) in enumerate(zip(bounds, bounds[1:])):
                    part = ids[4 * a:4 * z]
                    row.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(z - a)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        body.append(part)
            cols = [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["key", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols.append(pa.array(body, pa.binary()))
                names.append("ids")
            yield pa.record_batch(cols, names)

    key_type = docs.schema[key].dataType.simpleString()
    schema = f"key {key_type}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return (docs.select(F.col(key).alias("key"), text_of(text).alias("t")).mapInArrow(cut, schema)
            .withColumnRenamed("key", key))


class SumIndex:
    """Pairs and triples of available lengths by their sum.

    A sum's combinations are listed when it is first looked up; lengths are only ever used up, so later look-ups
    drop those that hold a length that has run out.
    """

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self.found: dict[tuple[int, int], np.ndarray] = {}

    def _listed(self, total: int, parts: int) -> np.ndarray:
        free = np.flatnonzero(self.counts[:total])
        if parts == 2:
            rest = total - free
            ok = (rest <= free) & (self.counts[rest] > 0)
            return np.stack([free[ok], rest[ok]], axis=1).astype(np.int32)
        x, y = free[:, None], free[None, :]
        rest = total - x - y
        i, j = np.nonzero((y <= x) & (rest <= y) & (rest > 0) & (self.counts[np.maximum(rest, 0)] > 0))
        return np.stack([free[i], free[j], rest[i, j]], axis=1).astype(np.int32)

    def take(self, total: int, parts: int, c: np.ndarray) -> list[int] | None:
        """The combination of ``parts`` lengths, available under ``c``, with the longest length; ties by the next."""
        rows = self.found.get((total, parts))
        rows = self._listed(total, parts) if rows is None else rows[(self.counts[rows] > 0).all(axis=1)]
        self.found[total, parts] = rows
        need = (rows[:, :, None] == rows[:, None, :]).sum(axis=2)  # a length may stand in it more than once
        rows = rows[(c[rows] >= need).all(axis=1)]
        return rows[np.lexsort(rows.T[::-1])[-1]].tolist() if len(rows) else None


def exact_fill(gap: int, c: np.ndarray, index: SumIndex) -> list[int] | None:
    """Available lengths that fill the gap exactly: a single, else a pair, else a triple."""
    return [gap] if c[gap] > 0 else index.take(gap, 2, c) or index.take(gap, 3, c)


#: Widest gaps, as parts of a sequence, that pairs and triples may fill; in a wider one without a single the best
#: fitting length goes first, which spares short lengths.  Which of them leaves the least room depends on the
#: lengths; planning costs little, so all are planned and the fewest sequences taken.
WIDEST = (1, 4, 8)


def plan(histogram: dict[int, int], size: int = SIZE) -> list[tuple[list[int], int]]:
    """[(lengths of a sequence, how many such sequences)] for all pieces of the histogram, fewest of ``WIDEST``."""
    return min((_plan(histogram, size, size // part) for part in WIDEST), key=lambda p: sum(times for _, times in p))


def _plan(histogram: dict[int, int], size: int, widest: int) -> list[tuple[list[int], int]]:
    counts = np.zeros(size + 1, dtype=np.int64)
    for length, n in histogram.items():
        counts[length] += n
    out, index = [], SumIndex(counts)
    for first in range(size, 0, -1):
        while counts[first] > 0:
            pattern, c = [first], counts.copy()
            c[first] -= 1
            gap = size - first
            while gap:
                combo = exact_fill(gap, c, index) if gap <= widest or c[gap] > 0 else None
                if combo is None:
                    fit = np.flatnonzero(c[:gap + 1])
                    if not len(fit):
                        break
                    combo = [int(fit[-1])]
                for x in combo:
                    c[x] -= 1
                pattern += combo
                gap -= sum(combo)
            used = np.bincount(pattern, minlength=size + 1)
            times = int((counts[used > 0] // used[used > 0]).min())
            counts -= used * times
            out.append((pattern, times))
    return out


def places(patterns: list[tuple[list[int], int]], size: int = SIZE) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """length -> (first rank, first sequence, offset) of each interval of ranks, in rising order of rank."""
    used: dict[int, int] = {}
    rows: dict[int, list[tuple[int, int, int]]] = {}
    sequence = 0
    for pattern, times in patterns:
        offset = 0
        for length in pattern:
            rank = used.get(length, 0)
            rows.setdefault(length, []).append((rank, sequence, offset))
            used[length] = rank + times
            offset += length
        sequence += times
    return {k: tuple(np.array(c, dtype=np.int64) for c in zip(*v)) for k, v in rows.items()}


def pack(parts: DataFrame, size: int = SIZE) -> DataFrame:
    """``parts`` (a written table with ``length``) plus sequence_id and offset."""
    salts = max(SALTS, parts.count() // PIECES_PER_SALT)
    salted = parts.withColumn("salt", F.pmod(F.xxhash64(*[c for c in parts.columns if c != "ids"]), F.lit(salts)))
    cells = salted.groupBy("length", "salt").count()
    histogram = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    where = places(plan(histogram, size), size)
    # a row for each length and salt: the ranks that lie before its first
    before = W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    bases = cells.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    order = [c for c in parts.columns if c not in ("length", "ids")]
    ranked = (salted.withColumn("local", F.row_number().over(W.partitionBy("length", "salt").orderBy(*order)) - 1)
              .join(bases, ["length", "salt"])
              .withColumn("rank", F.col("base") + F.col("local")).drop("salt", "base", "local"))
    names = ranked.columns
    length_at, rank_at = names.index("length"), names.index("rank")
    keep = [c for c in names if c != "rank"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column(length_at).to_numpy(), b.column(rank_at).to_numpy()
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length).tolist():
                at = np.flatnonzero(length == x)
                first, sequence, offset = where[x]
                i = np.searchsorted(first, rank[at], side="right") - 1
                seq[at], off[at] = sequence[i] + rank[at] - first[i], offset[i]
            yield pa.record_batch([*(b.column(names.index(c)) for c in keep), pa.array(seq), pa.array(off)],
                                  [*keep, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields if f.name != "rank")
    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long").select(
        *parts.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 2,
                   size: int = SIZE, with_ids: bool = False, table_size: int = TABLE_SIZE) -> DataFrame:
    """All pieces of all documents with their places: key, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(written(pieces(docs, tokenizer, key, text, end_id, size, with_ids, table_size), "pieces"), size)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of at most 1,024 ids."""
    import public_tokenizers
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
