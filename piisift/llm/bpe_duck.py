"""Byte-level BPE encoding and decoding by recursive DuckDB queries, one database per task.

Texts are cut into words by the tokenizer's pattern.  Words not seen before become rows of a
token-position table, one row per byte; a recursive query joins neighbouring tokens to the merge table
(left, right, rank) and contracts each word's leftmost pair of minimum rank, until no word has a pair.
Ids are gathered per document, and decoded from the ids, by ordered aggregation in the same database.

Every word is encoded once per worker; the table of known words is bounded and emptied when full.  A
query recurses a bounded number of steps and is asked again for the words that still have pairs, which
bounds the rows that a very long word leaves behind.

Long words (text without blanks) are first cut wherever no token of the vocabulary lies across the cut: no merge
can cross it, so the parts' ids are the word's.  Parts that are still long contract every occurrence of their minimum
pair in one step, the leftmost of those that overlap.  That is what one occurrence at a time gives, unless a
merged token makes a pair of lower rank with a neighbour; the step then ends at the first such occurrence.

Defined cases: null text is empty; an empty text has no ids and decodes to no bytes; rows with equal keys
are kept apart by their place; an empty table gives no row; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, text_of

#: Documents gathered at once, words known at most, merge steps of one query, bytes of new words at once.
ROWS, KNOWN_WORDS, STEPS, NEW_BYTES = 512, 1_000_000, 24, 2_000_000
MEMORY = "400MB"
#: While a long part is merged; a part of two million equal letters fits.
LONG_MEMORY = "800MB"
#: Bytes from which a word is cut, and from which a part contracts all occurrences of a pair at once, in few steps.
LONG_WORD, LONG_PART, LONG_STEPS = 64, 256, 2

#: Token rows are keyed by word and position in one number, ``k``: the word in the high half.
MERGE_SQL = """
with recursive st(step, k, tok) as (
    select 0, k, tok from pending
    union all
    (with pairs as (
        select s.*, cast(m.rank as bigint) * 4294967296 + (s.k & 4294967295) as pair
        from (select step, k, tok, lead(tok) over w as right_tok, lead(k) over w as right_k, lag(k) over w as left_k
              from st where step < $steps window w as (order by k)) s
        left join merges m on m.l = s.tok and m.r = s.right_tok and (s.right_k >> 32) = (s.k >> 32)),
     best as (select k >> 32 as wid, min(pair) as pair from pairs where pair is not null group by 1)
     select step + 1, k,
            case when (best.pair & 4294967295) = (k & 4294967295) then cast(best.pair >> 32 as integer) else tok end
     from pairs join best on best.wid = k >> 32
     where left_k is null or left_k <> ((best.wid << 32) | (best.pair & 4294967295)))
)
select k >> 32 as wid, k & 4294967295 as pos, k, tok, step
from st join (select k >> 32 as w, max(step) as last_step from st group by 1) f on f.w = k >> 32 and f.last_step = step
"""

#: The same for long parts: all occurrences of a word's minimum pair, every second of those that overlap.
MERGE_ALL_SQL = """
with recursive st(step, k, tok) as (
    select 0, k, tok from pending
    union all
    (with pairs as (
        select s.*, m.rank
        from (select step, k, tok, lead(tok) over w as right_tok, lead(k) over w as right_k, row_number() over w as i,
                     lag(tok) over w as before, lead(tok, 2) over w as after
              from st where step < $steps window w as (order by k)) s
        left join merges m on m.l = s.tok and m.r = s.right_tok and (s.right_k >> 32) = (s.k >> 32)),
     best as (select k >> 32 as wid, min(rank) as rank from pairs where rank is not null group by 1),
     hit as (select i, wid, best.rank, before, after, i - row_number() over (order by i) as island
             from pairs join best on best.wid = k >> 32 and best.rank = pairs.rank),
     odd as (select * from (select *, row_number() over (partition by island order by i) as nth from hit) where nth % 2 = 1),
     stop as (select wid, min(i) as i from odd join risky on token = odd.rank
              where (exists (from merges m where m.l = odd.rank and m.r in (odd.after, odd.rank) and m.rank < odd.rank)
                     or exists (from merges m where m.l = odd.before and m.r = odd.rank and m.rank < odd.rank)) group by wid),
     taken as (select odd.i from odd left join stop using (wid) where stop.i is null or odd.i <= stop.i)
     select step + 1, k, case when t.i is not null then pairs.rank else tok end
     from pairs join best on best.wid = k >> 32 left join taken t on t.i = pairs.i left join taken u on u.i = pairs.i - 1
     where u.i is null)
)
select k >> 32 as wid, k & 4294967295 as pos, k, tok, step
from st join (select k >> 32 as w, max(step) as last_step from st group by 1) f on f.w = k >> 32 and f.last_step = step
"""

#: Ids and decoded bytes of each new word, as hex, in token order.
WORD_SQL = """
insert into known
select wid, string_agg(v.le, '' order by pos), string_agg(v.bytes_hex, '' order by pos)
from {rows} join vocabulary v on v.id = tok where {ended} group by wid
"""

#: Ids and decoded bytes of each document, in word order.
DOCUMENT_SQL = """
select doc, string_agg(ids_hex, '' order by seq) as ids_hex, string_agg(text_hex, '' order by seq) as text_hex
from doc_words join known using (wid) group by doc
"""


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as fh:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in fh if line.strip())}


class DuckBpe:
    """Encoder and decoder over a ranks file and a word pattern."""

    def __init__(self, path: str, pattern: str, known_words: int = KNOWN_WORDS):
        import duckdb
        import regex
        self.pattern = regex.compile(pattern)
        self.ranks = load_ranks(path)
        self.byte_id = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.known_words = known_words
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": MEMORY, "temp_directory": "",
                                                     "preserve_insertion_order": False})
        left, right, rank, risky = [], [], [], set()
        for token, r in self.ranks.items():
            for k in range(1, len(token)):
                a, b = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                risky.update(x for x in (a, b) if x is not None and x > r)
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(r)
        self._table("merges", l=pa.array(left, pa.int32()), r=pa.array(right, pa.int32()), rank=pa.array(rank, pa.int32()))
        self._table("risky", token=pa.array(sorted(risky), pa.int32()))
        self.finder = None  # of tokens in long words, made when the first one comes
        self._table("vocabulary", id=pa.array(self.ranks.values(), pa.int32()),
                    le=pa.array([r.to_bytes(4, "little").hex() for r in self.ranks.values()]),
                    bytes_hex=pa.array([t.hex() for t in self.ranks]))
        self._forget()

    def _do(self, sql: str, values: list | None = None) -> list[tuple]:
        return self.db.execute(sql, values).fetchall()  # read to the end, so the connection is free again

    def _table(self, name: str, **cols) -> None:
        arrow = pa.table(cols)
        self.db.register("arrow_in", arrow)
        self._do(f"create or replace table {name} as select * from arrow_in")
        self.db.unregister("arrow_in")

    def _forget(self) -> None:
        self.word_id: dict[str | bytes, int] = {}  # words, and parts of long words as bytes
        self._do("create or replace table known(wid integer, ids_hex varchar, text_hex varchar)")

    def _parts(self, word: str) -> list[str | bytes]:
        """The word, or its parts where it is long: cut at the places that no token of the vocabulary spans."""
        raw = word.encode()
        if len(raw) <= LONG_WORD or raw in self.ranks:
            return [word]
        if self.finder is None:
            import ahocorasick
            self.finder = ahocorasick.Automaton()
            for token in self.ranks:
                if len(token) > 1:
                    self.finder.add_word(token.decode("latin-1"), len(token))
            self.finder.make_automaton()
        spanned = np.zeros(len(raw) + 2, dtype=np.int64)
        longest: dict[int, int] = {}
        for end, n in self.finder.iter(raw.decode("latin-1")):
            if n > longest.get(end, 0):
                longest[end] = n
        ends, sizes = np.fromiter(longest, dtype=np.int64, count=len(longest)), np.fromiter(longest.values(), dtype=np.int64, count=len(longest))
        np.add.at(spanned, ends - sizes + 2, 1)
        np.add.at(spanned, ends + 1, -1)
        cuts = [0, *(np.flatnonzero(np.cumsum(spanned)[1:len(raw)] == 0) + 1).tolist(), len(raw)]
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]

    def _learn(self, words: list[str | bytes]) -> None:
        """Encode new words into ``known``."""
        first = len(self.word_id)
        whole_w, whole_t, split_w, split_b = [], [], [], []
        for wid, word in enumerate(words, first):
            self.word_id[word] = wid
            raw = word if isinstance(word, bytes) else word.encode()
            r = self.ranks.get(raw)
            if r is None or raw is word and len(raw) > 1:  # a part of a word is merged like any other bytes
                split_w.append(wid)
                split_b.append(raw)
            else:  # the library takes a word of the vocabulary as it is
                whole_w.append(wid)
                whole_t.append(r)
        if whole_w:
            self.db.register("arrow_in", pa.table({"wid": pa.array(whole_w, pa.int32()), "tok": pa.array(whole_t, pa.int32())}))
            self._do(WORD_SQL.format(rows="(select wid, 0 as pos, tok from arrow_in)", ended="true"))
            self.db.unregister("arrow_in")
        for long in (False, True):
            mine = [(w, b) for w, b in zip(split_w, split_b) if (len(b) > LONG_PART) == long]
            at = 0
            while at < len(mine):
                to, size = at, 0
                while to < len(mine) and (to == at or size + len(mine[to][1]) <= NEW_BYTES):
                    size += len(mine[to][1])
                    to += 1
                self._merge([w for w, _ in mine[at:to]], [b for _, b in mine[at:to]], *((MERGE_ALL_SQL, LONG_STEPS) if long else (MERGE_SQL, STEPS)))
                at = to

    def _merge(self, wids: list[int], raws: list[bytes], sql: str, steps: int) -> None:
        self._do(f"set memory_limit = '{LONG_MEMORY if sql is MERGE_ALL_SQL else MEMORY}'")
        n = np.array([len(r) for r in raws], dtype=np.int64)
        data = np.frombuffer(b"".join(raws), dtype=np.uint8)
        pos = np.arange(len(data), dtype=np.int64) - np.repeat(np.cumsum(n) - n, n)
        self._table("pending", k=pa.array((np.repeat(np.array(wids, dtype=np.int64), n) << 32) | pos),
                    tok=pa.array(self.byte_id[data]))
        while True:
            self._do(f"create or replace table merged as {sql.replace('$steps', str(steps))}")
            self._do(WORD_SQL.format(rows="merged", ended=f"step < {steps}"))
            self._do("create or replace table pending as select k, tok from merged where step = ?", [steps])
            if not self._do("select count(*) from pending")[0][0]:
                return

    def run(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """(ids as little-endian unsigned 32-bit integers, bytes decoded from those ids) of each text."""
        if len(self.word_id) > self.known_words:
            self._forget()
        split = [self.pattern.findall(t) for t in texts]
        most = LONG_WORD // 4  # a character has four bytes at most
        split = [[x for w in words for x in (self._parts(w) if len(w) > most else (w,))] if max(map(len, words), default=0) > most else words
                 for words in split]
        new = dict.fromkeys(w for words in split for w in words if w not in self.word_id)
        if new:
            self._learn(list(new))
        n = [len(words) for words in split]
        get = self.word_id.__getitem__
        wid = np.fromiter((get(w) for words in split for w in words), dtype=np.int32, count=sum(n))
        doc = np.repeat(np.arange(len(texts), dtype=np.int32), n)
        at = np.arange(len(wid), dtype=np.int32)
        self.db.register("doc_words", pa.table({"doc": pa.array(doc), "seq": pa.array(at), "wid": pa.array(wid)}))
        out = [(b"", b"")] * len(texts)
        for d, ids, raw in self._do(DOCUMENT_SQL):
            out[d] = (bytes.fromhex(ids), bytes.fromhex(raw))
        self.db.unregister("doc_words")
        return out


_KEPT: dict[tuple[str, str], DuckBpe] = {}


def _encoder(path: str, pattern: str) -> DuckBpe:
    if (path, pattern) not in _KEPT:
        _KEPT[path, pattern] = DuckBpe(path, pattern)
    return _KEPT[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids (binary, little-endian unsigned 32-bit), decoded (binary) of every document; one narrow pass."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, ROWS):
            pairs = _encoder(path, pattern).run(b.column(1).to_pylist())
            yield pa.record_batch([b.column(0), pa.array([x for x, _ in pairs], pa.binary()),
                                   pa.array([y for _, y in pairs], pa.binary())], ["key", "ids", "decoded"])

    key_type = docs.schema[key].dataType.simpleString()
    return (docs.select(F.col(key).alias("key"), text_of(text).alias("t"))
            .mapInArrow(run, f"key {key_type}, ids binary, decoded binary").withColumnRenamed("key", key))


def op6_bpe_duckdb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    import public_tokenizers as p
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode_documents(docs, p.path("byte_bpe_50k.tiktoken"), p.PATTERN)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                      F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
