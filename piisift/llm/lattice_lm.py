"""Language-model scores by subword lattice likelihood.

The model is a unigram model over the pieces of an existing vocabulary (a sentencepiece file; its pieces
are never changed).  The file's scores order the pieces and start the model; the pieces' probabilities are
then fitted to the training texts by expectation-maximisation, in which every segmentation of every
training word counts with its posterior weight.  A text's score is its marginal probability: all ways to
spell its words in pieces, summed by a forward recursion in log space, and one end.

Words do not overlap in the lattice (a piece never spans white space), so a text's probability is the
product over its words, and each distinct word is solved once, on Spark, whatever its count, thousands of
words at a time (:class:`Lattice`).  Frequent
words (a bounded table) are scored where the text is read; all other words are shuffled once per document
and word and joined to the word table, which therefore may grow with the corpus.

The base score is an add-0.1 word unigram model over the same training words.

Defined cases: null text is empty; an empty text has its end alone; characters outside the vocabulary are
spelled in bytes; with no training text every piece has its start probability and every count is 0;
rows with equal keys are scored apart; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, text_of, written

#: Words scored where texts are read: the table sent to every task has at most so many rows.
FREQUENT_WORDS = 100_000
#: Passes of expectation-maximisation over the distinct training words.
PASSES = 2
#: Distinct words gathered in a task before they are handed on.
GATHERED = 200_000
#: Words whose lattices are solved together.
WORDS_AT_ONCE = 8192
SMOOTHING = 0.1
SPACE = "▁"  # how sentencepiece writes the blank before a word
LN10 = math.log(10.0)


class Pieces:
    """Vocabulary pieces that can stand in a word, and the start model from the file's scores."""

    def __init__(self, path: str):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.index: dict[str, int] = {}
        self.byte: dict[int, int] = {}
        scores = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = len(scores)
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or SPACE in piece[1:]:
                continue  # pieces that span blanks never occur inside a word
            else:
                self.index[piece] = len(scores)
            scores.append(model.get_score(i))
        self.n = len(scores)  # the end is piece n
        self.longest = max(map(len, self.index), default=1)
        self.heads = {p[:k] for p in self.index for k in range(1, len(p))}
        nodes = {p: i for i, p in enumerate(sorted({"", *self.heads, *self.index}))}
        edges = sorted((nodes[p[:-1]] << 21 | ord(p[-1]), i, self.index.get(p, -1)) for p, i in nodes.items() if p)
        #: The pieces as a tree: (node, character) pairs in order, the node each leads to, and the piece it is.
        self.keys, self.to, self.piece = (np.array(c, dtype=np.int64) for c in zip(*edges))
        self.root = nodes[""]
        order = np.argsort(np.argsort(-np.array(scores), kind="stable"), kind="stable")
        start = np.append(1.0 / (order + 10.0), 1.0 / (self.n + 10.0))  # Zipf's law over the file's order
        self.start = np.log(start / start.sum())

    def arcs(self, word: str) -> tuple[int, list[tuple[int, int, int | tuple[int, ...]]]]:
        """(places, arcs by start): each arc is (start, end, piece); a character without a piece is its bytes."""
        text = SPACE + word
        n, out = len(text), []
        get, heads, longest = self.index.get, self.heads, self.longest
        for a in range(n):
            known = False
            for b in range(a + 1, min(n, a + longest) + 1):
                part = text[a:b]
                i = get(part)
                if i is not None:
                    out.append((a, b, i))
                    known = known or b == a + 1
                if part not in heads:
                    break
            if not known:
                out.append((a, a + 1, tuple(self.byte[x] for x in text[a].encode("utf-8", "surrogatepass"))))
        return n, out


def _log_sum(values: list[float]) -> float:
    if len(values) == 1:
        return values[0]
    top = max(values)
    return top + math.log(sum([math.exp(v - top) for v in values]))


def forward(n: int, arcs: list, logp: list[float]) -> list[float]:
    """Log probability of all spellings of each prefix."""
    into: list[list[float]] = [[] for _ in range(n + 1)]
    alpha, at = [0.0] * (n + 1), 0
    for a, b, i in arcs:
        if a != at:  # every arc into ``a`` starts before it
            alpha[a] = _log_sum(into[a])
            at = a
        into[b].append(alpha[a] + (logp[i] if i.__class__ is int else sum([logp[k] for k in i])))
    alpha[n] = _log_sum(into[n])
    return alpha


def word_score(pieces: Pieces, logp: list[float], word: str) -> float:
    """Natural log of the word's marginal probability."""
    return forward(*pieces.arcs(word), logp)[-1]


#: Below this probability of a word, expectations are taken in log space.
TINY = 1e-200


def add_expected(pieces: Pieces, logp: list[float], prob: list[float], word: str, count: float, out: list[float]) -> None:
    """Add the expected uses of each piece in ``count`` occurrences of the word; ``prob`` is exp of ``logp``."""
    n, arcs = pieces.arcs(word)
    weights, alpha = [], [0.0] * (n + 1)
    alpha[0] = 1.0
    for a, b, i in arcs:
        q = prob[i] if i.__class__ is int else math.prod([prob[k] for k in i])
        weights.append(q)
        alpha[b] += alpha[a] * q
    if alpha[n] < TINY:
        return _add_expected_log(n, arcs, logp, count, out)
    beta = [0.0] * (n + 1)
    beta[n] = count / alpha[n]
    for (a, b, i), q in zip(reversed(arcs), reversed(weights)):
        x = beta[b] * q
        beta[a] += x
        x *= alpha[a]
        if i.__class__ is int:
            out[i] += x
        else:
            for k in i:
                out[k] += x


def _add_expected_log(n: int, arcs: list, logp: list[float], count: float, out: list[float]) -> None:
    """The same for long words, whose probability a float cannot hold."""
    alpha = forward(n, arcs, logp)
    tails: list[list[float]] = [[] for _ in range(n + 1)]
    beta: list[float | None] = [None] * (n + 1)
    beta[n] = 0.0
    for a, b, i in reversed(arcs):
        if beta[b] is None:  # every arc out of ``b`` has been seen
            beta[b] = _log_sum(tails[b])
        p = logp[i] if i.__class__ is int else sum([logp[k] for k in i])
        weight = count * math.exp(alpha[a] + p + beta[b] - alpha[n])
        for k in (i,) if i.__class__ is int else i:
            out[k] += weight
        tails[a].append(p + beta[b])


#: Longest word that is solved together with others.
TOGETHER = 64


class Lattice:
    """The lattices of many words at once: arcs in groups of equal start (from the word's) and length.

    Words with characters that have no piece, and very long ones, are left to :func:`forward` (``rest``).
    """

    def __init__(self, pieces: Pieces, words: list[str]):
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
        short = np.flatnonzero(size <= TOGETHER)
        texts = [SPACE + words[i] for i in short.tolist()]
        size = size[short]
        first = np.cumsum(size) - size
        chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        word = np.repeat(np.arange(len(short)), size)
        end = np.repeat(first + size, size)
        at, node, starts, lengths, ids = np.arange(len(chars)), np.full(len(chars), pieces.root), [], [], []
        alone = np.zeros(len(short), dtype=bool)  # words with a character that has no piece
        for n in range(1, pieces.longest + 1):
            fits = at + n <= end[at]
            at, node = at[fits], node[fits]
            if not len(at):
                break
            key = node << 21 | chars[at + n - 1]
            j = np.minimum(np.searchsorted(pieces.keys, key), len(pieces.keys) - 1)
            known = pieces.keys[j] == key
            if n == 1:
                single = known & (pieces.piece[j] >= 0)
                alone[word[at[~single]]] = True
            at, j = at[known], j[known]
            node = pieces.to[j]
            hit = pieces.piece[j] >= 0
            starts.append(at[hit])
            lengths.append(np.full(int(hit.sum()), n))
            ids.append(pieces.piece[j[hit]])
        start, length, self.ids = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (starts, lengths, ids))
        group = (start - first[word[start]]) * 64 + length
        by = np.argsort(group.astype(np.int16), kind="stable")
        start, length, self.ids, group = start[by], length[by], self.ids[by], group[by]
        self.source = start + word[start]  # a word of n characters has n + 1 places
        self.target = self.source + length
        cuts = np.flatnonzero(np.diff(group)) + 1
        self.groups = [slice(a, b) for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(group)]) if b > a]
        self.begin = first + np.arange(len(short))
        self.last = self.begin + size
        self.places = int(size.sum()) + len(short)
        self.taken = short[~alone]  # words solved here, in order
        self.solved = ~alone
        self.rest = np.setdiff1d(np.arange(len(words)), self.taken)

    def _alpha(self, weight: np.ndarray) -> np.ndarray:
        """Log probability of all spellings up to each place (words of one group never share a place)."""
        alpha = np.full(self.places, -np.inf)
        alpha[self.begin] = 0.0
        for g in self.groups:
            to = self.target[g]
            alpha[to] = np.logaddexp(alpha[to], alpha[self.source[g]] + weight[g])
        return alpha

    def scores(self, logp: np.ndarray) -> np.ndarray:
        """Natural log of the probability of each word taken."""
        return self._alpha(logp[self.ids])[self.last][self.solved]

    def add_expected(self, logp: np.ndarray, counts: np.ndarray, out: np.ndarray) -> None:
        """Add the expected uses of each piece in ``counts`` occurrences of the words taken."""
        weight = logp[self.ids]
        alpha = self._alpha(weight)
        beta = np.full(self.places, -np.inf)
        times = np.zeros(len(self.last))
        times[self.solved] = counts
        with np.errstate(divide="ignore"):
            beta[self.last] = np.log(times) - np.where(np.isfinite(alpha[self.last]), alpha[self.last], 0.0)
        for g in reversed(self.groups):
            at = self.source[g]
            beta[at] = np.logaddexp(beta[at], beta[self.target[g]] + weight[g])
        uses = np.exp(alpha[self.source] + weight + beta[self.target])
        out += np.bincount(self.ids, np.nan_to_num(uses, nan=0.0), len(out))


_PIECES: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


def words_of(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case (bytes know no other letters or white space)."""
    return text.encode("utf-8", "surrogatepass").lower().split()




def count_words(docs: DataFrame) -> DataFrame:
    """word, c (in training texts), n (in all texts); ``docs`` has columns held_out and t."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        train, rest = Counter(), Counter()

        def flush():
            words = [*train, *(w for w in rest if w not in train)]
            yield pa.record_batch([pa.array([w.decode("utf-8", "surrogatepass") for w in words], pa.string()),
                                   pa.array([train.get(w, 0) for w in words], pa.int64()),
                                   pa.array([train.get(w, 0) + rest.get(w, 0) for w in words], pa.int64())],
                                  ["word", "c", "n"])
            train.clear()
            rest.clear()

        for b in slices(batches):
            for held, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                (rest if held else train).update(words_of(t))
            if len(train) + len(rest) > GATHERED:
                yield from flush()
        yield from flush()

    part = docs.select("held_out", "t").mapInArrow(run, "word string, c long, n long")
    return part.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def fit(words: DataFrame, ends: int, path: str, passes: int = PASSES) -> np.ndarray:
    """Log probabilities of the pieces and the end, from all distinct training words and their counts."""
    pieces = pieces_of(path)
    logp = pieces.start
    train = words.filter("c > 0").select("word", "c")

    for _ in range(passes):
        now = logp.tolist()

        def expect(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            own, prob, log = pieces_of(path), [math.exp(x) for x in now], np.array(now)
            total = np.zeros(own.n + 1)
            for b in slices(batches, WORDS_AT_ONCE):
                words, counts = b.column(0).to_pylist(), b.column(1).to_numpy()
                lattice = Lattice(own, words)
                lattice.add_expected(log, counts[lattice.taken], total)
                out = [0.0] * (own.n + 1) if len(lattice.rest) else None
                for i in lattice.rest.tolist():
                    add_expected(own, now, prob, words[i], int(counts[i]), out)
                if out is not None:
                    total += out
            used = np.flatnonzero(total)
            yield pa.record_batch([pa.array(used, pa.int32()), pa.array(total[used], pa.float64())], ["piece", "uses"])

        uses = np.full(pieces.n + 1, SMOOTHING)  # every piece stays possible
        uses[pieces.n] += ends
        # at most one row per piece of the vocabulary
        for r in train.mapInArrow(expect, "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("u")).collect():
            uses[r["piece"]] += r["u"]
        logp = np.log(uses / uses.sum())
    return logp


def score_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    key_type = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), text_of(text).alias("t"),
                       (F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 10 == 0).alias("held_out"))
    words = written(count_words(rows), "words")
    ends = rows.filter(~F.col("held_out")).count()
    sums = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("c"), F.count_if(F.col("c") > 0).alias("v")).first()
    total, distinct = sums["c"] + ends, sums["v"] + (ends > 0)
    below = math.log10(total + 0.1 * (distinct + 1))
    logp = fit(words, ends, path)
    now = logp.tolist()

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, log = pieces_of(path), np.array(now)
        for b in slices(batches, WORDS_AT_ONCE):
            word, c = b.column(0).to_pylist(), b.column(1).to_pylist()
            lattice, scores = Lattice(own, word), np.zeros(len(word))
            scores[lattice.taken] = lattice.scores(log)
            for i in lattice.rest.tolist():
                scores[i] = word_score(own, now, word[i])
            yield pa.record_batch([b.column(0), b.column(1), b.column(2),
                                   pa.array([math.log10(x + 0.1) - below for x in c], pa.float64()),
                                   pa.array(scores / LN10, pa.float64())],
                                  ["word", "c", "n", "base", "lp"])

    solved = written(words.select("word", "c", "n").mapInArrow(solve, "word string, c long, n long, base double, lp double"),
                     "word-scores")
    top = solved.orderBy(F.desc("n"), "word").limit(FREQUENT_WORDS).collect()
    frequent = {r["word"].encode("utf-8", "surrogatepass"): (r["c"] > 0, r["base"], r["lp"]) for r in top}
    table_of = docs.sparkSession.sparkContext.broadcast(frequent)  # at most FREQUENT_WORDS rows
    end_known, end_base, end_lp = ends > 0, math.log10(ends + 0.1) - below, now[-1] / LN10

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row of sums per document, and a row per rare word of it: n_tokens is null in the latter."""
        known, attempt, serial = table_of.value, uuid.uuid4().hex[:16], 0
        for b in slices(batches):
            row, keys, held, word, times, n_known, tokens, base, lp = ([] for _ in range(9))

            def put(*values):
                for column, v in zip((row, keys, held, word, times, n_known, tokens, base, lp), values):
                    column.append(v)

            for k, t, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                serial += 1
                name = f"{attempt}-{serial}"
                counts = Counter(words_of(t))
                found, s_base, s_lp = int(end_known), end_base, end_lp
                for w, c in counts.items():
                    hit = known.get(w)
                    if hit is None:
                        put(name, None, None, w.decode("utf-8", "surrogatepass"), c, 0, None, 0.0, 0.0)
                    else:
                        found += c * hit[0]
                        s_base += c * hit[1]
                        s_lp += c * hit[2]
                put(name, k, h, None, 0, found, sum(counts.values()) + 1, s_base, s_lp)
            yield pa.record_batch([pa.array(row), pa.array(keys, b.schema.field(0).type), pa.array(held, pa.bool_()),
                                   pa.array(word, pa.string()), pa.array(times, pa.int64()), pa.array(n_known, pa.int64()),
                                   pa.array(tokens, pa.int64()), pa.array(base, pa.float64()), pa.array(lp, pa.float64())],
                                  ["row", "key", "held_out", "word", "times", "n_known", "n_tokens", "base", "lp"])

    parts = written(rows.select("key", "t", "held_out").mapInArrow(
        read, f"row string, key {key_type}, held_out boolean, word string, times long, n_known long, n_tokens long, "
              "base double, lp double"), "document-words")
    rare = (parts.filter("word is not null").select("row", "word", "times").join(solved.drop("n"), "word")
            .groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("r_known"),
                                F.sum(F.col("times") * F.col("base")).alias("r_base"),
                                F.sum(F.col("times") * F.col("lp")).alias("r_lp")))
    out = parts.filter("word is null").join(rare, "row", "left")
    zero = F.lit(0.0)
    return out.select(F.col("key").alias(key), "held_out", "n_tokens",
                      (F.col("n_known") + F.coalesce("r_known", F.lit(0))).alias("n_known"),
                      F.lit(total).cast("long").alias("train_tokens"),
                      (F.col("base") + F.coalesce("r_base", zero)).alias("base_score"),
                      (F.col("lp") + F.coalesce("r_lp", zero)).alias("score"))


def op7_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document by the model of the training documents."""
    import public_tokenizers
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))
