"""Host-level quality rules.

Each document is measured and held against rules.  Rule failures are summed by host; a host's failure
rate is shrunk by a beta prior fitted to all hosts, and the verdict on the host is joined back.  On a
host that fails, a document must also pass the strict rules; elsewhere, only the base rules reject.  A
clean document therefore stays whichever host it came from.

Measures, over words ``[^\\x20\\x09-\\x0D]+`` of the whole text: ``n_words``, ``word_chars`` (code points in
words), ``n_symbols`` (characters of ``[#*$%&|<>]``), ``n_dup_lines`` (lines with a word that equal an
earlier line), ``n_repeat_words`` (words inside 8-word windows found twice or more in the text).

Defined cases: null text has no words; a text of under 8 words has no window; documents without a host
form a host of their own; an empty table gives no rows; repeated rows are judged alike; other columns of
the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, text_of, written

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = "#*$%&|<>"
#: Strict rules, used on failing hosts and for the hosts' rates: percent of words or lines.
STRICT_SYMBOL_PERCENT = 30
STRICT_DUP_LINE_PERCENT = 30
STRICT_REPEAT_PERCENT = 20
STRICT_WORD_CHARS = (2, 15)  # mean code points a word
#: A host fails when its shrunken failure rate is above this.
HOST_LIMIT = 0.5

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that occur twice or more; exact, by ranks of doubled windows."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
    if len(number) == len(words):
        return 0
    width, ranks = 1, ids
    while width < window:  # a window of 2k words is a pair of windows of k words
        step = min(width, window - width)
        pairs = ranks[:-step] * (int(ranks.max()) + 1) + ranks[step:]
        _, ranks, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        if len(counts) == len(pairs):
            return 0
        width += step
    twice = counts[ranks] > 1
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, np.flatnonzero(twice), 1)
    np.add.at(edge, np.flatnonzero(twice) + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: str) -> tuple[int, int, int, int, int, int]:
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at x20 and x09-x0D, no other white space
    lines = [x for x in raw.split(b"\n") if x.strip()]
    blanks = sum(map(raw.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
    return (len(words), len(text) - blanks, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)),
            repeated_words(words), len(lines))


def measure_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """key, host and measures of every document, in one narrow pass."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = [measure(t) for t in b.column(2).to_pylist()]
            cols = [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 6
            yield pa.record_batch([b.column(0), b.column(1), *cols],
                                  ["key", "host", *(m.split()[0] for m in MEASURES.split(", "))])

    key_type = docs.schema[key].dataType.simpleString()
    return (docs.select(F.col(key).alias("key"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"),
                        text_of(text).alias("t"))
            .mapInArrow(run, f"key {key_type}, host string, {MEASURES}").withColumnRenamed("key", key))


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def strict_failed():
    """Base rules and the stricter ones; in whole numbers, so every engine agrees."""
    words = F.col("n_words")
    low, high = STRICT_WORD_CHARS
    return (F.col("base_failed")
            | (100 * F.col("n_repeat_words") > STRICT_REPEAT_PERCENT * words)
            | (100 * F.col("n_symbols") > STRICT_SYMBOL_PERCENT * words)
            | (100 * F.col("n_dup_lines") > STRICT_DUP_LINE_PERCENT * F.col("n_lines"))
            | (F.col("word_chars") < low * words) | (F.col("word_chars") > high * words))


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """Alpha and beta of the prior, by the moments of the hosts' rates.

    The prior's mean is the mean rate of hosts, its weight the one that explains their spread beyond
    what chance gives; between 1 and 1,000 documents' worth.
    """
    rate = F.col("failed") / F.col("n")
    m = hosts.agg(F.avg(rate).alias("m"), F.coalesce(F.var_pop(rate), F.lit(0.0)).alias("v"),
                  F.avg(1 / F.col("n")).alias("inv"))
    spread = F.col("m") * (1 - F.col("m"))
    between = F.greatest(F.col("v") - spread * F.col("inv"), F.lit(0.0))
    weight = F.least(F.greatest(spread / F.greatest(between, F.lit(1e-9)) - 1, F.lit(1.0)), F.lit(1000.0))
    row = m.select((F.col("m") * weight).alias("alpha"), ((1 - F.col("m")) * weight).alias("beta")).first()
    return row["alpha"] or 0.0, row["beta"] or 0.0  # two numbers; no host: no prior needed


def judge(measured: DataFrame) -> DataFrame:
    """Verdicts: the measures plus base_failed, strict_failed, host_rate, host_failed, kept.

    ``measured`` is read more than once, so hand in a written table.
    """
    rows = measured.withColumn("base_failed", base_failed()).withColumn("strict_failed", strict_failed())
    # summed per task before the shuffle: a host of a third of all rows sends one row per task
    hosts = rows.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("strict_failed").cast("long")).alias("failed"))
    alpha, beta = beta_prior(hosts)
    rates = hosts.select("host", ((F.col("failed") + F.lit(alpha)) / (F.col("n") + F.lit(alpha + beta))).alias("host_rate"))
    out = rows.join(rates, "host", "left").withColumn("host_failed", F.col("host_rate") > HOST_LIMIT)
    return out.withColumn("kept", ~F.col("base_failed") & ~(F.col("host_failed") & F.col("strict_failed")))


#: Places that a host's undecided rows are dealt to.
SALTS = 32


def verdicts(measured: DataFrame) -> DataFrame:
    """``measured`` plus base_failed, strict_failed and kept, as :func:`judge` gives them.

    A row that meets the strict rules, or fails the base rules, is judged by itself and stays in its task; only the others
    are joined to the failing hosts, and a host's rows are dealt to ``SALTS`` places there.
    """
    rows = measured.withColumn("base_failed", base_failed()).withColumn("strict_failed", strict_failed())
    hosts = rows.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("strict_failed").cast("long")).alias("failed"))
    hosts = written(hosts, "quality-hosts")
    alpha, beta = beta_prior(hosts)
    rate = (F.col("failed") + F.lit(alpha)) / (F.col("n") + F.lit(alpha + beta))
    failing = hosts.filter(rate > HOST_LIMIT).select("host", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"),
                                                     F.lit(True).alias("__fails"))
    asks = F.col("strict_failed") & ~F.col("base_failed")
    sure = rows.filter(~asks).withColumn("kept", ~F.col("base_failed"))
    salt = F.pmod(F.xxhash64("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.monotonically_increasing_id()), F.lit(SALTS))
    asked = rows.filter(asks).withColumn("__salt", salt.cast("int")).join(failing, ["host", "__salt"], "left")
    return sure.unionByName(asked.withColumn("kept", F.col("__fails").isNull()).drop("__salt", "__fails"))


def host_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Measures and verdict of every document (see :func:`judge`)."""
    return judge(written(measure_documents(docs, key, text, host), "quality"))


def keep_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """The rows that stay, with their columns."""
    at, host_at = docs.columns.index(text), docs.columns.index(host)
    names = [m.split()[0] for m in MEASURES.split(", ")]
    own = [f"__{i}" for i in range(len(docs.columns))]  # so that no column of the input clashes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = [measure(t or "") for t in b.column(at).to_pylist()]
            hosts = ["" if h is None else str(h) for h in b.column(host_at).to_pylist()]
            yield pa.record_batch([*b.columns, pa.array(hosts, pa.string()),
                                   *(pa.array(c, pa.int64()) for c in zip(*rows))], [*own, "host", *names])

    fields = ", ".join(f"{o} {f.dataType.simpleString()}" for o, f in zip(own, docs.schema.fields))
    measured = written(docs.mapInArrow(run, f"{fields}, host string, {MEASURES}"), "quality-rows")
    return verdicts(measured).filter("kept").select(*(F.col(o).alias(c) for o, c in zip(own, docs.columns)))


COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdicts of every document."""
    measured = written(measure_documents(table(spark, sf_dir, "documents").select("doc_id", "text", "source")), "quality")
    return verdicts(measured).select(*COLUMNS)


_WS = r"[\x20\x09-\x0D]+"
OP9_SQL = rf"""
with d as (select doc_id, coalesce(source, '') as host, coalesce(text, '') as t from documents),
w as (select doc_id, host, t, list_filter(regexp_split_to_array(t, '{_WS}'), lambda x: x <> '') as ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '{_WS}', '', 'g') <> '') as ls from d),
g as (select doc_id, i, list_aggregate(list_slice(ws, i, i + {WINDOW - 1}), 'string_agg', ' ') as win
      from (select doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) as i from w where len(ws) >= {WINDOW})),
tw as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, win) as c from g) where c > 1),
rp as (select doc_id, count(distinct i + k) as n_repeat_words from tw, range(0, {WINDOW}) r(k) group by doc_id),
m as (select w.doc_id, host, cast(len(ws) as bigint) as n_words,
             cast(length(regexp_replace(t, '{_WS}', '', 'g')) as bigint) as word_chars,
             cast(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
             cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines,
             cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words, len(ls) as n_lines
      from w left join rp on w.doc_id = rp.doc_id),
b as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words as base_failed from m),
s as (select *, base_failed or 100 * n_repeat_words > {STRICT_REPEAT_PERCENT} * n_words
             or 100 * n_symbols > {STRICT_SYMBOL_PERCENT} * n_words
             or 100 * n_dup_lines > {STRICT_DUP_LINE_PERCENT} * n_lines
             or word_chars < {STRICT_WORD_CHARS[0]} * n_words or word_chars > {STRICT_WORD_CHARS[1]} * n_words
             as strict_failed from b),
h as (select host, count(*) as n, count(*) filter (where strict_failed) as failed from s group by host),
p as (select avg(failed / n) as mu, coalesce(var_pop(failed / n), 0) as v, avg(1 / n) as inv from h),
q as (select mu, least(greatest(mu * (1 - mu) / greatest(greatest(v - mu * (1 - mu) * inv, 0), 1e-9) - 1, 1), 1000) as k from p),
r as (select host, (failed + mu * k) / (n + k) as host_rate from h, q)
select s.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and not (host_rate > {HOST_LIMIT} and strict_failed) as kept
from s join r on s.host = r.host
"""
