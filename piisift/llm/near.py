"""Near-duplicate groups by Order MinHash and banded alignment.

The k-mers are shingles of five words, each labelled with its occurrence, so that repeats count.  Every
hash function samples the few k-mers of minimum hash and keeps them in text order: two texts fall into one
bucket only if they share these k-mers and their order, which makes the sketch sensitive to edit
similarity, not just to common words.

Texts of equal words are one text from the start.  In a bucket, each text is compared with the bucket's
hub, the text that meets most others.  A comparison aligns the two k-mer sequences inside the band that the
threshold allows; the similarity is shared k-mers of the alignment over all k-mers of both, and from
``SIMILARITY`` on they are linked.  Linked texts form components.  Where a bucket then still holds several,
every pair of its texts that lie in different components is compared as well, but for those that cannot reach the
similarity by their length or their rarest k-mers (``remaining_pairs``): the components are those of all pairs of
a bucket, and pairs inside a component, which would not change them, are never made.

Defined cases: null text is empty; empty texts are equal to each other; texts of under five words are one
k-mer, so only equal words link them; of a group, the text with the smallest key stays (the smaller digest
if keys tie), and rows that repeat it with the same key are marked kept too; null keys come last; an empty
table gives no row; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import slices, table, text_of, written

WORDS, SIMILARITY = 5, 0.8
#: k-mers of a sketch and number of sketches: a pair at 0.8 meets with probability 1 - (1 - 0.8**5)**28.
SAMPLED, SKETCHES = 5, 28
#: Short texts also get sketches of fewer k-mers: samples of five would be nearly whole texts.
SHORT, SHORT_SAMPLED, SHORT_SKETCHES = 20, 3, 24

_MASK = (1 << 64) - 1
_STEP = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(WORDS)], dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (multiply and shift), so that every bit of the input counts."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def shingles(words: list[bytes]) -> np.ndarray:
    """Hashes of the k-mers in text order; a text of fewer words is one k-mer."""
    import xxhash
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], dtype=np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = len(words) - WORDS + 1
    h = np.zeros(n, dtype=np.uint64)
    for k in range(WORDS):
        h += w[k:k + n] * _STEP[k]
    return _mixed(h)


def labelled(h: np.ndarray) -> np.ndarray:
    """The k-mers told apart by their occurrence in the text: all different."""
    n = len(h)
    if not n:
        return h
    order = np.argsort(h, kind="stable")
    ranked = h[order]
    starts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    occurrence = np.empty(n, dtype=np.uint64)
    occurrence[order] = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
    return _mixed(h + occurrence * np.uint64(0xD1B54A32D192ED03))


def sketches(h: np.ndarray, sampled: int, number: int, family: int) -> list[tuple[int, int]]:
    """(bucket, order among its members) of each sketch, as signed 64-bit integers."""
    n, out = len(h), []
    if not n:
        return out
    seeds = _mixed(np.arange(1, number + 1, dtype=np.uint64) + np.uint64(family << 32))
    more = min(n, sampled + 3)
    at_once = max(1, 1_000_000 // n)
    for j in range(0, number, at_once):
        seed = seeds[j:j + at_once, None]
        v = _mixed(h[None, :] ^ seed)
        low = np.argpartition(v, more - 1, axis=1)[:, :more] if more < n else np.tile(np.arange(n), (len(seed), 1))
        low = np.take_along_axis(low, np.argsort(np.take_along_axis(v, low, 1), axis=1, kind="stable"), 1)
        key = seed[:, 0].copy()
        for column in np.sort(low[:, :sampled], axis=1).T:  # in text order
            key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + h[column])
        rest = np.zeros(len(seed), dtype=np.uint64)
        for k in range(3):  # the next minima, most significant first
            bits = np.take_along_axis(v, low[:, sampled + k:sampled + k + 1], 1)[:, 0] >> np.uint64(43) \
                if sampled + k < more else np.zeros(len(seed), dtype=np.uint64)
            rest = (rest << np.uint64(21)) | bits
        out += zip(key.view(np.int64).tolist(), rest.view(np.int64).tolist())
    return out


def all_sketches(words: list[bytes]) -> list[tuple[int, int]]:
    h = labelled(shingles(words))
    out = sketches(h, SAMPLED, SKETCHES, 1)
    return out + sketches(h, SHORT_SAMPLED, SHORT_SKETCHES, 2) if len(h) <= SHORT else out


def edits(a: list[int], b: list[int], limit: int) -> int | None:
    """Fewest insertions and deletions that make ``a`` into ``b``; None if more than ``limit``.

    Furthest reach on each diagonal; only the band of diagonals within ``limit`` is visited.
    """
    n, m = len(a), len(b)
    if abs(n - m) > limit:
        return None
    reach = [-1] * (2 * limit + 3)  # reach[limit + 1 + k]: furthest place in a on diagonal k
    mid = limit + 1
    reach[mid + 1] = 0
    for d in range(limit + 1):
        for k in range(-d, d + 1, 2):
            if k > n or -k > m:
                continue
            down, right = reach[mid + k + 1], reach[mid + k - 1] + 1
            x = down if k == -d or (k != d and down >= right) else right
            y = x - k
            while x < n and y < m and a[x] == b[y]:
                x += 1
                y += 1
            reach[mid + k] = x
            if x >= n and y >= m:
                return d
    return None


def similarity(h: np.ndarray, g: np.ndarray, at_least: float = SIMILARITY) -> float:
    """Shared k-mers of the best banded alignment over all k-mers of both; 0.0 below ``at_least``.

    ``h`` and ``g`` are the k-mers of two texts in order.  With e insertions and deletions of k-mers between
    them, the similarity is (n - e) / (n + e) for n k-mers in all, so the threshold is a band.
    """
    n = len(h) + len(g)
    if not len(h) or not len(g) or min(len(h), len(g)) < at_least * max(len(h), len(g)):
        return float(len(h) == len(g))
    both = len(np.intersect1d(labelled(h), labelled(g), assume_unique=True))
    if both < at_least * (n - both):
        return 0.0  # no alignment shares more k-mers than the two multisets do
    end = min(len(h), len(g))
    same = h[:end] == g[:end]
    lo = end if same.all() else int(same.argmin())
    same = h[len(h) - end + lo:][::-1] == g[len(g) - end + lo:][::-1]
    hi = len(same) if same.all() else int(same.argmin())
    limit = int(n * (1 - at_least) / (1 + at_least) + 1e-9)
    e = edits(h[lo:len(h) - hi].tolist(), g[lo:len(g) - hi].tolist(), limit)
    return 0.0 if e is None else (n - e) / (n + e)


def digest_of(text: str) -> Column:
    """The digest of a text's words, as a column."""
    words = F.trim(F.regexp_replace(text_of(text), r"[\x20\x09-\x0D]+", " "))
    return F.unhex(F.md5(words.cast("binary")))


def sketch_documents(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, digest of the words and buckets of every row; one narrow pass."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("b", pa.int64()), ("f", pa.int64())]))
        for b in slices(batches):
            digest, found = [], []
            for t in b.column(1).to_pylist():
                words = words_of(t)
                digest.append(hashlib.md5(b" ".join(words), usedforsecurity=False).digest())
                found.append([{"b": x, "f": y} for x, y in all_sketches(words)])
            yield pa.record_batch([b.column(0), pa.array(digest, pa.binary()), pa.array(found, kind)],
                                  ["key", "digest", "buckets"])

    key_type = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), text_of(text).alias("t")).mapInArrow(
        run, f"key {key_type}, digest binary, buckets array<struct<b:bigint,f:bigint>>")


#: Candidates of a text that are aligned first, those that share most k-mers.
FIRST = 4
#: K-mers of texts that a task keeps between comparisons.
KMERS_HELD = 500_000


def _ordered(a: str, b: str):
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def hub_pairs(members: DataFrame) -> DataFrame:
    """a, b: each member of a bucket with its hub, the member that meets most others.  Linear in the members."""
    hubs = members.groupBy("b").agg(F.max_by("digest", F.struct("reach", "digest")).alias("hub"))
    return members.join(hubs, "b").filter("digest <> hub").select(*_ordered("digest", "hub")).distinct()


def prefix_length(n: int, at_least: float = SIMILARITY) -> int:
    """Of the n k-mers of a text, in any order that all texts share, a text that reaches the similarity holds one of so
    many first ones, as it holds ``at_least`` of them all."""
    return n - math.ceil(at_least * n - 1e-9) + 1


def text_kmers(texts: DataFrame) -> DataFrame:
    """digest, comp, n (k-mers of the text), budget (its prefix's length), k: one row per k-mer of a text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [labelled(shingles(words_of(t))).view(np.int64) for t in b.column(2).to_pylist()]
            size = [len(h) for h in found]
            flat = pa.array(np.concatenate(found) if found else np.zeros(0, dtype=np.int64), pa.int64())
            ends = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32), pa.int32())
            yield pa.record_batch([b.column(0), b.column(1), pa.array(size, pa.int32()),
                                   pa.array([prefix_length(n) for n in size], pa.int32()), pa.ListArray.from_arrays(ends, flat)],
                                  ["digest", "comp", "n", "budget", "ks"])

    kmers = texts.select("digest", "comp", "t").mapInArrow(run, "digest binary, comp binary, n int, budget int, ks array<bigint>")
    return kmers.select("digest", "comp", "n", "budget", F.explode("ks").alias("k"))


def remaining_pairs(texts: DataFrame) -> DataFrame:
    """x, y, shared: every pair of texts of different components that can reach the similarity.

    ``texts``: digest, comp, t.  Exact: pairs that share none of the rarest k-mers of either (``prefix_length`` of them),
    or differ too much in length, cannot reach it, nor can those whose first common k-mer leaves too few behind it in the
    order of all k-mers by rarity; a pair is met at that k-mer at least.  In the group of a k-mer only texts outside its largest component
    look for partners, so a group that is one component but for a few texts costs these few times its members.
    """
    kmers = written(text_kmers(texts), "kmers")
    often = kmers.groupBy("k").agg(F.count("*").alias("often"), (F.min("comp") < F.max("comp")).alias("open")).filter("often > 1")
    common = kmers.join(often, "k")
    # k-mers of one text only come first in its order and meet nobody
    alone = common.groupBy("digest").agg((F.first("budget") - F.first("n") + F.count("*")).alias("left"),
                                         F.count("*").alias("met")).filter("left > 0")
    rank = F.row_number().over(Window.partitionBy("digest").orderBy("often", "k"))
    prefix = written(common.join(alone, "digest").withColumn("place", rank).filter("place <= left AND open")
                     .select("digest", "comp", "n", "k", (F.col("met") - F.col("place")).alias("after")), "prefix")
    sizes = prefix.groupBy("k", "comp").count().groupBy("k").agg(
        F.max_by("comp", F.struct("count", "comp")).alias("main"), F.count("*").alias("comps")).filter("comps > 1")
    small = prefix.join(sizes, "k").filter("comp <> main").select(
        "k", "main", F.col("digest").alias("x"), F.col("comp").alias("x_comp"), F.col("n").alias("x_n"), F.col("after").alias("x_after"))
    both = small.join(prefix, "k").filter("x_comp <> comp AND (comp = main OR x < digest)")
    fits = F.least("n", "x_n") >= F.lit(SIMILARITY - 1e-9) * F.greatest("n", "x_n")
    # shared k-mers are at least this part of the k-mers of both; at the first one, all others come after it
    fits &= F.least("after", "x_after") + 1 >= F.lit(SIMILARITY / (1 + SIMILARITY) - 1e-9) * (F.col("n") + F.col("x_n"))
    return both.filter(fits).groupBy("x", F.col("digest").alias("y")).agg(F.count("*").alias("shared"))


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose alignment reaches the similarity."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[bytes, tuple[np.ndarray, frozenset]] = {}  # bounded: emptied when it holds enough
        held = 0
        for b in slices(batches):
            keep = []
            for i, ends in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                found = []
                for c, d in enumerate(ends):
                    if d not in own:
                        h = shingles(words_of(b.column(2 + c)[i].as_py()))
                        if held > KMERS_HELD:
                            own, held = {}, 0
                        own[d], held = (h, frozenset(labelled(h).tolist())), held + len(h)
                    found.append(own[d])
                (h, hs), (g, gs) = found
                both = len(hs & gs)
                # no alignment shares more k-mers than the two multisets do
                if both >= SIMILARITY * (len(h) + len(g) - both) and similarity(h, g):
                    keep.append(i)
            yield b.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    with_text = (pairs.join(texts.select(F.col("digest").alias("a"), F.col("t").alias("s")), "a")
                 .join(texts.select(F.col("digest").alias("b"), "t"), "b"))
    return with_text.select("a", "b", "s", "t").mapInArrow(run, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """digest, comp (smallest digest of the component) of every linked digest, by smallest labels and jumps."""
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = written(both.groupBy(F.col("a").alias("digest")).agg(F.min(F.least("a", "b")).alias("comp")), "labels")
    while True:
        heard = (both.join(labels.select(F.col("digest").alias("b"), "comp"), "b")
                 .groupBy(F.col("a").alias("digest")).agg(F.min("comp").alias("heard")))
        low = labels.join(heard, "digest").select("digest", "comp", F.least("comp", "heard").alias("low"))
        jump = labels.select(F.col("digest").alias("low"), F.col("comp").alias("far"))
        moved = written(low.join(jump, "low", "left").select(
            "digest", F.least("low", F.coalesce("far", "low")).alias("comp"),
            (F.col("comp") > F.least("low", F.coalesce("far", "low"))).alias("changed")), "labels")
        labels = moved.select("digest", "comp")
        if moved.filter("changed").isEmpty():
            return labels


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, class_id (smallest key of its group), class_size, kept."""
    rows = written(sketch_documents(docs, key, text), "sketches")
    bodies = docs.select(digest_of(text).alias("digest"), text_of(text).alias("t"))
    own = rows.groupBy("digest").agg(F.first("buckets").alias("buckets"))
    places = own.select("digest", F.explode("buckets").alias("p")).select("digest", "p.b", "p.f")
    sizes = places.groupBy("b").agg(F.count("*").alias("size")).filter("size > 1")
    shared = written(places.join(sizes, "b"), "shared")
    reach = shared.groupBy("digest").agg(F.sum("size").alias("reach"))
    members = written(shared.drop("size").join(reach, "digest"), "buckets")
    texts = written(bodies.join(members.select("digest").distinct(), "digest", "left_semi")
                    .groupBy("digest").agg(F.first("t").alias("t")), "texts")
    links = written(verify(written(hub_pairs(members), "pairs"), texts), "found")
    labels = components(links)
    # texts of buckets that still hold several components
    now = members.join(labels, "digest", "left").withColumn("comp", F.coalesce("comp", "digest"))
    several = now.groupBy("b").agg((F.min("comp") < F.max("comp")).alias("open")).filter("open").select("b")
    open_texts = now.join(several, "b", "left_semi").select("digest", "comp").distinct()
    rest = written(remaining_pairs(texts.join(open_texts, "digest")), "rest")
    for first in (True, False):
        todo = rest
        if first:  # most links are found, and most other pairs settled, by the likeliest partners
            todo = rest.withColumn("place", F.row_number().over(Window.partitionBy("x").orderBy(F.desc("shared"), "y")))
            todo = todo.filter(F.col("place") <= FIRST)
        elif not found.isEmpty():  # the others, unless both texts are in one component by now
            of = lambda c: labels.select(F.col("digest").alias(c), F.col("comp").alias(f"{c}_comp"))
            todo = rest.join(of("x"), "x", "left").join(of("y"), "y", "left")
            todo = todo.filter(F.coalesce("x_comp", "x") != F.coalesce("y_comp", "y"))
        pairs = todo.select(*_ordered("x", "y")).distinct()
        if not first:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        tried = written(pairs, "pairs")
        found = written(verify(tried, texts), "found")
        if not found.isEmpty():
            links = links.unionByName(found)
            labels = components(links)
    ids = rows.select("key", "digest")
    all_rows = ids.join(labels, "digest", "left").withColumn("comp", F.coalesce("comp", "digest"))
    classes = all_rows.groupBy("comp").agg(
        F.min("key").alias("class_id"), F.count("*").alias("class_size"),
        F.min_by("digest", F.struct(F.col("key").isNull().alias("last"), F.col("key"), F.col("digest"))).alias("first"))
    return all_rows.join(classes, "comp").select(
        F.col("key").alias(key), "class_id", "class_size",
        (F.col("key").eqNullSafe(F.col("class_id")) & (F.col("digest") == F.col("first"))).alias("kept"), "digest")


def drop_near(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with their columns: one document of each group."""
    stay = (near_groups(docs, key, text).filter("kept")
            .select(F.col(key).alias("__key"), F.col("digest").alias("__digest")).distinct())
    # rows repeated with their key collapse map-side, before the join
    rows = docs.withColumn("__words", digest_of(text)).dropDuplicates([key, "__words"])
    same = rows[key].eqNullSafe(stay["__key"]) & (rows["__words"] == stay["__digest"])
    return rows.join(stay, same, "left_semi").select(*docs.columns)


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return near_groups(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("digest")
