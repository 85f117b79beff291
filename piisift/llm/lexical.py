"""Ranked lexical search for a set of items over all documents, by two trees.

Terms are the maximal runs of ASCII letters, digits and characters beyond ASCII, with A-Z lower-cased.  A
document's score for an item is the sum, over the item's terms, of the term's weight times the document's
impact for it; all whole numbers but the weight's logarithm (see :func:`weight` and :func:`impacts`).

Items and documents each form a hierarchy whose nodes hold coordinate maxima: an item node the terms (with
their weights) of any item below it, a document node each term's largest impact below it.  The product of the
two is at least the score of every pair below.  A pair of nodes is left out when that bound is below the
weakest k-th score among the node's items, so whole batches of documents go at once; whatever is not
left out is scored exactly.  Equal bounds are never left out, so ties are decided by key alone.

Spark divides the work: one narrow pass turns texts into vectors over the items' terms (written once), counts
are sums over all documents, each task searches the trees of its own documents, and the best k of each task meet
in a top-k per item.  A first search over the documents whose hash falls in one class of ``SEED_SHARE`` gives
k-th scores that every task of the search over all documents starts from; they only prune.

Items come in blocks of a fixed number of terms, so what a task holds does not grow with the table of items.

Defined cases: a null or empty text has no term, counts in no statistic and is never found; an item without a
known term has no row; rows of one item id are one item with the terms of all of them, null ids too; every row of
documents counts as a document, repeated ids included, and null keys rank after all others of equal score; empty
tables give no row; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import slices, table, text_of, written

#: Results per item, (item, term) pairs of a block of items, documents per leaf, children per node.
TOP, BLOCK_TERMS, LEAF, FAN = 50, 100_000, 16, 8
#: One document in so many is searched first, for k-th scores to start from.
SEED_SHARE = 64

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The same in bytes of UTF-8: everything else becomes a blank.
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def length_factor(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """50 + 50 n N div L, in Python's whole numbers, which do not overflow."""
    return np.array([50 + 50 * x * n_docs // n_terms for x in n.tolist()], dtype=np.int64)


def vectors(docs: DataFrame, vocabulary: list[str], key: str, text: str) -> DataFrame:
    """key, n (all terms of the text), terms (numbers in the vocabulary), tfs: rows of documents with a term."""
    number = {t.encode(): i for i, t in enumerate(vocabulary)}
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = number.get
        for b in slices(batches):
            rows, ns, terms, tfs = [], [], [], []
            for i, body in enumerate(b.column(1).to_pylist()):
                words = terms_of(body)
                if not words:
                    continue
                known = np.array([x for x in map(find, words) if x is not None], dtype=np.int64)
                ids, counts = np.unique(known, return_counts=True)
                rows.append(i)
                ns.append(len(words))
                terms.append(ids)
                tfs.append(counts)
            yield pa.record_batch([b.column(0).take(pa.array(rows, pa.int64())), pa.array(ns, pa.int64()),
                                   pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))],
                                  ["key", "n", "terms", "tfs"])

    return (docs.select(F.col(key).alias("key"), text_of(text).cast("string").cast("binary").alias("body"))
            .mapInArrow(run, f"key {key_type}, n long, terms array<int>, tfs array<long>"))


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of the given spans, one after the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


class ItemTree:
    """Levels of item nodes, finest (single items) first; each knows, per term, the nodes that hold it."""

    def __init__(self, item: np.ndarray, term: np.ndarray, weights: np.ndarray):
        self.n, self.weights = int(item.max()) + 1, weights
        # items that share their commonest term lie together
        by = np.lexsort((weights[term], item))
        first = by[np.searchsorted(item[by], np.arange(self.n))]
        self.order = np.argsort(term[first], kind="stable")
        place = np.empty(self.n, dtype=np.int64)
        place[self.order] = np.arange(self.n)
        node, self.levels, self.sizes = place[item], [], []
        size = 1
        while True:
            pairs = np.unique(term * (self.n + 1) + node)
            terms, nodes = pairs // (self.n + 1), pairs % (self.n + 1)
            self.levels.append((np.searchsorted(terms, np.arange(len(weights) + 1)), nodes))
            self.sizes.append(size)
            if node.max() == 0:
                break
            node, size = node // FAN, size * FAN

    def nodes(self, level: int) -> int:
        return -(-self.n // self.sizes[level])

    def weakest(self, level: int, kth: np.ndarray) -> np.ndarray:
        """Smallest k-th score among the items of each node (``kth`` in the order of the tree)."""
        return np.minimum.reduceat(kth, np.arange(0, self.n, self.sizes[level]))

    def bounds(self, level: int, terms: np.ndarray, values: np.ndarray, row: np.ndarray | None = None, rows: int = 1) -> np.ndarray:
        """Sum of weight times value per node of the level, for each row of (term, value) entries."""
        at, nodes = self.levels[level]
        sizes = at[terms + 1] - at[terms]
        width = self.nodes(level)
        hit = nodes[_spans(at[terms], sizes)]
        if row is not None:
            hit = hit + np.repeat(row * width, sizes)
        return np.bincount(hit, np.repeat(self.weights[terms] * values, sizes), rows * width).reshape(rows, width)


class DocTree:
    """Levels of document nodes, single documents first: entries (term, largest impact) per node."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, weights: np.ndarray):
        value = weights[term] * impact
        last = np.lexsort((term, value, doc))
        ends = np.append(np.flatnonzero(np.diff(doc[last])), len(last) - 1)
        top = last[ends]  # each document's heaviest entry
        docs = doc[top]
        self.order = docs[np.lexsort((-value[top], term[top]))]
        place = np.empty(int(doc.max()) + 1, dtype=np.int64)
        place[self.order] = np.arange(len(self.order))
        node, self.levels, step = place[doc], [], LEAF
        width = len(weights)
        while True:
            by = np.lexsort((term, node))
            node, term, impact = node[by], term[by], impact[by]
            new = np.append(True, np.diff(node * width + term) != 0)
            heads = np.flatnonzero(new)
            node, term, impact = node[heads], term[heads], np.maximum.reduceat(impact, heads)
            count = int(node[-1]) + 1
            self.levels.append((np.searchsorted(node, np.arange(count + 1)), term, impact))
            if count == 1 and len(self.levels) > 1:
                break
            node, step = node // step, FAN

    def children(self, level: int, node: int) -> range:
        step = LEAF if level == 1 else FAN
        return range(node * step, min((node + 1) * step, len(self.levels[level - 1][0]) - 1))


def search_trees(items: ItemTree, docs: DocTree, floor: np.ndarray, heaps: list[list], k: int) -> int:
    """Put each item's best documents of this tree on its heap of (score, -ordinal); items in the tree's order.

    ``floor`` holds scores that the items' k-th documents are known to reach.  Returns the pairs of nodes seen.
    """
    kth = np.maximum(floor, [h[0][0] if len(h) == k else 0 for h in heaps]).astype(np.float64)
    seen = 0
    # node pairs still to be met: document level and node, item level and the item nodes alive
    stack = [(len(docs.levels) - 1, 0, len(items.levels) - 1, np.arange(items.nodes(len(items.levels) - 1)))]
    while stack:
        d, b, level, alive = stack.pop()
        at, terms, values = docs.levels[d]
        part = slice(at[b], at[b + 1])
        bound = items.bounds(level, terms[part], values[part])[0][alive]
        seen += len(alive)
        alive = alive[(bound > 0) & (bound >= items.weakest(level, kth)[alive])]
        if not len(alive):
            continue
        if level:  # children of the item nodes, and of the document node unless it is a leaf
            below = (alive[:, None] * FAN + np.arange(FAN)).ravel()
            below = below[below < items.nodes(level - 1)]
            stack += [(d - 1, c, level - 1, below) for c in docs.children(d, b)] if d > 1 else [(d, b, level - 1, below)]
        elif d > 1:
            stack += [(d - 1, c, 0, alive) for c in docs.children(d, b)]
        else:  # a leaf: the vectors themselves, whose bounds are the scores
            own = docs.children(1, b)
            at, terms, values = docs.levels[0]
            part = slice(at[own.start], at[own.stop])
            row = np.repeat(np.arange(len(own)), np.diff(at[own.start:own.stop + 1]))
            scores = items.bounds(0, terms[part], values[part], row, len(own))[:, alive]
            for r, c in zip(*np.nonzero((scores > 0) & (scores >= kth[alive]))):
                i, score = alive[c], int(scores[r, c])
                entry = (score, -int(docs.order[own.start + r]))
                if len(heaps[i]) < k:
                    heapq.heappush(heaps[i], entry)
                elif entry > heaps[i][0]:
                    heapq.heapreplace(heaps[i], entry)
                if len(heaps[i]) == k:
                    kth[i] = max(kth[i], heaps[i][0][0])
    return seen


def _searcher(pairs: tuple[np.ndarray, np.ndarray], weights: np.ndarray, floor: np.ndarray, n_docs: int, n_terms: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, best, key_type = None, [], None
        for batch in batches:
            if items is None:
                items = ItemTree(*pairs, weights)
                best = [[] for _ in range(items.n)]  # (score, key), in the order of the tree
                start = floor[items.order]
            key_type = batch.schema.field(0).type
            sizes = np.diff(batch.column(2).offsets.to_numpy())
            term = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            if not len(term):
                continue
            tf = batch.column(3).flatten().to_numpy(zero_copy_only=False)
            m = length_factor(batch.column(1).to_numpy(), n_docs, n_terms)
            doc = np.repeat(np.arange(batch.num_rows), sizes)
            # ordinals that order the keys of this batch and of the best so far, null keys last
            keys = batch.column(0).to_pylist()
            held = [key for heap in best for _s, key in heap]
            by = sorted(range(len(keys) + len(held)), key=lambda i, a=keys + held: (a[i] is None, 0 if a[i] is None else a[i]))
            ordinal = np.empty(len(by), dtype=np.int64)
            ordinal[by] = np.arange(len(by))
            heaps, at = [], len(keys)
            for heap in best:
                heaps.append([(s, -int(ordinal[at + i])) for i, (s, _key) in enumerate(heap)])
                heapq.heapify(heaps[-1])
                at += len(heap)
            named = [(keys + held)[i] for i in by]
            tree = DocTree(ordinal[doc], term, impacts(tf, m[doc]), weights)
            search_trees(items, tree, start, heaps, k)
            best = [[(s, named[-o]) for s, o in heap] for heap in heaps]
        rows = [(int(items.order[i]), key, s) for i, heap in enumerate(best) for s, key in heap]
        if rows:
            item, key, score = zip(*rows)
            yield pa.record_batch([pa.array(item, pa.int32()), pa.array(key, key_type), pa.array(score, pa.int64())],
                                  ["item", "key", "score"])

    return run


def _top(found: DataFrame, k: int) -> DataFrame:
    best_first = W.partitionBy("item").orderBy(F.desc("score"), F.col("key").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
           item_text: str = "text", k: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """The k best documents of each item: item, rank (from 1), key, score."""
    spark = docs.sparkSession
    key_type, item_type = (df.schema[c].dataType.simpleString() for df, c in ((docs, key), (items, item)))
    found_terms = F.regexp_extract_all(F.translate(text_of(item_text), UPPER, LOWER), F.lit(TERM), F.lit(0))
    pairs = items.select(F.col(item).alias("item"), F.explode(found_terms).alias("term")).distinct()
    counts = pairs.groupBy("item").count()
    # one short row per item: blocks of items by the running number of their terms
    counts = counts.select(F.col("item").alias("of"), F.floor((F.sum("count").over(W.orderBy("item")) - 1) / block_terms).alias("block"))
    pairs = written(pairs.join(counts, F.col("item").eqNullSafe(F.col("of"))).select("item", "term", "block"), "lexical-items")
    result = None
    for (block,) in sorted(pairs.select("block").distinct().collect()):  # a number for each block
        mine = pairs.filter(F.col("block") == block).select("item", "term").collect()  # at most one block's terms
        vocabulary = sorted({r["term"] for r in mine})
        numbers = {t: i for i, t in enumerate(vocabulary)}
        ids = sorted({r["item"] for r in mine}, key=lambda x: (x is None, 0 if x is None else x))
        index = {x: i for i, x in enumerate(ids)}
        vecs = written(vectors(docs, vocabulary, key, text), "lexical-vectors")
        n_docs, n_terms = vecs.agg(F.count("*"), F.sum("n")).first()
        df = dict(vecs.select(F.explode("terms").alias("term")).groupBy("term").count().collect())
        weights = np.array([weight(n_docs, df[i]) if i in df else 0 for i in range(len(vocabulary))], dtype=np.int64)
        of = (np.array([index[r["item"]] for r in mine]), np.array([numbers[r["term"]] for r in mine]))
        schema, floor = f"item int, key {key_type}, score long", np.zeros(len(ids))
        hits = vecs.filter(F.size("terms") > 0)
        seeds = hits.filter(F.pmod(F.xxhash64("key", "n", "terms"), F.lit(SEED_SHARE)) == 0)
        few = _top(seeds.mapInArrow(_searcher(of, weights, floor, n_docs, n_terms, k), schema), k)
        for row in few.filter(F.col("rank") == k).select("item", "score").collect():  # one number per item of the block
            floor[row["item"]] = row["score"]
        best = _top(hits.mapInArrow(_searcher(of, weights, floor, n_docs, n_terms, k), schema), k)
        names = spark.createDataFrame(list(enumerate(ids)), f"item int, name {item_type}")
        one = best.join(F.broadcast(names), "item").select(F.col("name").alias(item), F.col("rank").cast("int").alias("rank"),
                                                           F.col("key").alias(key), "score")
        result = one if result is None else result.unionByName(one)
    if result is None:
        result = spark.createDataFrame([], f"`{item}` {item_type}, rank int, `{key}` {key_type}, score long")
    return result


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents for each benchmark item: item_id, rank, doc_id, score."""
    return search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


OP13_SQL = rf"""
with d as (select doc_id, row_number() over () as r,
                  regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') as ts from documents),
s as (select count(*) as docs, sum(len(ts)) as terms from d where len(ts) > 0),
tf as (select r, t, count(*) as tf from (select r, unnest(ts) as t from d) group by r, t),
df as (select t, count(*) as df from tf group by t),
w as (select t, cast(floor(1000 * ln(cast(2 * docs + 2 as double) / cast(2 * df + 1 as double))) as bigint) as w from df, s),
m as (select r, doc_id, 50 + (50 * len(ts) * docs) // terms as m from d, s where len(ts) > 0),
i as (select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}')) as t
      from benchmark),
x as (select item_id, m.r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) as score
      from i join w on i.t = w.t join tf on i.t = tf.t join m on m.r = tf.r group by item_id, m.r, doc_id),
k as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from x where score > 0)
select item_id, cast(rank as integer) as rank, doc_id, cast(score as bigint) as score from k where rank <= {TOP}
"""
