"""Exact deduplication over an extendible-hash index on shared files.

Each text is normalised (every run of ``[\\x20\\x09-\\x0D]`` becomes one space) and hashed to a 64-bit key.
The index is a table on the shared folder, one row per distinct text, in buckets that each own a range of
keys.  A directory of depth d looks at a key's first d bits; a bucket that holds more distinct keys than
its capacity is split by one more bit, the others stay, until none is overfull.  Buckets count distinct
keys, so a text with many copies takes one place.  Texts that share a key without being equal are chained:
their bytes are compared, and each gets its own link.

All of it is DataFrame code.  Copies meet map-side first, by their bytes: a group of a third of all rows sends
one row per task, each distinct text is shuffled once, and from there on only keys and digests move.  Neither
directory nor index visits the driver.

Defined cases: null text counts as empty, so null and empty texts are one group; the row with the smallest
key column stays, and of rows with equal texts and equal ids all are members and each such row is marked
kept; null ids count as larger than any other; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import table, text_of, written

#: Distinct keys a bucket holds before it is split.
CAPACITY = 4096


def normalised(text: str) -> Column:
    return F.regexp_replace(text_of(text), r"[\x20\x09-\x0D]+", " ")


def bucket_of(h: str = "h", depth: str = "depth") -> Column:
    """Lower end of the key range that the first ``depth`` bits of ``h`` name, in key order."""
    return F.expr(f"case when {depth} = 0 then 0L "
                  f"else shiftleft(shiftrightunsigned({h}, 64 - {depth}), 63 - {depth}) end")


def directory(keys: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``keys`` (column ``h``, distinct) plus the depth of the bucket that holds each.

    Starts at the depth of an evenly filled directory and doubles where a bucket is overfull.
    """
    total = keys.count()
    depth = max(0, int(math.floor(math.log2(total / capacity)))) if total > capacity else 0
    keys = keys.withColumn("depth", F.lit(depth))
    while True:
        counts = keys.groupBy("depth", bucket_of().alias("bucket")).count()
        over = counts.filter((F.col("count") > capacity) & (F.col("depth") < 62)).select("depth", "bucket")
        over = written(over, "overfull")
        if over.isEmpty():
            return keys
        split = (keys.withColumn("bucket", bucket_of())
                 .join(over.withColumn("more", F.lit(1)), ["depth", "bucket"], "left"))
        keys = written(split.select(*[c for c in keys.columns if c != "depth"],
                                    (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "directory")


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame]:
    """(entries, index), both on shared files.

    entries: one row per document: key, h, text_sha256.  index: one row per distinct text: bucket, depth,
    h, link (place in the chain of its key), text_sha256, keep_id, group_size; sorted by bucket and key.
    """
    rows = docs.select(F.col(key).alias("key"), normalised(text).alias("norm"))
    hashed = rows.withColumn("h", F.xxhash64("norm"))
    entries = written(hashed.select("key", "h", F.sha2("norm", 256).alias("text_sha256")), "entries")
    # equal bytes make one row per task before the shuffle, and none of the text goes on after it
    texts = written(hashed.groupBy("h", "norm").agg(F.min("key").alias("keep_id"), F.count("*").alias("group_size"))
                    .select("h", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size"), "texts")
    placed = directory(written(texts.select("h").distinct(), "keys"), capacity).withColumn("bucket", bucket_of())
    chain = W.partitionBy("h").orderBy(F.col("keep_id").asc_nulls_last(), "text_sha256")
    links = (texts.join(placed, "h").withColumn("link", F.row_number().over(chain))
             .select("bucket", "depth", "h", "link", "text_sha256", "keep_id", "group_size"))
    # owner tasks: each writes whole ranges of keys
    index = links.repartitionByRange("bucket", "h").sortWithinPartitions("bucket", "h", "link")
    return entries, written(index, "index")


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per document: key, keep_id, group_size, kept, text_sha256."""
    entries, index = build_index(docs, key, text, capacity)
    links = index.select("h", "text_sha256", "keep_id", "group_size")
    out = entries.join(links, ["h", "text_sha256"])
    return out.select(F.col("key").alias(key), "keep_id", "group_size",
                      F.col("key").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """The rows that stay, with their columns: one of each group of equal texts."""
    stay = (exact_groups(docs, key, text, capacity).filter("kept")
            .select(F.col(key).alias("__key"), F.col("text_sha256").alias("__sha")).distinct())
    # rows repeated with their key collapse map-side, before the join
    rows = docs.withColumn("__text_sha", F.sha2(normalised(text), 256)).dropDuplicates([key, "__text_sha"])
    same = rows[key].eqNullSafe(stay["__key"]) & (rows["__text_sha"] == stay["__sha"])
    return rows.join(stay, same, "left_semi").select(*docs.columns)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal normalised texts over all documents."""
    return exact_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP5_SQL = r"""
with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents)
select doc_id, min(doc_id) over (partition by t) as keep_id,
       count(*) over (partition by t) as group_size,
       doc_id = min(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
from n
"""
