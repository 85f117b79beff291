"""A stored order of findings for paging (Q5, Q6), and posting lists over it for search (Q4).

The rank index holds the rows in the order of the view, dealt to ranges: folder ``part=<n>`` has the n-th range and
each row its rank inside.  A table of one row per part has the positions before it.  A page reads that table and the
one or two parts it lies in; it neither sorts nor copies the findings.

The search index lists, for each run of three letters of a row's name, path and masked value, the rows that hold it,
in lists of at most ``CHUNK_ROWS`` rows: a run of letters that every row holds has many bounded lists.  A search
reads the lists of its own letters only (folders by a hash of the three letters), keeps rows that are in all, reads those rows'
parts and confirms them with ``contains``.  Two spaces stand after each text, so one or two letters are found by the
lists that begin with them.
"""

from __future__ import annotations

import uuid
from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from .browse import PAGE_SIZE, default_seq

#: Rows that one posting list covers, and folders of lists.
CHUNK_ROWS, GRAM_BUCKETS = 65_536, 64


def build(findings: DataFrame, base: str, seq: Sequence[Column] | None = None, descending: bool = True) -> str:
    """Store the findings in their order under a new folder of ``base``; returns the folder."""
    folder = f"{base}/ranked-{uuid.uuid4().hex}"
    seq = list(seq or default_seq(findings))
    ordered = [c.desc() for c in seq] if descending else list(seq)
    part = F.spark_partition_id()
    rows = (findings.repartitionByRange(*ordered).sortWithinPartitions(*ordered)
            .withColumn("rank", F.monotonically_increasing_id() - F.shiftleft(part.cast("long"), 33) + 1)
            .withColumn("part", part))
    rows.write.partitionBy("part").parquet(f"{folder}/rows")
    spark = findings.sparkSession
    columns = T.StructType([*findings.schema.fields, T.StructField("rank", T.LongType()), T.StructField("part", T.IntegerType())])
    spark.createDataFrame([], columns).write.parquet(f"{folder}/columns")  # an index of no rows has them too
    sizes = rows_of(spark, folder).groupBy("part").agg(F.max("rank").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    sizes.withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0))).write.parquet(f"{folder}/parts")
    return folder


def rows_of(spark: SparkSession, folder: str) -> DataFrame:
    """All rows with ``part`` and ``rank``."""
    return spark.read.schema(spark.read.parquet(f"{folder}/columns").schema).parquet(f"{folder}/rows")


def page(spark: SparkSession, folder: str, page_no: int, size: int = PAGE_SIZE) -> DataFrame:
    """One page from the index: the rows with ``pos``, ``page`` and ``total``; clamped as ``browse.page`` does."""
    parts = spark.read.parquet(f"{folder}/parts")
    total = parts.agg(F.coalesce(F.sum("rows"), F.lit(0)).cast("long")).first()[0]
    last = max(1, -(-total // size))
    p = min(max(1, int(page_no)), last)
    first, end = (p - 1) * size + 1, p * size
    mine = parts.filter((F.col("before") < end) & (F.col("before") + F.col("rows") >= first)).collect()  # at most ``size`` parts
    rows, at = rows_of(spark, folder), F.lit(None).cast("long")
    for r in mine:
        at = F.when(F.col("part") == r["part"], F.lit(r["before"])).otherwise(at)
    pos = at + F.col("rank")
    return (rows.filter(F.col("part").isin([r["part"] for r in mine])).withColumn("pos", pos)
            .filter(F.col("pos").between(first, end)).drop("part", "rank")
            .withColumn("page", F.lit(p)).withColumn("total", F.lit(total).cast("long")))


def _hay() -> Column:
    return F.lower(F.concat_ws(" ", "file_name", "file_path", "masked_value"))


def _grams(text: Column) -> Column:
    padded = F.concat(text, F.lit("  "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substr(padded, i, F.lit(3))))


def build_search(spark: SparkSession, folder: str, chunk_rows: int = CHUNK_ROWS, buckets: int = GRAM_BUCKETS) -> None:
    """Posting lists over the rank index in ``folder``."""
    rows = rows_of(spark, folder).select("part", "rank", _hay().alias("hay")).filter(F.length("hay") > 0)
    each = rows.select("part", "rank", F.floor((F.col("rank") - 1) / chunk_rows).alias("chunk"), F.explode(_grams(F.col("hay"))).alias("gram"))
    lists = each.groupBy("gram", "part", "chunk").agg(F.sort_array(F.collect_list("rank")).alias("ranks"))
    bucket = F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int")
    (lists.withColumn("bucket", bucket).repartition("bucket", "part", "chunk").sortWithinPartitions("bucket", "gram")
     .write.partitionBy("bucket").parquet(f"{folder}/lists"))


def _all_lists(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("gram string, part int, chunk long, ranks array<long>, bucket int").parquet(f"{folder}/lists")


def _lists(spark: SparkSession, folder: str, grams: list[str], buckets: int) -> DataFrame:
    lists = _all_lists(spark, folder)
    wanted = spark.createDataFrame([(g,) for g in grams], "gram string").select(
        F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int")).distinct().collect()
    return lists.filter(F.col("bucket").isin([r[0] for r in wanted]) & F.col("gram").isin(grams))


def search(spark: SparkSession, folder: str, query: str | None, buckets: int = GRAM_BUCKETS) -> DataFrame:
    """The rows that ``browse.search`` finds, by the lists of the query's letters."""
    q = (query or "").strip().lower()
    rows = rows_of(spark, folder)
    if not q:
        return rows.drop("part", "rank")
    if len(q) < 3:
        # a short query: every list whose letters begin with it (folders are scanned for the letters alone)
        lists = _all_lists(spark, folder).filter(F.startswith("gram", F.lit(q)))
        found = lists.select("part", F.explode("ranks").alias("rank")).distinct()
    else:
        grams = sorted({q[i:i + 3] for i in range(len(q) - 2)})
        together = _lists(spark, folder, grams, buckets).groupBy("part", "chunk").agg(F.collect_list("ranks").alias("all"))
        # one list per gram and chunk, each bounded: rows in all of them
        common = F.reduce(F.slice("all", 2, len(grams)), F.col("all")[0], lambda a, b: F.array_intersect(a, b))
        found = together.filter(F.size("all") == len(grams)).select("part", F.explode(common).alias("rank"))
    return (rows.join(found, ["part", "rank"], "left_semi").filter(F.contains(_hay(), F.lit(q))).drop("part", "rank"))
