"""Helpers shared by the training-data operators: inputs, shared scratch tables, files on any store."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, ship_package

#: Rows handled at once inside a Python task: bounds the memory of long texts.
ROWS_AT_ONCE = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, as a file or a folder of files, from any store Spark can read."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_of(col: str) -> Column:
    """The text of a column; null counts as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def shared_root(spark: SparkSession) -> str:
    """The shared folder of the cluster as Spark names it, scheme included."""
    ensure_checkpoint_dir(spark)
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    return (root if "://" in root or root.startswith("file:") else f"file://{root}").rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder name under the shared folder, never used before."""
    return f"{shared_root(spark)}/llm/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts the lineage with a durable copy: a lost executor costs a re-read, not a recomputation.
    """
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_range(df: DataFrame, *cols) -> DataFrame:
    """Ranges of the given order: as many as the session's setting, or as the input has splits if those are more."""
    splits = df.rdd.getNumPartitions()
    if splits > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return df.repartitionByRange(splits, *cols)
    return df.repartitionByRange(*cols)


def store_of(uri: str):
    """``(pyarrow file system, path)`` of a URI (file, hdfs, s3, gs)."""
    from pyarrow import fs
    if "://" not in uri:
        return fs.LocalFileSystem(), uri.replace("file:", "", 1)
    return fs.FileSystem.from_uri(uri)


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of at most ``rows`` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
