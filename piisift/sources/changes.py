"""Scheduled scans that see changed and deleted files (T1): the difference of two listings.

A scheduled scan lists the files, joins the listing with the one of the scan before, and scans only paths that are
new or whose size or time differ; findings of paths that are changed or gone are retired.  Listing and findings of a scan
are stored together and become current by one manifest, so a scan that fails leaves the state before.
"""

from __future__ import annotations

import uuid
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import versions

ADDED, CHANGED, DELETED, SAME = "added", "changed", "deleted", "same"
LISTING = "path string, size_bytes long, modified timestamp_ntz"


def listing_of(files: DataFrame) -> DataFrame:
    """path, size_bytes, modified; once per path (overlapping roots list a file twice)."""
    return files.groupBy("path").agg(F.max("size_bytes").cast("long").alias("size_bytes"),
                                     F.max("modified").cast("timestamp_ntz").alias("modified"))


def difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, change, and size and time as listed now (as listed before where the file is gone)."""
    b = before.select("path", F.col("size_bytes").alias("old_size"), F.col("modified").alias("old_modified"), F.lit(True).alias("was"))
    both = after.select("path", "size_bytes", "modified", F.lit(True).alias("is")).join(b, "path", "full")
    equal = F.col("size_bytes").eqNullSafe(F.col("old_size")) & F.col("modified").eqNullSafe(F.col("old_modified"))
    change = (F.when(F.col("was").isNull(), ADDED).when(F.col("is").isNull(), DELETED).when(equal, SAME).otherwise(CHANGED))
    return both.select("path", change.alias("change"), F.coalesce("size_bytes", "old_size").alias("size_bytes"),
                       F.coalesce("modified", "old_modified").alias("modified"))


def scheduled_scan(spark: SparkSession, files: DataFrame, base: str, scan_paths: Callable[[DataFrame], DataFrame]) -> dict[str, int]:
    """One scheduled scan into the store under ``base``; returns how many files had each change.

    ``files``: a listing (path, size_bytes, modified; more columns are kept for the scan).  ``scan_paths`` gets the
    rows of ``files`` to scan and returns their findings, with ``path``; each gets ``scanned_in``, the number of its scan.
    """
    number, state = versions.current(spark, base)
    folder = f"{base}/scan-{uuid.uuid4().hex}"
    before = spark.read.schema(LISTING).parquet(state["listing"]) if state else spark.createDataFrame([], LISTING)
    difference(before, listing_of(files)).write.parquet(f"{folder}/changes")
    changes = spark.read.parquet(f"{folder}/changes")
    changes.filter(F.col("change") != DELETED).select("path", "size_bytes", "modified").write.parquet(f"{folder}/listing")
    todo = changes.filter(F.col("change").isin(ADDED, CHANGED)).select("path")
    found = scan_paths(files.join(todo, "path", "left_semi")).withColumn("scanned_in", F.lit(number + 1).cast("long"))
    if state:
        old = spark.read.schema(found.schema).parquet(state["findings"])
        gone = changes.filter(F.col("change").isin(CHANGED, DELETED)).select("path")
        found = found.unionByName(old.join(gone, "path", "left_anti"))
    found.write.parquet(f"{folder}/findings")
    versions.publish(spark, base, number, {"listing": f"{folder}/listing", "findings": f"{folder}/findings"})
    return {r["change"]: r["count"] for r in changes.groupBy("change").count().collect()}  # at most four rows


def current_findings(spark: SparkSession, base: str) -> DataFrame:
    """Findings as of the last scan that ended."""
    _number, state = versions.current(spark, base)
    if not state:
        raise FileNotFoundError(f"no scan has ended under {base}")
    return spark.read.parquet(state["findings"])
