"""Stored runs as a keyed table (H1, H3, H8): a run sent twice is stored once.

The table is cut into buckets by a hash of the run id.  An upsert keeps the newest row of each id in the batch,
merges it with the touched buckets alone, writes those buckets anew, one file each, and switches the manifest at once (see
:mod:`piisift.operators.versions`).  Many small batches therefore leave one file per bucket, and a reader has one whole state.

Of rows with equal id the one with the highest ``seq`` stays; the stored row wins a tie, so sending a batch
again changes nothing.  A null id is an id like any other.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import versions

#: Buckets of a new table; fixed by its first manifest.
BUCKETS = 16
ATTEMPTS = 10


def _newest(rows: DataFrame, key: str, seq: str) -> DataFrame:
    others = [c for c in rows.columns if c not in (key, "__stored")]
    order = F.struct(F.col(seq), F.col("__stored"))
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("r")).select(key, "r.*")


def upsert(batch: DataFrame, base: str, key: str = "run_id", seq: str = "seq", buckets: int = BUCKETS) -> int:
    """Merge a batch of runs into the table under ``base``; returns the number of its new state."""
    spark = batch.sparkSession
    for _ in range(ATTEMPTS):
        number, state = versions.current(spark, base)
        n = state.get("buckets", buckets)
        place = F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
        fresh = _newest(batch.withColumn("__stored", F.lit(False)), key, seq).select(*batch.columns)
        touched = [r[0] for r in fresh.select(place.alias("b")).distinct().collect()]  # at most one number per bucket
        paths = [state["paths"][str(b)] for b in touched if str(b) in state.get("paths", {})]
        rows = fresh.withColumn("__stored", F.lit(False))
        if paths:
            rows = rows.unionByName(spark.read.schema(batch.schema).parquet(*paths).withColumn("__stored", F.lit(True)))
        merged = _newest(rows, key, seq).select(*batch.columns).withColumn("__bucket", place)
        folder = f"{base}/data-{uuid.uuid4().hex}"
        merged.repartition(max(1, len(touched)), "__bucket").write.partitionBy("__bucket").parquet(folder)
        paths = {**state.get("paths", {}), **{str(b): f"{folder}/__bucket={b}" for b in touched}}
        try:
            return versions.publish(spark, base, number, {"buckets": n, "paths": paths})
        except versions.Conflict:
            continue  # merge again with what the other writer stored
    raise versions.Conflict(f"{base}: {ATTEMPTS} attempts failed")


def read(spark: SparkSession, base: str, schema) -> DataFrame:
    """The table's current state; the folders it names stay while later states are written."""
    _number, state = versions.current(spark, base)
    paths = [state["paths"][b] for b in sorted(state.get("paths", {}))]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
