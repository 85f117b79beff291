"""Structured Streaming forms of the scan.

The scan itself is stateless (Project → Generate → Project), so the very same
``scan`` runs on a streaming DataFrame.  Scheduled scans become incremental
``availableNow`` runs over a checkpoint: each run reads only the files that
arrived since the last one, and a lost executor replays from the checkpoint.
Only the live counters hold state — one row per group.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from typing import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import summary
from ..operators.detect import scan
from ..session import shared_dir


def read_texts(spark: SparkSession, path: str, schema, fmt: str = "parquet",
               max_files_per_trigger: int | None = None, glob: str | None = None) -> DataFrame:
    """A stream of text rows from files landing in the folder ``path``
    (optionally only names matching ``glob``)."""
    reader = spark.readStream.format(fmt).schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def findings_stream(stream: DataFrame, text_col: str, key_cols: Sequence[str], **scan_kw) -> DataFrame:
    """The batch scan on a stream (stateless, append-only)."""
    return scan(stream, text_col, key_cols, **scan_kw)


def start_findings_sink(findings: DataFrame, out_path: str, checkpoint: str, fmt: str = "parquet",
                        available_now: bool = True, processing_time: str | None = None) -> StreamingQuery:
    """Append findings to a table; ``available_now`` processes what is there and stops."""
    w = findings.writeStream.format(fmt).outputMode("append").option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time or "1 minute")
    return w.start(out_path)


def live_counters(findings: DataFrame, by: Sequence[str] | str) -> DataFrame:
    """Running counts by risk level per group (stateful aggregation)."""
    return summary.risk_counts(findings, by)


def _hadoop(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _versions(spark: SparkSession, out_path: str) -> list[int]:
    """Whole versions of a counter table: those whose write was committed."""
    fs, place = _hadoop(spark, out_path)
    if not fs.exists(place):
        return []
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    names = [f.getPath().getName() for f in fs.listStatus(place)]
    return sorted(int(n.split("=")[1]) for n in names
                  if n.startswith("version=") and fs.exists(jvm_path(f"{out_path}/{n}/_SUCCESS")))


def read_counters(spark: SparkSession, out_path: str) -> DataFrame:
    """The newest whole version of a counter table."""
    versions = _versions(spark, out_path)
    if not versions:
        raise FileNotFoundError(f"no counters yet under {out_path}")
    return spark.read.parquet(f"{out_path}/version={versions[-1]}")


def start_counter_sink(counters: DataFrame, out_path: str, checkpoint: str,
                       available_now: bool = True, state_partitions: int | None = None,
                       keep: int = 3) -> StreamingQuery:
    """Each micro-batch writes the full current state (complete mode; one row
    per group) as a new version; readers take the newest whole one with
    ``read_counters``, so they never meet a table that is being rewritten.  A
    replayed batch writes its own version again.  ``keep`` versions stay.

    ``state_partitions`` (default: the cluster's cores) sizes the state store;
    it is fixed in the checkpoint at the first start.  The stream runs on a
    copy of the session, so the caller's setting is left as it was.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_path}/version={epoch}")
        spark = batch.sparkSession
        for old in _versions(spark, out_path)[:-keep]:
            fs, place = _hadoop(spark, f"{out_path}/version={old}")
            fs.delete(place, True)

    w = (counters.writeStream.outputMode("complete").option("checkpointLocation", checkpoint)
         .foreachBatch(write))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="2 seconds")
    return _start_with_partitions(counters.sparkSession, w, state_partitions)


def _start_with_partitions(spark: SparkSession, writer, n: int | None) -> StreamingQuery:
    key = "spark.sql.shuffle.partitions"
    try:
        n = n or spark.sparkContext.defaultParallelism
    except Exception:  # noqa: BLE001 - no SparkContext access: keep the session's setting
        return writer.start()
    old = spark.conf.get(key)
    spark.conf.set(key, str(n))
    try:
        return writer.start()
    finally:
        spark.conf.set(key, old)


def start_recent_sink(findings: DataFrame, table_path: str, checkpoint: str,
                      available_now: bool = True) -> StreamingQuery:
    """Each micro-batch is a folder ``epoch=<n>`` of the findings table, so
    a batch that is run again replaces itself; readers take the recent slice
    with ``browse.recent`` over the table (``epoch`` is its partition column)."""
    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table_path}/epoch={epoch}")

    w = findings.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="2 seconds")
    return w.start()


def read_text_files(spark: SparkSession, root: str, glob: str | None = "*.[tT][xX][tT]",
                    max_files_per_trigger: int | None = None) -> DataFrame:
    """A stream of whole text files landing anywhere under ``root``: one row
    per file (path, text), each new file read once."""
    reader = (spark.readStream.format("text").option("wholetext", True)
              .option("recursiveFileLookup", True))
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(root).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


BINARY_FILE_SCHEMA = ("path string, modificationTime timestamp, length long, content binary")
#: Names of a part of a ledger, files of a task that reads them, and bytes of a batch of contents.
FILES_PER_PART, FILES_PER_TASK, BATCH_BYTES = 1000, 2000, 32 << 20


def _mounted(path: str) -> str | None:
    """The path on a mounted file system; None on any other."""
    local = re.sub("^file:(//)?", "", path)
    return None if "://" in local else os.path.abspath(local)


def land_files(spark: SparkSession, root: str, files_per_part: int = FILES_PER_PART) -> tuple[str, int, int] | None:
    """Record the files that are new under ``root`` in its ledger, a table of names in the shared folder.

    Executors list the tree and join it with the ledger, so neither the driver nor a checkpoint ever holds a name.  New
    names become visible together, by one rename; of two listings at a time the later one looks again.  Returns the
    ledger's folder, and the number and bytes of the files to expect in it; None where the ledger cannot be kept.
    """
    from ..sources.files import balance, list_files
    from ..sources.paths import ScanConfig, ScanOptions
    place, key = _mounted(root), f"{root.rstrip('/')}|{files_per_part}"
    ledger = _mounted(shared_dir(spark, "landed", hashlib.sha256(key.encode()).hexdigest()[:32]))
    if place is None or ledger is None:
        return None
    os.makedirs(ledger, exist_ok=True)
    listed = list_files(spark, [place], ScanOptions(follow_symbolic_links=True), ScanConfig(excluded_folder_names=()))
    # names that Spark's file sources leave out as well
    listed = listed.filter(~F.col("rel_path").rlike(r"(^|/)(\.|_(?!metadata|common_metadata|[^/]*=))|\._COPYING_$"))
    listed = listed.select("path", "size_bytes")
    while True:
        number = len(os.listdir(ledger))
        known = spark.read.schema("path string, size_bytes long").option("recursiveFileLookup", True).parquet(ledger)
        new = listed.join(known, "path", "left_anti") if number else listed
        new = new.checkpoint() if number else new
        files, size = new.agg(F.count(F.lit(1)), F.sum("size_bytes")).first()
        if not files:
            files, size = known.agg(F.count(F.lit(1)), F.sum("size_bytes")).first()
            return ledger, files, size or 0
        part = shared_dir(spark, "landing", uuid.uuid4().hex)
        balance(new, files_per_part).write.option("maxRecordsPerFile", files_per_part).parquet(part)
        try:
            os.rename(_mounted(part), f"{ledger}/part-{number}")
            return ledger, files, size or 0
        except OSError:
            if not os.path.exists(f"{ledger}/part-{number}"):
                raise


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: names -> names, times and bytes; a file that is gone by now gives no row."""
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        path, at, data = zip(*rows)
        return pa.record_batch([pa.array(path, pa.string()), pa.array(at, pa.int64()), pa.array(data, pa.binary())],
                               ["path", "at", "content"])

    for b in batches:
        rows, size = [], 0
        for path in b.column(0).to_pylist():
            try:
                with open(path, "rb") as fh:
                    rows.append((path, os.fstat(fh.fileno()).st_mtime_ns // 1_000_000, fh.read()))
            except FileNotFoundError:
                continue
            size += len(rows[-1][2])
            if size >= BATCH_BYTES:
                yield batch(rows)
                rows, size = [], 0
        if rows:
            yield batch(rows)


def _name_matches(spark: SparkSession, name, glob: str):
    """``glob`` as ``pathGlobFilter`` reads it."""
    pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.GlobPattern(glob).compiled().pattern()
    return name.rlike(rf"\A(?s:{pattern})\z")


def read_files(spark: SparkSession, root: str, glob: str | None = None,
               max_files_per_trigger: int | None = None) -> DataFrame:
    """A stream of files landing anywhere under ``root`` with their bytes: path, rel_path, file_name, extension,
    size_bytes, modified, content.  Each new file is read once per checkpoint.

    On a mounted file system the stream follows the ledger of ``land_files``: this call records what is new, and a
    stream that runs on reads what later calls of ``land_files`` record.  Elsewhere it is Spark's ``binaryFile``
    source, whose driver lists the tree and keeps every name.
    """
    from ..sources.paths import extension_of
    per_part = min(FILES_PER_PART, max_files_per_trigger or FILES_PER_PART)
    landed = land_files(spark, root, per_part)
    if landed is None:
        df = _read_binary(spark, root, glob, max_files_per_trigger)
    else:
        ledger, files, size = landed
        # a part is a file of the stream; parts never grow old
        reader = (spark.readStream.schema("path string").option("recursiveFileLookup", True).option("maxFileAge", "36500d"))
        if max_files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", max(1, max_files_per_trigger // per_part))
        names = reader.parquet(ledger)
        if glob:
            names = names.filter(_name_matches(spark, F.substring_index("path", "/", -1), glob))
        tasks = max(spark.sparkContext.defaultParallelism, -(-files // FILES_PER_TASK), -(-size // (128 << 20)))
        read = names.repartition(min(tasks, max(files, 1))).mapInArrow(_contents, "path string, at long, content binary")
        df = read.select(F.concat(F.lit("file:"), "path").alias("path"), F.timestamp_millis("at").alias("modificationTime"),
                         F.octet_length("content").cast("long").alias("length"), "content")
    name = F.substring_index(F.col("path"), "/", -1)
    base = root.rstrip("/") if landed is None else _mounted(root)
    rel = F.regexp_replace(F.regexp_replace(F.col("path"), "^file:", ""), "^" + _re_quote(base) + "/", "")
    return df.select("path", rel.alias("rel_path"), name.alias("file_name"), extension_of(name).alias("extension"),
                     F.col("length").alias("size_bytes"), F.col("modificationTime").cast("timestamp_ntz")
                     .alias("modified"), "content")


def _read_binary(spark: SparkSession, root: str, glob: str | None, max_files_per_trigger: int | None) -> DataFrame:
    reader = spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA).option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(root)


def _re_quote(s: str) -> str:
    return re.escape(s)


def live_file_counters(files_with_findings: DataFrame, by: Sequence[str] | str) -> DataFrame:
    """T2 over a file stream: files scanned / skipped / errors and findings by
    risk per group, from rows that carry ``status`` and a ``findings`` array."""
    from ..operators import summary as SM
    keys = [by] if isinstance(by, str) else list(by)
    s = F.col("status")
    per_file = files_with_findings.select(*keys, "status", *SM.row_risk_counts(F.col("findings")))
    return per_file.groupBy(*keys).agg(
        F.count_if(s == "SCANNED").cast("int").alias("files_scanned"),
        F.count_if(s == "SKIPPED").cast("int").alias("files_skipped"),
        F.count_if(s == "ERROR").cast("int").alias("errors"),
        *[c for c in SM.group_risk_counts() if c is not None])
