"""Streaming queries: ``documents`` read as a file stream, results read back
from the sinks (so the driver only ever holds the query handle)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import browse
from ..session import shared_dir
from ..streaming import stream as S
from . import duck
from .registry import register
from .tables import _path, read_table, with_ctes

KEYS = ["source", "doc_id"]
COLS = ["source", "doc_id", "data_type", "risk_level", "match_idx", "masked_value"]


def _fresh(spark: SparkSession, name: str) -> tuple[str, str]:
    base = shared_dir(spark, "streams", f"{name}-{uuid.uuid4().hex[:12]}")
    return base + "/out", base + "/checkpoint"


def _doc_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a table is a file or a folder of files; the stream reads either
    path = _path(sf_dir, "documents")
    schema = read_table(spark, sf_dir, "documents").schema
    fs, place = S._hadoop(spark, path)
    if fs.getFileStatus(place).isDirectory():
        return S.read_texts(spark, path, schema)
    return S.read_texts(spark, sf_dir.rstrip("/"), schema, glob="documents.parquet")


_DOC_FINDINGS = duck.findings(rel="documents", keys=("source", "doc_id"))


@register("stream_findings", f"select {', '.join(COLS)} from ({_DOC_FINDINGS}) f")
def stream_findings(spark, sf_dir):
    out, cp = _fresh(spark, "findings")
    found = S.findings_stream(_doc_stream(spark, sf_dir), "text", KEYS)
    S.start_findings_sink(found, out, cp).awaitTermination()
    return spark.read.parquet(out).select(*COLS)


@register("stream_risk_counts", (
    "select source, count(*) filter (where risk_level = 'CRITICAL') as critical, "
    "count(*) filter (where risk_level = 'MEDIUM') as medium, "
    "count(*) filter (where risk_level = 'NORMAL') as normal, count(*) as total "
    f"from ({_DOC_FINDINGS}) f group by source"))
def stream_risk_counts(spark, sf_dir):
    out, cp = _fresh(spark, "counters")
    found = S.findings_stream(_doc_stream(spark, sf_dir), "text", KEYS)
    S.start_counter_sink(S.live_counters(found, "source"), out, cp).awaitTermination()
    return S.read_counters(spark, out)


@register("stream_recent", (
    f"select {', '.join(COLS)} from ({_DOC_FINDINGS}) f "
    f"order by doc_id desc, {duck.ordinal()} desc, match_idx desc limit {browse.RECENT_WINDOW}"))
def stream_recent(spark, sf_dir):
    out, cp = _fresh(spark, "recent")
    found = S.findings_stream(_doc_stream(spark, sf_dir), "text", KEYS)
    S.start_recent_sink(found, out, cp).awaitTermination()
    table = spark.read.parquet(out)
    seq = [F.col("epoch"), F.col("doc_id"), browse.type_ordinal(F.col("data_type")), F.col("match_idx")]
    return browse.recent(table, seq=seq).select(*COLS)


@register("stream_files", with_ctes(
    "select scan_path || '/' || file_name as rel_path, data_type, risk_level, match_idx, masked_value "
    "from (" + duck.findings(rel="(select * from doc_files where status = 'SCANNED') s",
                             keys=("scan_path", "file_name")) + ") f", "doc_files"))
def stream_files(spark, sf_dir):
    """T1 over files: new files of every supported extension are scanned as they land."""
    from ..sources.extract import extract_content
    from .sources_q import materialized_root
    out, cp = _fresh(spark, "files")
    files = extract_content(S.read_files(spark, materialized_root(spark, sf_dir)))
    found = S.findings_stream(files.filter(F.col("status") == "SCANNED"), "text", ["rel_path"])
    S.start_findings_sink(found, out, cp).awaitTermination()
    return spark.read.parquet(out).select("rel_path", "data_type", "risk_level", "match_idx", "masked_value")


@register("stream_file_status", with_ctes(
    "select scan_path as folder, cast(count(*) filter (where status = 'SCANNED') as integer) as files_scanned, "
    "cast(count(*) filter (where status = 'SKIPPED') as integer) as files_skipped, "
    "cast(count(*) filter (where status = 'ERROR') as integer) as errors from doc_files group by scan_path",
    "doc_files"))
def stream_file_status(spark, sf_dir):
    """T1 + T2 over files with their bytes: every landing file is extracted by
    extension (txt strict, csv parsed, unknown skipped), scanned, and counted
    per folder in a stateful aggregation."""
    from ..operators.detect import findings_per_row
    from ..sources.extract import extract_content
    from .sources_q import materialized_root
    out, cp = _fresh(spark, "file-status")
    files = extract_content(S.read_files(spark, materialized_root(spark, sf_dir)))
    files = files.withColumn("folder", F.substring_index("rel_path", "/", 1))
    rows = findings_per_row(files, "text", only_if=F.col("status") == "SCANNED")
    S.start_counter_sink(S.live_file_counters(rows, "folder"), out, cp).awaitTermination()
    return S.read_counters(spark, out).select("folder", "files_scanned", "files_skipped", "errors")
