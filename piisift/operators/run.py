"""A whole scan run over folders, as one composed Spark plan (entry A).

    run = run_scan(spark, ["/mnt/share/docs"], types=["CARD_NUMBER"])
    run.findings      # file_name, file_path, data_type, risk_level, masked_value, scan_ts, ...
    run.files         # every listed file with status SCANNED / SKIPPED / ERROR
    run.summary       # the one 12-column run row (A6)

The request is checked at once; folders are listed when a view or ``write``
first needs them.  ``write`` records the start of the run, materialises one
per-file table (status and findings array), then derives findings, report,
summary and history row from it, so every file is read and scanned a single
time.  Start and end are rows of an event table: ``run_states`` folds them,
and a run that has not ended (or whose driver died) shows as RUNNING.
"""

from __future__ import annotations

import datetime as dt
import functools
import uuid
import warnings
import zoneinfo
from dataclasses import dataclass
from typing import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import Detector, java_compile_check, resolve_types
from ..sources.extract import extract_text
from ..sources.files import balance, check_roots, list_files
from ..sources.paths import ScanConfig, ScanOptions
from . import history, report, summary
from .detect import FINDING_TYPE, findings_per_row

FINDING_COLUMNS = ["run_id", "file_name", "file_path", "data_type", "risk_level", "match_idx",
                   "masked_value", "scan_ts", "file_created", "file_modified"]


@dataclass
class ScanRun:
    run_id: str
    scan_path: str
    start_time: dt.datetime
    spark: SparkSession
    plan: Callable[[], DataFrame]    # lists the folders, plans extraction and detection

    @functools.cached_property
    def per_file(self) -> DataFrame:
        """One row per listed file: status, error, findings array."""
        return self.plan()

    @property
    def files(self) -> DataFrame:
        return self.per_file.drop("findings")

    @property
    def findings(self) -> DataFrame:
        return _explode(self.per_file, self.run_id, self.start_time)

    def summary(self, per_file: DataFrame | None = None, end_time: dt.datetime | None = None,
                status: str = "COMPLETED", report_path: str | None = None) -> DataFrame:
        """The run row: file outcomes and findings by risk (zeros when none)."""
        pf = self.per_file if per_file is None else per_file
        counts = pf.select("status", *summary.row_risk_counts(F.col("findings"))).agg(
            F.count_if(F.col("status") == "SCANNED").cast("int").alias("files_scanned"),
            F.count_if(F.col("status") == "SKIPPED").cast("int").alias("files_skipped"),
            F.count_if(F.col("status") == "ERROR").cast("int").alias("errors"),
            *[F.coalesce(c, F.lit(0 if n != "has_card" else False)).alias(n)
              for c, n in zip(summary.group_risk_counts(), ("critical", "medium", "normal", "total", "has_card"))])
        # the run's own fields are constants of the plan
        return counts.select(
            F.lit(self.run_id).alias("run_id"), F.lit(status).alias("status"),
            F.lit(self.start_time).cast("timestamp_ntz").alias("start_time"),
            F.lit(end_time).cast("timestamp_ntz").alias("end_time"),
            F.lit(self.scan_path or None).cast("string").alias("scan_path"), "*",
            F.lit(report_path).cast("string").alias("report_path")).select(*history.HISTORY_COLUMNS)

    def write(self, out_dir: str, report_format: str | None = "csv",
              history_path: str | None = None) -> DataFrame:
        """One pass over the files: the per-file table (status + findings) is
        written once under ``out_dir``; findings, report, summary and history
        row are derived from it.  Returns the summary row."""
        spark = self.spark
        base = out_dir.rstrip("/")
        table = f"{base}/files/run_id={self.run_id}"
        events = history_path.rstrip("/") + "-events" if history_path else f"{base}/events"
        stored = None
        self._event(events, "started", 0, self.start_time)
        try:
            self.per_file.write.mode("overwrite").parquet(table)
            stored = spark.read.parquet(table)
            found = _explode(stored, self.run_id, self.start_time)
            rep = report.write_report(found, report.report_path(f"{base}/reports", report_format or "csv"),
                                      report_format)
        except Exception:
            end = session_now(spark)
            if history_path:  # a failed run is recorded too, with the counts it reached
                reached = _no_files(spark) if stored is None else stored
                history.append_history(self.summary(reached, end, "FAILED", None), history_path)
            self._event(events, "failed", 1, end)
            raise
        end = session_now(spark)
        row = self.summary(stored, end, "COMPLETED", rep)
        if history_path:
            history.append_history(row, history_path)
        self._event(events, "finished", 1, end, rep)
        return row

    def _event(self, path: str, event: str, seq: int, at: dt.datetime, report_path: str | None = None) -> None:
        row = [(self.run_id, seq, event, at, self.scan_path or None, report_path)]
        try:
            self.spark.createDataFrame(row, EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(path)
        except Exception:  # noqa: BLE001 - an unwritable event table must not hide the run's own outcome
            if event == "started":
                warnings.warn(f"run events cannot be written to {path}", stacklevel=3)


EVENT_SCHEMA = ("run_id string, seq long, event string, at timestamp_ntz, scan_path string, report_path string")


def run_states(spark: SparkSession, events_path: str) -> DataFrame:
    """The state of every recorded run: RUNNING until its end is recorded (H4, H7)."""
    return history.fold_events(spark.read.schema(EVENT_SCHEMA).parquet(events_path))


def session_now(spark: SparkSession) -> dt.datetime:
    """The clock of the session's time zone, in which file times are shown too."""
    zone = spark.conf.get("spark.sql.session.timeZone", "UTC")
    try:
        now = dt.datetime.now(zoneinfo.ZoneInfo(zone))
    except (zoneinfo.ZoneInfoNotFoundError, ValueError):  # an offset such as +02:00: let Spark tell
        now = spark.sql("select localtimestamp()").first()[0]
    return now.replace(tzinfo=None, microsecond=0)


def _no_files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], T.StructType([T.StructField("status", T.StringType()),
                                                   T.StructField("findings", FINDING_TYPE)]))


def _explode(per_file: DataFrame, run_id: str, start: dt.datetime) -> DataFrame:
    return per_file.select(
        F.lit(run_id).alias("run_id"), "file_name", F.col("path").alias("file_path"),
        F.inline(F.col("findings")), F.lit(start).cast("timestamp_ntz").alias("scan_ts"),
        F.col("created").alias("file_created"), F.col("modified").alias("file_modified")).select(*FINDING_COLUMNS)


def run_scan(spark: SparkSession, roots: Sequence[str] | None = None, types: Sequence[str] | None = None,
             custom_patterns: Mapping[str, str] | None = None, options: ScanOptions = ScanOptions(),
             config: ScanConfig = ScanConfig(), detectors: Sequence[Detector] | None = None,
             extractors=None, run_id: str | None = None, on_missing: str = "skip") -> ScanRun:
    """Plan one scan run over ``roots`` (None: the configured roots).  Request
    errors (unknown types, patterns that Java refuses, missing roots with
    ``on_missing='error'``) are raised at once."""
    roots = list(config.roots if roots is None else roots)
    resolve_types(types, custom_patterns, detectors, compile_check=java_compile_check(spark))
    check_roots(roots, on_missing)
    rid = run_id or str(uuid.uuid4())

    def plan() -> DataFrame:
        listing = balance(list_files(spark, roots, options, config, on_missing))
        files = extract_text(listing, extractors, config.supported_extensions)
        return findings_per_row(files, "text", types, custom_patterns, detectors,
                                only_if=F.col("status") == "SCANNED").drop("text")
    return ScanRun(rid, ", ".join(roots), session_now(spark), spark, plan)
