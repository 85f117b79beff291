"""Run history: rows, restore, folding, listing, external runs (H1–H9).

The history is a table, appended once per finished run; nothing is updated in
place.  Views that need "the last state of a run" fold the rows with
``max_by`` in a grouped aggregate (partial aggregation, so a run id that
appears very often is still combined map-side).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import summary

# --------------------------------------------------------------------------
# Run states, the 12 history fields in file order, the length
# of the short run id and the ISO local date-time shape the history uses.
# --------------------------------------------------------------------------
STATUSES = ("RUNNING", "COMPLETED", "FAILED")
HISTORY_COLUMNS = ["run_id", "status", "start_time", "end_time", "scan_path", "files_scanned",
                   "files_skipped", "errors", "critical", "medium", "normal", "report_path"]
_INT_FIELDS = ("files_scanned", "files_skipped", "errors")
_LONG_FIELDS = ("critical", "medium", "normal")
# ISO local date-time as written by the run history (minutes always, seconds
# and fraction only when not zero).
_ISO_LOCAL = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,9})?)?$"
_JAVA_INT = r"^[+-]?[0-9]+$"
ID_PREFIX_LEN = 8
# Answers to a refused external run; callers read them, so they are fixed too.
REJECT_BODY = "Request body is required."
REJECT_TIMES = "startTime and endTime are required."
REJECT_NO_STATUS = "status is required (COMPLETED or FAILED)."
REJECT_STATUS = "Invalid status '%s'. Expected COMPLETED or FAILED."
# --------------------------------------------------------------------------


def iso_local(ts: Column) -> Column:
    """The ISO text of a local date-time: HH:mm when seconds and fraction are 0."""
    micros = F.unix_micros(ts.cast("timestamp"))
    frac = micros % 1000000
    return (F.when(ts.isNull(), F.lit(None).cast("string"))
            .when((F.second(ts) == 0) & (frac == 0), F.date_format(ts, "yyyy-MM-dd'T'HH:mm"))
            .when(frac == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"))
            .when(frac % 1000 == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS"))
            .otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")))


def history_rows(runs: DataFrame) -> DataFrame:
    """The 12 text fields of a history row (H1); null path/report → ''."""
    return runs.select(
        F.col("run_id").cast("string").alias("run_id"), F.col("status").cast("string").alias("status"),
        iso_local(F.col("start_time")).alias("start_time"), iso_local(F.col("end_time")).alias("end_time"),
        F.coalesce(F.col("scan_path"), F.lit("")).alias("scan_path"),
        *[F.col(c).cast("string").alias(c) for c in (*_INT_FIELDS, *_LONG_FIELDS)],
        F.coalesce(F.col("report_path"), F.lit("")).alias("report_path"))


# Fields hold anything: quotes are doubled, as in standard CSV; a backslash is a letter.
_CSV = {"quote": '"', "escape": '"', "emptyValue": "", "ignoreLeadingWhiteSpace": "false",
        "ignoreTrailingWhiteSpace": "false"}
_LINE_SCHEMA = ", ".join(f"c{i} string" for i in range(12)) + ", _corrupt_record string"


def append_history(runs: DataFrame, path: str, fmt: str = "csv") -> None:
    """Append finished runs to the history table (H1): headerless CSV or Parquet."""
    rows = history_rows(runs)
    writer = rows.write.mode("append")
    if fmt == "csv":
        writer.options(header="false", lineSep="\r\n", **_CSV).csv(path)
    else:
        writer.format(fmt).save(path)


def history_lines(runs: DataFrame) -> DataFrame:
    """History rows as CSV text lines (column ``value``)."""
    rows = history_rows(runs)
    return rows.select(F.to_csv(F.struct(*rows.columns), _CSV).alias("value"))


def restore_history(lines: DataFrame, col: str = "value") -> DataFrame:
    """Parse history lines strictly (H2).

    Rows with fewer than 12 fields are skipped, extra fields ignored, and any
    field that does not parse skips the whole row.  Blank path/report → null.
    Adds ``seq`` = position-free ingestion key (the line's own start time).
    """
    parsed = lines.select(F.from_csv(F.col(col), _LINE_SCHEMA, {
        **_CSV, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r")).select("r.*")
    return _checked(parsed)


def _checked(parsed: DataFrame) -> DataFrame:
    """Typed rows of those parsed records that hold twelve valid fields."""
    enough = F.col("_corrupt_record").isNull() | F.col("c11").isNotNull()
    c = [F.col(f"c{i}") for i in range(12)]
    ok = (enough & c[1].isin(*STATUSES)
          & c[2].rlike(_ISO_LOCAL) & c[3].rlike(_ISO_LOCAL)
          & F.try_to_timestamp(c[2]).isNotNull() & F.try_to_timestamp(c[3]).isNotNull())
    for i in range(5, 11):
        ok = ok & c[i].rlike(_JAVA_INT)
    typed = parsed.select(
        F.coalesce(c[0], F.lit("")).alias("run_id"), c[1].alias("status"),  # an empty id is still an id
        c[2].cast("timestamp_ntz").alias("start_time"), c[3].cast("timestamp_ntz").alias("end_time"),
        F.when(F.trim(F.coalesce(c[4], F.lit(""))) == "", F.lit(None)).otherwise(c[4]).alias("scan_path"),
        *[c[5 + k].try_cast("int").alias(n) for k, n in enumerate(_INT_FIELDS)],
        *[c[8 + k].try_cast("long").alias(n) for k, n in enumerate(_LONG_FIELDS)],
        F.when(F.trim(F.coalesce(c[11], F.lit(""))) == "", F.lit(None)).otherwise(c[11]).alias("report_path"),
        ok.alias("__ok"), *[(c[i].isNull() | F.col(n).isNotNull()).alias(f"__ok{i}")
                           for i, n in zip(range(5, 11), (*_INT_FIELDS, *_LONG_FIELDS))])
    good = F.col("__ok")
    for i in range(5, 11):
        good = good & F.col(f"__ok{i}")
    return typed.filter(good).select(*HISTORY_COLUMNS)


def read_history(spark, path: str) -> DataFrame:
    """Restore a history from its CSV files; a quoted value may span lines."""
    return _checked(spark.read.schema(_LINE_SCHEMA).options(
        header="false", multiLine="true", mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record", **_CSV).csv(path))


def latest_per_run(runs: DataFrame, seq: str = "seq") -> DataFrame:
    """One row per run id, the last written state wins (H3)."""
    cols = [c for c in runs.columns if c != "run_id"]
    folded = runs.groupBy("run_id").agg(F.max_by(F.struct(*cols), F.col(seq)).alias("r"))
    return folded.select("run_id", "r.*")


def newest_first(runs: DataFrame) -> DataFrame:
    """Run list, last started first (H3)."""
    return runs.orderBy(F.col("start_time").desc_nulls_last(), F.col("run_id").desc())


def current_run(runs: DataFrame, seq: str = "seq") -> DataFrame:
    """The latest started run that is still RUNNING (0 or 1 row), and whether
    any run is running (H4)."""
    running = runs.filter(F.col("status") == "RUNNING")
    cols = [c for c in runs.columns]
    return running.agg(F.max_by(F.struct(*cols), F.col(seq)).alias("r"),
                       (F.count(F.lit(1)) > 0).alias("any_running")).filter(
        F.col("r").isNotNull()).select("r.*", "any_running")


def running(runs: DataFrame, seq: str = "seq") -> DataFrame:
    """Always one row: whether any run is running, and the id of the latest started of those (H4)."""
    is_running = F.col("status") == "RUNNING"
    return runs.agg((F.count_if(is_running) > 0).alias("any_running"),
                    F.max_by(F.when(is_running, F.col("run_id")), F.when(is_running, F.col(seq))).alias("run_id"))


def latest_run(runs: DataFrame) -> DataFrame:
    """The newest run (H5)."""
    return newest_first(runs).limit(1)


def run_by_id(runs: DataFrame, run_id: str) -> DataFrame:
    return runs.filter(F.col("run_id") == run_id)


def latest_completed(runs: DataFrame) -> DataFrame:
    """First COMPLETED run in the newest-first list (H6)."""
    return newest_first(runs.filter(F.col("status") == "COMPLETED")).limit(1)


def fold_events(events: DataFrame) -> DataFrame:
    """Fold run events into run states (H7).

    ``events``: run_id, seq, event ('started' | 'finished' | 'failed'),
    at (TIMESTAMP_NTZ), scan_path, report_path.  A run starts RUNNING and
    becomes COMPLETED on 'finished' (end, report path) or FAILED on 'failed'.
    """
    started = F.col("event") == "started"
    ended = F.col("event").isin("finished", "failed")
    return events.groupBy("run_id").agg(
        F.min(F.when(started, F.col("at"))).alias("start_time"),
        F.max_by(F.when(ended, F.col("at")), F.when(ended, F.col("seq"))).alias("end_time"),
        F.max_by(F.col("scan_path"), F.when(started, F.col("seq"))).alias("scan_path"),
        F.max_by(F.when(F.col("event") == "finished", "COMPLETED").when(F.col("event") == "failed", "FAILED")
                 .otherwise("RUNNING"), F.col("seq")).alias("status"),
        F.max_by(F.when(F.col("event") == "finished", F.col("report_path")),
                 F.when(ended, F.col("seq"))).alias("report_path"))


EXTERNAL_FINDING = T.StructType([
    T.StructField("fileName", T.StringType()), T.StructField("filePath", T.StringType()),
    T.StructField("dataType", T.StringType()), T.StructField("riskLevel", T.StringType()),
    T.StructField("maskedValue", T.StringType()), T.StructField("scanTimestamp", T.StringType()),
    T.StructField("fileCreationTime", T.StringType()), T.StructField("fileModifiedTime", T.StringType()),
])
EXTERNAL_RUN = T.StructType([
    T.StructField("runId", T.StringType()), T.StructField("startTime", T.StringType()),
    T.StructField("endTime", T.StringType()), T.StructField("scanPath", T.StringType()),
    T.StructField("filesScanned", T.IntegerType()), T.StructField("filesSkipped", T.IntegerType()),
    T.StructField("errorsEncountered", T.IntegerType()),
    T.StructField("findings", T.ArrayType(EXTERNAL_FINDING)), T.StructField("status", T.StringType()),
])


def parse_external(payloads: DataFrame, col: str = "payload") -> DataFrame:
    """JSON run payloads → checked runs (H8).

    Adds ``reject_reason`` (null when accepted) and the effective fields:
    status upper-cased and checked (a run state; RUNNING is stored as
    COMPLETED, a rejected payload has none), blank id → an id made from the
    payload itself, so every reading agrees, risk counts from the supplied
    findings' levels.
    """
    r = payloads.select("*", F.from_json(F.col(col), EXTERNAL_RUN).alias("__r"))
    status = F.upper(F.col("__r.status"))  # no trim: ' completed' is invalid
    start = F.try_to_timestamp(F.col("__r.startTime"))
    end = F.try_to_timestamp(F.col("__r.endTime"))
    reason = (F.when(F.col("__r").isNull(), REJECT_BODY)
              .when(start.isNull() | end.isNull(), REJECT_TIMES)
              .when(F.coalesce(F.trim(F.col("__r.status")), F.lit("")) == "", REJECT_NO_STATUS)
              .when(~status.isin(*STATUSES), F.format_string(REJECT_STATUS, F.col("__r.status"))))
    fnd = F.coalesce(F.col("__r.findings"), F.array().cast(T.ArrayType(EXTERNAL_FINDING)))

    def n_level(level):
        return F.size(F.filter(fnd, lambda f: f["riskLevel"] == level)).cast("long")

    blank_id = F.coalesce(F.trim(F.col("__r.runId")), F.lit("")) == ""
    return r.select(
        *[c for c in payloads.columns if c != col],
        F.when(blank_id, F.regexp_replace(F.md5(F.col(col).cast("binary")), _UUID_CUTS, "$1-$2-$3-$4-$5"))
        .otherwise(F.col("__r.runId")).alias("run_id"),
        F.when(reason.isNull(), F.when(status == "FAILED", "FAILED").otherwise("COMPLETED")).alias("status"),
        start.cast("timestamp_ntz").alias("start_time"), end.cast("timestamp_ntz").alias("end_time"),
        F.col("__r.scanPath").alias("scan_path"),
        F.coalesce(F.col("__r.filesScanned"), F.lit(0)).alias("files_scanned"),
        F.coalesce(F.col("__r.filesSkipped"), F.lit(0)).alias("files_skipped"),
        F.coalesce(F.col("__r.errorsEncountered"), F.lit(0)).alias("errors"),
        n_level("CRITICAL").alias("critical"), n_level("MEDIUM").alias("medium"),
        n_level("NORMAL").alias("normal"),
        F.lit(None).cast("string").alias("report_path"),
        F.col("__r.findings").alias("findings"), reason.alias("reject_reason"))


_UUID_CUTS = "^(.{8})(.{4})(.{4})(.{4})(.{12})$"


def store_external(payloads: DataFrame, base: str, history_path: str | None = None, col: str = "payload") -> DataFrame:
    """Record external runs (H8): the parsed payloads are stored once under
    ``base``/external, and accepted runs appended to the history.  Returns the
    stored table; ``external_findings`` of it are the runs' findings."""
    spark, place = payloads.sparkSession, f"{base.rstrip('/')}/external"
    parsed = parse_external(payloads, col)
    batch = f"{place}/batch={uuid.uuid4().hex}"
    parsed.write.parquet(batch)
    stored = spark.read.schema(parsed.schema).parquet(batch)
    if history_path:
        append_history(stored.filter(F.col("reject_reason").isNull()), history_path)
    return stored


def external_findings(parsed: DataFrame) -> DataFrame:
    """Accepted runs' findings, one row each (nulls list → no rows)."""
    ok = parsed.filter(F.col("reject_reason").isNull())
    return ok.select("run_id", F.inline_outer(F.col("findings"))).filter(F.col("dataType").isNotNull())


def history_view(runs: DataFrame) -> DataFrame:
    """Table row of the history view (H9): short id, path or '-', total,
    duration text when both times exist, else '–'."""
    both = F.col("start_time").isNotNull() & F.col("end_time").isNotNull()
    return runs.select(
        F.substring("run_id", 1, ID_PREFIX_LEN).alias("short_id"), "status",
        F.coalesce(F.col("scan_path"), F.lit("-")).alias("location"),
        (F.col("critical") + F.col("medium") + F.col("normal")).alias("total_findings"),
        F.when(both, summary.duration_text(summary.duration_ms(F.col("start_time"), F.col("end_time"))))
        .otherwise(F.lit("–")).alias("duration"))
