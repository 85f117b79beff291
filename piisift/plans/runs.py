"""Queries over runs: one run per ``documents.source`` folder.

Spark side: ``doc_files`` → ``scan`` → aggregates, browsing views, history.
Oracle side: the same steps written as DuckDB SQL.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.types import CARD_NOTICE
from ..operators import browse, history, report, summary
from ..operators.detect import findings_per_row, scan
from ..session import shared_dir
from . import duck
from .registry import register
from .tables import doc_files, run_id_of, with_ctes

FILE_KEYS = ["scan_path", "doc_id", "path", "file_name", "created", "modified"]
SCAN_DELAY = "INTERVAL 1 HOUR"   # a file is scanned one hour after its last change


def run_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = doc_files(spark, sf_dir).filter(F.col("status") == "SCANNED")
    found = scan(files, "text", FILE_KEYS, scan_ts=F.col("modified") + F.expr(SCAN_DELAY))
    return found.select(
        run_id_of(F.col("scan_path")).alias("run_id"), "scan_path", "doc_id", "file_name",
        F.col("path").alias("file_path"), "data_type", "risk_level", "match_idx", "masked_value",
        "scan_ts", F.col("created").alias("file_created"), F.col("modified").alias("file_modified"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, status, start_time, end_time, scan_path, report_path (one per folder)."""
    files = doc_files(spark, sf_dir, balance=False)
    rid = run_id_of(F.col("scan_path"))
    return files.groupBy("scan_path").agg(
        (F.min("modified") + F.expr(SCAN_DELAY)).alias("start_time"),
        (F.max("modified") + F.expr(SCAN_DELAY) + F.expr("INTERVAL 1 SECOND")).alias("end_time"),
    ).select(rid.alias("run_id"), F.lit("COMPLETED").alias("status"), "start_time", "end_time",
             "scan_path", F.concat(F.lit("reports/scan-report-"), rid, F.lit(".csv")).alias("report_path"))


def run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass over the files: times, file outcomes, findings by risk and the card flag."""
    files = doc_files(spark, sf_dir)
    per_file = findings_per_row(files, "text", only_if=F.col("status") == "SCANNED")
    rid = run_id_of(F.col("scan_path"))
    agg = summary.run_stats(
        per_file.select("scan_path", "status", "modified", "findings"), "scan_path",
        (F.min("modified") + F.expr(SCAN_DELAY)).alias("start_time"),
        (F.max("modified") + F.expr(SCAN_DELAY) + F.expr("INTERVAL 1 SECOND")).alias("end_time"))
    return agg.select(rid.alias("run_id"), F.lit("COMPLETED").alias("status"), "*",
                      F.concat(F.lit("reports/scan-report-"), rid, F.lit(".csv")).alias("report_path"))


def run_summary_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_stats(spark, sf_dir).select(*history.HISTORY_COLUMNS)


# ---- DuckDB forms -----------------------------------------------------------
_SCANNED = "(select * from doc_files where status = 'SCANNED') s"
RUN_FINDINGS_SQL = (
    "select 'run-' || scan_path as run_id, scan_path, doc_id, file_name, path as file_path, data_type, "
    "risk_level, match_idx, masked_value, modified + INTERVAL 1 HOUR as scan_ts, created as file_created, "
    "modified as file_modified from ("
    + duck.findings(rel=_SCANNED, keys=tuple(FILE_KEYS)) + ") f")
RUNS_SQL = ("select 'run-' || scan_path as run_id, 'COMPLETED' as status, "
            "min(modified) + INTERVAL 1 HOUR as start_time, "
            "max(modified) + INTERVAL 1 HOUR + INTERVAL 1 SECOND as end_time, scan_path, "
            "'reports/scan-report-run-' || scan_path || '.csv' as report_path from doc_files group by scan_path")
COUNTERS_SQL = ("select 'run-' || scan_path as run_id, "
                "cast(count(*) filter (where status = 'SCANNED') as integer) as files_scanned, "
                "cast(count(*) filter (where status = 'SKIPPED') as integer) as files_skipped, "
                "cast(count(*) filter (where status = 'ERROR') as integer) as errors "
                "from doc_files group by scan_path")
RISKS_SQL = ("select r.run_id, coalesce(k.critical, 0) as critical, coalesce(k.medium, 0) as medium, "
             "coalesce(k.normal, 0) as normal, coalesce(k.total, 0) as total from runs r left join ("
             "select run_id, count(*) filter (where risk_level = 'CRITICAL') as critical, "
             "count(*) filter (where risk_level = 'MEDIUM') as medium, "
             "count(*) filter (where risk_level = 'NORMAL') as normal, count(*) as total "
             "from run_findings group by run_id) k using (run_id)")
SUMMARY_SQL = ("select r.run_id, r.status, r.start_time, r.end_time, r.scan_path, "
               "coalesce(c.files_scanned, 0) as files_scanned, coalesce(c.files_skipped, 0) as files_skipped, "
               "coalesce(c.errors, 0) as errors, k.critical, k.medium, k.normal, r.report_path "
               "from runs r left join counters c using (run_id) left join risks k using (run_id)")


def run_ctes(body: str, *extra: str) -> str:
    """doc_files + the run tables, then ``body``."""
    base = with_ctes("", "doc_files").rstrip("\n")
    parts = {"run_findings": RUN_FINDINGS_SQL, "runs": RUNS_SQL, "counters": COUNTERS_SQL,
             "risks": RISKS_SQL, "run_summary": SUMMARY_SQL}
    order = ["run_findings", "runs", "counters", "risks", "run_summary"]
    wanted = set(extra)
    deps = {"risks": {"runs", "run_findings"}, "run_summary": {"runs", "counters", "risks", "run_findings"}}
    for e in list(wanted):
        wanted |= deps.get(e, set())
    for d in list(wanted):
        wanted |= deps.get(d, set())
    ctes = ",\n".join(f"{n} as ({parts[n]})" for n in order if n in wanted)
    return base + (",\n" + ctes if ctes else "") + "\n" + body


# ---- A2 / E6 / S9: file outcomes ---------------------------------------------
@register("file_status", run_ctes("select * from counters", "counters"))
def file_status(spark, sf_dir):
    files = doc_files(spark, sf_dir, balance=False).withColumn("run_id", run_id_of(F.col("scan_path")))
    return summary.file_counters(files, "run_id")


# ---- A1 / A3 ----------------------------------------------------------------------
@register("risk_counts", run_ctes("select * from risks", "risks"))
def risk_counts(spark, sf_dir):
    return run_stats(spark, sf_dir).select("run_id", "critical", "medium", "normal", "total")


# ---- A4 -----------------------------------------------------------------------------
_PCT = ", ".join(
    f"round(100.0 * {lv} / greatest(total, 1), 1) as {lv}_pct, "
    f"cast(round(100.0 * {lv} / greatest(total, 1), 1) as varchar) || '%' as {lv}_share"
    for lv in ("critical", "medium", "normal"))


@register("risk_share", run_ctes(f"select *, {_PCT} from risks", "risks"))
def risk_share(spark, sf_dir):
    counts = run_stats(spark, sf_dir).select("run_id", "critical", "medium", "normal", "total")
    return summary.risk_share(counts)


# ---- A5 ------------------------------------------------------------------------------
@register("card_notice", run_ctes(
    "select r.run_id, coalesce(c.has_card, false) as has_card, "
    f"case when coalesce(c.has_card, false) then {duck.q(CARD_NOTICE)} end as notice "
    "from runs r left join (select run_id, bool_or(data_type = 'CARD_NUMBER') as has_card "
    "from run_findings group by run_id) c using (run_id)", "runs", "run_findings"))
def card_notice(spark, sf_dir):
    return summary.card_notice(run_stats(spark, sf_dir)).select("run_id", "has_card", "notice")


# ---- A6 ------------------------------------------------------------------------------
@register("run_summary", run_ctes("select * from run_summary", "run_summary"))
def run_summary(spark, sf_dir):
    return run_summary_df(spark, sf_dir)


# ---- A7 ------------------------------------------------------------------------------
@register("run_duration", run_ctes(
    "select run_id, date_diff('millisecond', start_time, end_time) as duration_ms, "
    "printf('%02d:%02d:%02d.%03d', (ms // 1000) // 3600, ((ms // 1000) % 3600) // 60, (ms // 1000) % 60, "
    "ms % 1000) as duration_text from (select *, greatest(coalesce(date_diff('millisecond', start_time, "
    "end_time), 0), 0) as ms from runs) r", "runs"))
def run_duration(spark, sf_dir):
    r = runs(spark, sf_dir)
    ms = summary.duration_ms(F.col("start_time"), F.col("end_time"))
    return r.select("run_id", ms.alias("duration_ms"), summary.duration_text(ms).alias("duration_text"))


# ---- A8 ------------------------------------------------------------------------------
@register("extension_profile", run_ctes(
    "select extension, count(*) as files, cast(sum(size_bytes) as bigint) as total_bytes, "
    "count(*) filter (where status = 'SCANNED') as scanned, count(*) filter (where status = 'SKIPPED') as skipped "
    "from doc_files group by extension"))
def extension_profile(spark, sf_dir):
    return summary.extension_profile(doc_files(spark, sf_dir, balance=False))


# ---- Q1–Q9, K1, K3 -------------------------------------------------------------------------
_FIND_COLS = ("run_id, scan_path, doc_id, file_name, file_path, data_type, risk_level, match_idx, "
              "masked_value, scan_ts, file_created, file_modified")
_SEQ_DESC = f"scan_ts desc, file_path desc, doc_id desc, {duck.ordinal()} desc, match_idx desc"


@register("findings_recent", run_ctes(
    f"select {_FIND_COLS} from run_findings order by {_SEQ_DESC} limit {browse.RECENT_WINDOW}",
    "run_findings"))
def findings_recent(spark, sf_dir):
    return browse.recent(run_findings(spark, sf_dir))


@register("findings_filter_risk", run_ctes(
    f"select {_FIND_COLS} from run_findings where risk_level = 'NORMAL'", "run_findings"))
def findings_filter_risk(spark, sf_dir):
    return browse.filter_risk(run_findings(spark, sf_dir), "NORMAL")


@register("findings_filter_type", run_ctes(
    f"select {_FIND_COLS} from run_findings where data_type = 'BANK_ACCOUNT'", "run_findings"))
def findings_filter_type(spark, sf_dir):
    return browse.filter_type(run_findings(spark, sf_dir), "BANK_ACCOUNT")


SEARCH = "  SRC1 "


@register("findings_search", run_ctes(
    f"select {_FIND_COLS} from run_findings where contains(lower(concat_ws(' ', file_name, file_path, "
    f"masked_value)), {duck.q(SEARCH.strip().lower())})", "run_findings"))
def findings_search(spark, sf_dir):
    # stored once: sorting samples its input, which must not scan the texts again
    return browse.newest_first(browse.stored(browse.search(run_findings(spark, sf_dir), SEARCH)))


# ---- Q5: newest first, with the position of each finding
@register("findings_newest_first", run_ctes(
    f"select {_FIND_COLS}, row_number() over (order by {_SEQ_DESC}) as pos from run_findings",
    "run_findings"))
def findings_newest_first(spark, sf_dir):
    return browse.positioned(run_findings(spark, sf_dir))


@register("findings_deep_page", run_ctes(
    f"select {_FIND_COLS}, pos from (select *, "
    f"row_number() over (order by {_SEQ_DESC}) as pos from run_findings) x where pos between 21 and 30", "run_findings"))
def findings_deep_page(spark, sf_dir):
    """A page far down the list, by position (the path of pages beyond ``TOP_ROWS``)."""
    return browse.positioned(run_findings(spark, sf_dir)).filter("pos between 21 and 30")


# ---- Q1 with a window that binds
@register("findings_recent_few", run_ctes(
    f"select {_FIND_COLS} from run_findings order by {_SEQ_DESC} limit 7", "run_findings"))
def findings_recent_few(spark, sf_dir):
    return browse.recent(run_findings(spark, sf_dir), 7)


# ---- F2: the scan's own time stamp
@register("findings_scan_ts", run_ctes(
    "select doc_id, data_type, match_idx, timestamp '2024-05-06 07:08:09' as scan_ts from run_findings", "run_findings"))
def findings_scan_ts(spark, sf_dir):
    files = doc_files(spark, sf_dir).filter(F.col("status") == "SCANNED")
    return scan(files, "text", ["doc_id"], scan_ts="2024-05-06 07:08:09").select(
        "doc_id", "data_type", "match_idx", "scan_ts")


@register("findings_default_scan_ts", run_ctes(
    "select count(*) as n, cast(count(*) as bigint) as stamped, cast(least(count(*), 1) as bigint) as stamps "
    "from run_findings", "run_findings"))
def findings_default_scan_ts(spark, sf_dir):
    """Without a given time, every finding carries the one time of its query."""
    files = doc_files(spark, sf_dir).filter(F.col("status") == "SCANNED")
    return scan(files, "text", ["doc_id"]).agg(F.count("*").alias("n"), F.count("scan_ts").alias("stamped"),
                                               F.count_distinct("scan_ts").alias("stamps"))


PAGE_NO = 3


@register("findings_page", run_ctes(
    f"select {_FIND_COLS}, pos, (select pg from page_no) as page, total from (select *, "
    f"row_number() over (order by {_SEQ_DESC}) as pos, count(*) over () as total from run_findings) x "
    f"where pos > ((select pg from page_no) - 1) * {browse.PAGE_SIZE} "
    f"and pos <= (select pg from page_no) * {browse.PAGE_SIZE}", "run_findings").replace(
    "\nselect " + _FIND_COLS, ",\npage_no as (select least(" + str(PAGE_NO) + ", greatest(1, cast(ceil(count(*) / "
    + str(browse.PAGE_SIZE) + ".0) as integer))) as pg from run_findings)\nselect " + _FIND_COLS, 1))
def findings_page(spark, sf_dir):
    return browse.page(run_findings(spark, sf_dir), PAGE_NO)


def _display(c: str) -> str:
    return f"coalesce(strftime({c}, '%d %b %Y, %-I:%M %p'), '–')"


@register("findings_export", run_ctes(
    f"select file_name as \"File Name\", file_path as \"File Path\", {duck.label()} as \"PII Type\", "
    f"risk_level as \"Risk Level\", masked_value as \"Masked Value\", {_display('scan_ts')} as \"Scan Timestamp\", "
    f"{_display('file_created')} as \"File Created\", {_display('file_modified')} as \"File Modified\" "
    f"from run_findings where risk_level = 'CRITICAL' and contains(lower(concat_ws(' ', file_name, file_path, "
    f"masked_value)), 'doc-1')", "run_findings"))
def findings_export(spark, sf_dir):
    f = browse.search(browse.filter_risk(run_findings(spark, sf_dir), "CRITICAL"), "Doc-1")
    return browse.export_rows(f)


@register("path_location", run_ctes(
    "select path as file_path, file_name, case when path is null or path = '' then '-' "
    "when file_name is not null and file_name <> '' and ends_with(path, file_name) then "
    "regexp_replace(substr(path, 1, length(path) - length(file_name)), '[\\\\/]$', '') "
    "else path end as location from doc_files"))
def path_location(spark, sf_dir):
    files = doc_files(spark, sf_dir, balance=False)
    return files.select(F.col("path").alias("file_path"), "file_name",
                        browse.location(F.col("path"), F.col("file_name")).alias("location"))


def _report_ts(c: str) -> str:
    return f"coalesce(strftime({c}, '%Y-%m-%d %H:%M:%S'), '')"


@register("report_rows", run_ctes(
    "select file_name as \"File Name\", file_path as \"File Path\", data_type as \"Sensitive Data Type\", "
    "risk_level as \"Risk Level\", masked_value as \"Masked Value\", "
    f"{_report_ts('scan_ts')} as \"Scan Timestamp\", {_report_ts('file_created')} as \"File Created\", "
    f"{_report_ts('file_modified')} as \"File Modified\" from run_findings", "run_findings"))
def report_rows(spark, sf_dir):
    return browse.report_rows(run_findings(spark, sf_dir))


# ---- H1, H2, H9 -------------------------------------------------------------------------
def _iso(c: str) -> str:
    return (f"case when second({c}) = 0 and microsecond({c}) % 1000000 = 0 then strftime({c}, '%Y-%m-%dT%H:%M') "
            f"else strftime({c}, '%Y-%m-%dT%H:%M:%S') end")


HISTORY_ROWS_SQL = (
    f"select run_id, status, {_iso('start_time')} as start_time, {_iso('end_time')} as end_time, "
    "coalesce(scan_path, '') as scan_path, cast(files_scanned as varchar) as files_scanned, "
    "cast(files_skipped as varchar) as files_skipped, cast(errors as varchar) as errors, "
    "cast(critical as varchar) as critical, cast(medium as varchar) as medium, "
    "cast(normal as varchar) as normal, coalesce(report_path, '') as report_path from run_summary")


@register("history_rows", run_ctes(HISTORY_ROWS_SQL, "run_summary"))
def history_rows(spark, sf_dir):
    return history.history_rows(run_summary_df(spark, sf_dir))


def damaged_lines(rows: DataFrame) -> DataFrame:
    """Each history row as a line, plus damaged copies the restore must skip
    (11 fields, ' 5' integer, space-separated time, bare date) or accept
    (13 fields, a quoted path with quotes, commas and a backslash)."""
    c = [F.col(x) for x in history.HISTORY_COLUMNS]

    def line(*cols):
        return F.concat_ws(",", *cols)
    return rows.select(F.explode(F.array(
        line(*c),
        line(*c[:11]),
        line(*c[:5], F.lit(" 5"), *c[6:]),
        line(*c[:2], F.regexp_replace(c[2], "T", " "), *c[3:]),
        line(*c[:3], F.substring(c[3], 1, 10), *c[4:]),
        line(*c, F.lit("extra")),
        line(*c[:4], F.lit('"C:\\d ""x"", y\\"'), *c[5:]),
    )).alias("value"))


_LINES_SQL = (
    "select unnest([l, l11, lsp, ltime, ldate, l13]) as value from (select "
    "concat_ws(',', run_id, status, start_time, end_time, scan_path, files_scanned, files_skipped, errors, "
    "critical, medium, normal, report_path) as l, "
    "concat_ws(',', run_id, status, start_time, end_time, scan_path, files_scanned, files_skipped, errors, "
    "critical, medium, normal) as l11, "
    "concat_ws(',', run_id, status, start_time, end_time, scan_path, ' 5', files_skipped, errors, "
    "critical, medium, normal, report_path) as lsp, "
    "concat_ws(',', run_id, status, replace(start_time, 'T', ' '), end_time, scan_path, files_scanned, "
    "files_skipped, errors, critical, medium, normal, report_path) as ltime, "
    "concat_ws(',', run_id, status, start_time, substr(end_time, 1, 10), scan_path, files_scanned, "
    "files_skipped, errors, critical, medium, normal, report_path) as ldate, "
    "concat_ws(',', run_id, status, start_time, end_time, scan_path, files_scanned, files_skipped, errors, "
    "critical, medium, normal, report_path, 'extra') as l13 from history_rows) h")
_ISO_RE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,9})?)?$"
_INT_RE = r"^[+-]?[0-9]+$"


@register("history_restore", run_ctes(
    f"select f[1] as run_id, f[2] as status, cast(f[3] as timestamp) as start_time, "
    f"cast(f[4] as timestamp) as end_time, nullif(trim(f[5]), '') as scan_path, "
    f"cast(f[6] as integer) as files_scanned, cast(f[7] as integer) as files_skipped, "
    f"cast(f[8] as integer) as errors, cast(f[9] as bigint) as critical, cast(f[10] as bigint) as medium, "
    f"cast(f[11] as bigint) as normal, nullif(trim(f[12]), '') as report_path "
    f"from (select string_split(value, ',') as f from lines) x "
    f"where len(f) >= 12 and f[2] in ('RUNNING', 'COMPLETED', 'FAILED') "
    f"and regexp_matches(f[3], {duck.q(_ISO_RE)}) and regexp_matches(f[4], {duck.q(_ISO_RE)}) "
    + " ".join(f"and regexp_matches(f[{i}], {duck.q(_INT_RE)})" for i in range(6, 12))
    + " union all select run_id, status, start_time, end_time, 'C:\\d \"x\", y\\' as scan_path, files_scanned, "
    "files_skipped, errors, critical, medium, normal, report_path from run_summary",
    "run_summary").replace("\nselect f[1]", f",\nhistory_rows as ({HISTORY_ROWS_SQL}),\n"
                                          f"lines as ({_LINES_SQL})\nselect f[1]"))
def history_restore(spark, sf_dir):
    return history.restore_history(damaged_lines(history.history_rows(run_summary_df(spark, sf_dir))))


@register("history_view", run_ctes(
    "select substr(run_id, 1, 8) as short_id, status, coalesce(scan_path, '-') as location, "
    "critical + medium + normal as total_findings, case when start_time is not null and end_time is not null "
    "then printf('%02d:%02d:%02d.%03d', (ms // 1000) // 3600, ((ms // 1000) % 3600) // 60, (ms // 1000) % 60, "
    "ms % 1000) else '–' end as duration from (select *, greatest(coalesce(date_diff('millisecond', "
    "start_time, end_time), 0), 0) as ms from run_summary) s", "run_summary"))
def history_view(spark, sf_dir):
    return history.history_view(run_summary_df(spark, sf_dir))


# ---- H3–H7: history as of a point in time ----------------------------------------------
# Events of every run (started at start_time, finished at end_time).  The
# state "as of" the first finish has that run COMPLETED and every run not
# finished by then still RUNNING.  The cut-off is a scalar subquery.
def stored_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run table, written once: the views below read it several times."""
    return browse.stored(runs(spark, sf_dir), "runs")


def run_events(r: DataFrame) -> DataFrame:
    ev = F.explode(F.array(
        F.struct(F.lit("started").alias("event"), F.col("start_time").alias("at"),
                 (F.unix_micros(F.col("start_time").cast("timestamp")) * 2).alias("seq")),
        F.struct(F.lit("finished").alias("event"), F.col("end_time").alias("at"),
                 (F.unix_micros(F.col("end_time").cast("timestamp")) * 2 + 1).alias("seq"))))
    return r.select("run_id", "scan_path", "report_path", ev.alias("e")).select(
        "run_id", "e.seq", "e.event", "e.at", "scan_path", "report_path")


def events_as_of_first_end(r: DataFrame) -> DataFrame:
    ev = run_events(r)
    cutoff = r.agg(F.min("end_time")).scalar()  # a one-value subquery
    return ev.filter(F.col("at") <= cutoff)


def state_as_of(r: DataFrame) -> DataFrame:
    folded = history.fold_events(events_as_of_first_end(r))
    return folded.withColumn("seq", F.unix_micros(F.col("start_time").cast("timestamp")))


_HIST_CTES = (
    "run_event_rows as (select run_id, 'started' as event, start_time as ev_ts, scan_path, report_path from runs "
    "union all select run_id, 'finished' as event, end_time as ev_ts, scan_path, report_path from runs),\n"
    "ev as (select e.* from run_event_rows e where e.ev_ts <= (select min(end_time) from runs)),\n"
    "folded as (select run_id, min(ev_ts) filter (where event = 'started') as start_time, "
    "max(ev_ts) filter (where event = 'finished') as end_time, any_value(scan_path) as scan_path, "
    "case when bool_or(event = 'finished') then 'COMPLETED' else 'RUNNING' end as status, "
    "max(report_path) filter (where event = 'finished') as report_path from ev group by run_id)")


def hist_sql(body: str) -> str:
    return run_ctes(body, "runs").replace("\n" + body, ",\n" + _HIST_CTES + "\n" + body)


_FOLD_COLS = "run_id, start_time, end_time, scan_path, status, report_path"


@register("history_fold", hist_sql(f"select {_FOLD_COLS} from folded"))
def history_fold(spark, sf_dir):
    return history.fold_events(events_as_of_first_end(stored_runs(spark, sf_dir))).select(*_FOLD_COLS.split(", "))


@register("history_current", hist_sql(
    f"select {_FOLD_COLS}, true as any_running from folded where status = 'RUNNING' "
    "order by start_time desc limit 1"))
def history_current(spark, sf_dir):
    cur = history.current_run(state_as_of(stored_runs(spark, sf_dir)), seq="seq")
    return cur.select(*_FOLD_COLS.split(", "), "any_running")


@register("history_list", hist_sql(
    f"select {_FOLD_COLS} from (select {_FOLD_COLS} from runs) r order by start_time desc, run_id desc"))
def history_list(spark, sf_dir):
    # the history holds the as-of snapshot rows and, written later, the
    # final rows; the last write of each run wins
    r = stored_runs(spark, sf_dir)
    snap = state_as_of(r).withColumn("write_seq", F.lit(0))
    final = (r.select(*_FOLD_COLS.split(", "))
             .withColumn("seq", F.unix_micros(F.col("start_time").cast("timestamp")))
             .withColumn("write_seq", F.lit(1)))
    table = snap.unionByName(final)
    latest = history.latest_per_run(table, seq="write_seq")
    return history.newest_first(latest).select(*_FOLD_COLS.split(", "))


@register("history_latest", hist_sql(
    f"select {_FOLD_COLS} from runs order by start_time desc, run_id desc limit 1"))
def history_latest(spark, sf_dir):
    return history.latest_run(runs(spark, sf_dir)).select(*_FOLD_COLS.split(", "))


@register("history_latest_completed", hist_sql(
    f"select {_FOLD_COLS} from folded where status = 'COMPLETED' order by start_time desc, run_id desc limit 1"))
def history_latest_completed(spark, sf_dir):
    return history.latest_completed(state_as_of(stored_runs(spark, sf_dir))).select(*_FOLD_COLS.split(", "))


# ---- H8: external runs, one payload per scanned file ----------------------------------
# Status text per language exercises the checks: accepted as given,
# lower-case (accepted), RUNNING (accepted, stored COMPLETED), blank and
# unknown (rejected).  The shortest ids are blank: those runs get made-up ids.
EXT_STATUS = ("case when n_chars > 3000 then 'DONE' when lang = 'en' then 'COMPLETED' when lang = 'de' then 'failed' "
              "when lang = 'fr' then 'RUNNING' else ' ' end")
EXT_BLANK = "n_chars < 120"
_ISO_JSON = "yyyy-MM-dd'T'HH:mm:ss"


def external_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON payloads, one per scanned file, carrying that file's findings.
    Built in one pass from each file's findings array: no grouping, no join."""
    files = doc_files(spark, sf_dir).filter(F.col("status") == "SCANNED").withColumn("n_chars", F.char_length("text"))
    per = findings_per_row(files, "text")
    scanned_at = F.date_format(F.col("modified") + F.expr(SCAN_DELAY), _ISO_JSON)
    items = F.transform(F.col("findings"), lambda x: F.struct(
        F.col("file_name").alias("fileName"), F.col("path").alias("filePath"),
        x["data_type"].alias("dataType"), x["risk_level"].alias("riskLevel"),
        x["masked_value"].alias("maskedValue"), scanned_at.alias("scanTimestamp")))
    body = F.struct(
        F.when(F.expr(EXT_BLANK), " ").otherwise(F.concat(F.lit("ext-"), F.col("doc_id").cast("string"))).alias("runId"),
        F.date_format("created", _ISO_JSON).alias("startTime"),
        F.date_format("modified", _ISO_JSON).alias("endTime"), F.col("path").alias("scanPath"),
        F.lit(1).alias("filesScanned"), F.lit(0).alias("filesSkipped"), F.lit(0).alias("errorsEncountered"),
        items.alias("findings"), F.expr(EXT_STATUS).alias("status"))
    return per.select(F.to_json(body).alias("payload"))


_EXT_COLS = ["run_id", "status", "start_time", "end_time", "scan_path", "files_scanned", "files_skipped",
             "errors", "critical", "medium", "normal", "reject_reason"]


_EXT_ROWS = (
    "select case when blank then 'made' else 'ext-' || cast(d.doc_id as varchar) end as run_id, "
    "case when st not in ('COMPLETED', 'failed', 'RUNNING') then null when st = 'failed' then 'FAILED' "
    "else 'COMPLETED' end as status, d.created as start_time, d.modified as end_time, d.path as scan_path, 1 as files_scanned, "
    "0 as files_skipped, 0 as errors, coalesce(k.critical, 0) as critical, coalesce(k.medium, 0) as medium, "
    "coalesce(k.normal, 0) as normal, "
    "case when trim(st) = '' then 'status is required (COMPLETED or FAILED).' "
    "when st = 'DONE' then 'Invalid status ''' || st || '''. Expected COMPLETED or FAILED.' "
    "end as reject_reason, d.doc_id "
    f"from (select f.*, {EXT_STATUS} as st, {EXT_BLANK} as blank from doc_files f join documents x using (doc_id) "
    "where f.status = 'SCANNED') d left join (select doc_id, "
    "count(*) filter (where risk_level = 'CRITICAL') as critical, count(*) filter (where risk_level = 'MEDIUM') as medium, "
    "count(*) filter (where risk_level = 'NORMAL') as normal from run_findings group by doc_id) k using (doc_id)")
# a made-up id is 36 characters of lower-case hex and dashes; the oracle knows the others
_MADE = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def _known_ids() -> Column:
    return F.regexp_replace("run_id", _MADE, "made")


@register("external_ingest", run_ctes(f"select {', '.join(_EXT_COLS)} from ({_EXT_ROWS}) x", "run_findings"))
def external_ingest(spark, sf_dir):
    parsed = history.parse_external(external_payloads(spark, sf_dir))
    return parsed.withColumn("run_id", _known_ids()).select(*_EXT_COLS)


@register("external_findings", run_ctes(
    f"select x.run_id, f.file_path, f.data_type, f.risk_level, f.masked_value from ({_EXT_ROWS}) x "
    "join run_findings f using (doc_id) where reject_reason is null", "run_findings"))
def external_findings(spark, sf_dir):
    """Accepted external runs, stored once: their findings, one row each."""
    stored = history.store_external(external_payloads(spark, sf_dir), shared_dir(spark, "external", uuid.uuid4().hex))
    return history.external_findings(stored).select(
        _known_ids().alias("run_id"), F.col("filePath").alias("file_path"), F.col("dataType").alias("data_type"),
        F.col("riskLevel").alias("risk_level"), F.col("maskedValue").alias("masked_value"))


@register("external_history", run_ctes(
    "select run_id, status, start_time, end_time, scan_path, files_scanned, files_skipped, errors, critical, medium, "
    f"normal, cast(null as varchar) as report_path from ({_EXT_ROWS}) x where reject_reason is null", "run_findings"))
def external_history(spark, sf_dir):
    """Accepted external runs as the history restores them."""
    base = shared_dir(spark, "external", uuid.uuid4().hex)
    history.store_external(external_payloads(spark, sf_dir), base, f"{base}/history")
    return history.read_history(spark, f"{base}/history").withColumn("run_id", _known_ids())


@register("run_by_id", run_ctes(
    "select s.run_id, s.status, s.scan_path, s.critical, f.file_path, f.data_type, f.match_idx, f.masked_value "
    "from run_summary s left join run_findings f using (run_id) where s.run_id = 'run-src1'", "run_summary"))
def run_by_id(spark, sf_dir):
    """One run by its id with its findings."""
    run = history.run_by_id(run_summary_df(spark, sf_dir), "run-src1")
    found = run_findings(spark, sf_dir).filter("run_id = 'run-src1'")
    return run.select("run_id", "status", "scan_path", "critical").join(
        found.select("run_id", "file_path", "data_type", "match_idx", "masked_value"), "run_id", "left")


# ---- K1, K2, U3: reports written in every format and read back ---------------------------
_FORMATS = ("csv", "parquet", "json", "lines")


@register("reports_read_back", run_ctes(
    "select fmt, file_path, data_type, risk_level, masked_value, "
    f"{_report_ts('scan_ts')} as scan_ts from run_findings, (select unnest([{', '.join(duck.q(f) for f in _FORMATS)}]) as fmt) f "
    , "run_findings"))
def reports_read_back(spark, sf_dir):
    """Reports in all formats (one of them a user's own), read back; an unknown format writes none."""
    @report.writer("lines")
    def lines(df, path):
        df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)

    base = shared_dir(spark, "reports", uuid.uuid4().hex)
    found = browse.stored(run_findings(spark, sf_dir), "report")
    if report.write_report(found, f"{base}/none", "no-such-format") is not None:
        raise AssertionError("an unknown format must not write a report")
    header = {c: f"c{i}" for i, c in enumerate(browse.REPORT_HEADER)}
    out = None
    for fmt in _FORMATS:
        path = report.write_report(found, f"{base}/{fmt}", fmt.upper())
        if fmt == "csv":
            back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
        else:
            back = spark.read.json(path) if fmt in ("json", "lines") else spark.read.parquet(path)
        back = back.select(F.lit(fmt).alias("fmt"), *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(header[c])
                                                      for c in browse.REPORT_HEADER])
        out = back if out is None else out.unionByName(back)
    return out.select("fmt", F.col("c1").alias("file_path"), F.col("c2").alias("data_type"), F.col("c3").alias("risk_level"),
                      F.col("c4").alias("masked_value"), F.col("c5").alias("scan_ts"))


# ---- H1 + H2 on written files: quotes, commas, backslashes and line breaks ----------------
_ODD_PATHS = ("C:\\data\\", 'a "q", b', "two\nlines", "plain", 'ends with "')


@register("history_files", run_ctes(
    "select run_id || '-' || cast(i as varchar) as run_id, status, start_time, end_time, "
    f"[{', '.join(duck.q(p) for p in _ODD_PATHS)}][i] as scan_path, files_scanned, files_skipped, errors, critical, medium, "
    f"normal, report_path from run_summary, (select unnest(range(1, {len(_ODD_PATHS) + 1})) as i) n", "run_summary"))
def history_files(spark, sf_dir):
    """Runs appended to the history files (twice: it only grows) and restored from them."""
    odd = F.array(*[F.lit(p) for p in _ODD_PATHS])
    rows = run_summary_df(spark, sf_dir).drop("scan_path").select("*", F.posexplode(odd).alias("i", "scan_path"))
    rows = browse.stored(rows.withColumn("run_id", F.concat_ws("-", "run_id", F.col("i") + 1)), "runs")
    path = shared_dir(spark, "history", uuid.uuid4().hex)
    history.append_history(rows.filter("i < 2"), path)
    history.append_history(rows.filter("i >= 2"), path)
    return history.read_history(spark, path)


# ---- Q6 on the history: 10 runs a page, newest first ------------------------------------
HISTORY_PAGE = 2


@register("history_page", run_ctes(
    "select run_id, status, start_time, scan_path, pos, (select pg from page_no) as page, "
    "total from (select *, row_number() over (order by start_time desc, run_id desc) as pos, "
    "count(*) over () as total from run_summary) x "
    f"where pos > ((select pg from page_no) - 1) * {browse.PAGE_SIZE} "
    f"and pos <= (select pg from page_no) * {browse.PAGE_SIZE}", "run_summary").replace(
    "\nselect run_id, status, start_time", ",\npage_no as (select least(" + str(HISTORY_PAGE)
    + ", greatest(1, cast(ceil(count(*) / " + str(browse.PAGE_SIZE) + ".0) as integer))) as pg from run_summary)"
    "\nselect run_id, status, start_time", 1))
def history_page(spark, sf_dir):
    rows = run_summary_df(spark, sf_dir).select("run_id", "status", "start_time", "scan_path")
    return browse.page(rows, HISTORY_PAGE, seq=[F.col("start_time"), F.col("run_id")])
