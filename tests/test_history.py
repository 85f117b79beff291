"""History restore, folding, external runs, report sinks."""

import datetime as dt
import json
import os

from pyspark.sql import functions as F

from piisift.operators import history, report, summary

LINES = [
    "r1,COMPLETED,2024-01-01T10:00,2024-01-01T10:05:30,/data,3,1,0,2,1,0,reports/a.csv",
    "r2,FAILED,2024-01-02T10:00:01,2024-01-02T10:00:02.500,,0,0,1,0,0,0,",
    '"r,3",COMPLETED,2024-01-03T00:00,2024-01-03T00:01,"a,b",1,1,1,1,1,1,x',
    "r4,COMPLETED,2024-01-01T10:00,2024-01-01T10:05,/data,3,1,0,2,1,0",           # 11 fields
    "r5,COMPLETED,2024-01-01T10:00,2024-01-01T10:05,/data,3,1,0,2,1,0,rep,extra",  # 13 fields
    "r6,DONE,2024-01-01T10:00,2024-01-01T10:05,/data,3,1,0,2,1,0,rep",             # bad enum
    "r7,COMPLETED,2024-01-01T10:00,2024-01-01T10:05,/data, 5,1,0,2,1,0,rep",       # bad integer
    "r8,COMPLETED,2024-01-01 00:00:00,2024-01-01T10:05,/data,3,1,0,2,1,0,rep",     # bad time
    "r9,COMPLETED,2024-01-01,2024-01-01T10:05,/data,3,1,0,2,1,0,rep",              # bare date
    "r1,COMPLETED,2024-01-01T10:00,2024-01-01T10:06,/data,3,1,0,2,1,0,reports/b.csv",  # same id again
]


def test_restore(spark):
    got = history.restore_history(spark.createDataFrame([(x,) for x in LINES], "value string")).collect()
    ids = sorted(r.run_id for r in got)
    assert ids == ["r,3", "r1", "r1", "r2", "r5"]
    r2 = [r for r in got if r.run_id == "r2"][0]
    assert r2.scan_path is None and r2.report_path is None and r2.errors == 1
    assert r2.end_time == dt.datetime(2024, 1, 2, 10, 0, 2, 500000)
    assert [r.scan_path for r in got if r.run_id == "r,3"] == ["a,b"]


def test_rows_roundtrip(spark):
    runs = history.restore_history(spark.createDataFrame([(x,) for x in LINES[:3]], "value string"))
    back = history.restore_history(history.history_lines(runs))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, runs.collect()))
    rows = {r.run_id: r for r in history.history_rows(runs).collect()}
    assert rows["r1"].start_time == "2024-01-01T10:00" and rows["r1"].end_time == "2024-01-01T10:05:30"
    assert rows["r2"].end_time == "2024-01-02T10:00:02.500" and rows["r2"].scan_path == ""


def test_latest_per_run_and_lists(spark):
    runs = history.restore_history(spark.createDataFrame([(x,) for x in LINES], "value string"))
    runs = runs.withColumn("seq", F.monotonically_increasing_id())
    one = {r.run_id: r for r in history.latest_per_run(runs).collect()}
    assert one["r1"].report_path == "reports/b.csv" and len(one) == 4
    assert history.latest_completed(runs).collect()[0].run_id == "r,3"
    view = {r.short_id: r for r in history.history_view(runs).collect()}
    assert view["r2"].location == "-" and view["r2"].duration == "00:00:01.500"


def test_fold_events(spark):
    t = dt.datetime
    ev = spark.createDataFrame([
        ("a", 1, "started", t(2024, 1, 1, 0, 0), "/x", None),
        ("a", 2, "finished", t(2024, 1, 1, 0, 1), "/x", "rep.csv"),
        ("b", 3, "started", t(2024, 1, 1, 0, 2), "/y", None),
        ("c", 4, "started", t(2024, 1, 1, 0, 3), "/z", None),
        ("c", 5, "failed", t(2024, 1, 1, 0, 4), "/z", None)],
        "run_id string, seq long, event string, at timestamp_ntz, scan_path string, report_path string")
    st = {r.run_id: r for r in history.fold_events(ev).collect()}
    assert st["a"].status == "COMPLETED" and st["a"].report_path == "rep.csv"
    assert st["b"].status == "RUNNING" and st["b"].end_time is None
    assert st["c"].status == "FAILED"
    cur = history.current_run(history.fold_events(ev).withColumn("seq", F.unix_micros(
        F.col("start_time").cast("timestamp")))).collect()
    assert [(r.run_id, r.any_running) for r in cur] == [("b", True)]


def test_external_ingest(spark):
    f = {"fileName": "a.txt", "filePath": "/a.txt", "dataType": "CARD_NUMBER", "riskLevel": "CRITICAL",
         "maskedValue": "****1111"}
    base = {"runId": "x1", "startTime": "2024-01-01T00:00:00", "endTime": "2024-01-01T00:01:00",
            "scanPath": "/d", "filesScanned": 2, "filesSkipped": 1, "errorsEncountered": 0,
            "findings": [f, dict(f, riskLevel="NORMAL")], "status": "COMPLETED"}
    payloads = [base, dict(base, runId="x2", status="failed"), dict(base, runId=" "),
                dict(base, runId="x4", findings=None), dict(base, runId="x5", startTime=None),
                dict(base, runId="x6", status=" "), dict(base, runId="x7", status="done"),
                dict(base, runId="x8", status="RUNNING")]
    df = spark.createDataFrame([(json.dumps(p),) for p in payloads], "payload string")
    got = history.parse_external(df).collect()
    ok = [r for r in got if r.reject_reason is None]
    assert len(ok) == 5
    by = {r.run_id: r for r in ok}
    assert by["x1"].critical == 1 and by["x1"].normal == 1 and by["x2"].status == "FAILED"
    assert by["x4"].critical == 0
    assert len([r for r in ok if r.run_id not in ("x1", "x2", "x4", "x8")][0].run_id) == 36  # made from the payload
    bad = {r.run_id: r.reject_reason for r in got if r.reject_reason}
    assert "required" in bad["x5"] and "required" in bad["x6"] and "Invalid status" in bad["x7"]
    assert by["x8"].status == "COMPLETED"  # RUNNING is taken in and stored as ended
    assert {r.run_id: r.status for r in got if r.reject_reason} == {"x5": None, "x6": None, "x7": None}
    assert history.external_findings(history.parse_external(df)).count() == 8


def test_summary_helpers(spark):
    f = spark.createDataFrame([("r", "CRITICAL", "CARD_NUMBER"), ("r", "NORMAL", "EMAIL")],
                              "run_id string, risk_level string, data_type string")
    runs = spark.createDataFrame([("r",), ("empty",)], "run_id string")
    c = {r.run_id: r for r in summary.risk_share(summary.risk_counts(f, "run_id", runs)).collect()}
    assert c["r"].critical_pct == 50.0 and c["empty"].total == 0 and c["empty"].critical_share == "0.0%"
    files = spark.createDataFrame(
        [("r", "SCANNED", [("CRITICAL", "CARD_NUMBER"), ("NORMAL", "EMAIL")]), ("r", "SKIPPED", []), ("empty", "ERROR", [])],
        "run_id string, status string, findings array<struct<risk_level:string,data_type:string>>")
    stats = summary.run_stats(files, "run_id")
    n = {r.run_id: r for r in summary.card_notice(stats).collect()}
    assert (n["r"].files_scanned, n["r"].files_skipped, n["r"].critical, n["r"].total) == (1, 1, 1, 2)
    assert n["empty"].errors == 1 and n["empty"].total == 0
    assert n["r"].has_card and n["r"].notice.startswith("Card number") and n["empty"].notice is None
    d = spark.createDataFrame([(None,), (-5,), (3_723_004,), (400_000_000,)], "ms long")
    got = [r.t for r in d.select(summary.duration_text(F.col("ms")).alias("t")).collect()]
    assert got == ["00:00:00.000", "00:00:00.000", "01:02:03.004", "111:06:40.000"]


def test_report_sinks(spark, tmp_path):
    t = dt.datetime(2024, 1, 5, 13, 4)
    f = spark.createDataFrame([("a.txt", "/d/a.txt", "CARD_NUMBER", "CRITICAL", "****1111", t, None, t)],
                              "file_name string, file_path string, data_type string, risk_level string, "
                              "masked_value string, scan_ts timestamp_ntz, file_created timestamp_ntz, "
                              "file_modified timestamp_ntz")
    assert report.write_report(f, str(tmp_path / "nope"), "pdf") is None
    out = report.write_report(f, str(tmp_path / "rep"), "CSV", single_file=True)
    text = "".join(open(os.path.join(out, p)).read() for p in os.listdir(out) if p.endswith(".csv"))
    assert text.splitlines()[0].startswith("File Name,File Path,Sensitive Data Type")
    assert "2024-01-05 13:04:00" in text and ",," in text
    ex = report.write_export(f, str(tmp_path / "exp"), single_file=True)
    body = "".join(open(os.path.join(ex, p), newline="").read() for p in os.listdir(ex) if p.endswith(".csv"))
    assert "PII Type" in body and "Card Number" in body and "05 Jan 2024, 1:04 PM" in body and "\r\n" in body


def test_history_table_append_and_read(spark, tmp_path):
    runs = history.restore_history(spark.createDataFrame([(x,) for x in LINES[:3]], "value string"))
    path = str(tmp_path / "history")
    history.append_history(runs, path)
    history.append_history(runs.filter("run_id = 'r1'"), path)
    back = history.read_history(spark, path)
    assert back.count() == 4
    assert sorted(r.run_id for r in back.collect()) == ["r,3", "r1", "r1", "r2"]
    assert [r.scan_path for r in back.collect() if r.run_id == "r,3"] == ["a,b"]


def test_location_and_labels(spark):
    from piisift.operators import browse
    rows = [("C:\\data\\a.txt", "a.txt"), ("/d/x/b.csv", "b.csv"), ("/d/x/b.csv", "other"),
            ("noseparator", "zzz"), (None, "a"), ("", "a")]
    df = spark.createDataFrame(rows, "p string, n string")
    got = [r.l for r in df.select(browse.location(F.col("p"), F.col("n")).alias("l")).collect()]
    assert got == ["C:\\data", "/d/x", "/d/x", "noseparator", "-", "-"]
    t = spark.createDataFrame([("CARD_NUMBER",), ("X_TYPE",)], "t string")
    assert [r.l for r in t.select(browse.type_label(F.col("t")).alias("l")).collect()] == ["Card Number", "X_TYPE"]


def test_report_formats(spark, tmp_path):
    t = dt.datetime(2024, 1, 5, 13, 4)
    f = spark.createDataFrame([("a.txt", "/d/a.txt", "EMAIL", "NORMAL", "j**n@x.org", t, t, t)],
                              "file_name string, file_path string, data_type string, risk_level string, "
                              "masked_value string, scan_ts timestamp_ntz, file_created timestamp_ntz, "
                              "file_modified timestamp_ntz")
    for fmt in ("parquet", "json", "Excel"):
        out = report.write_report(f, str(tmp_path / fmt), fmt)
        assert out is not None and os.listdir(out)
    back = spark.read.parquet(str(tmp_path / "parquet")).collect()[0]
    assert back["Masked Value"] == "j**n@x.org" and back["Scan Timestamp"] == "2024-01-05 13:04:00"


def test_excel_report_roundtrip(spark, tmp_path):
    from piisift.sources.extract import xlsx_text
    t = dt.datetime(2024, 1, 5, 13, 4)
    f = spark.createDataFrame([("a<&>.txt", "/d/a.txt", "CARD_NUMBER", "CRITICAL", "**** 1111", t, None, t),
                               ("b.txt", "/d/b.txt", "EMAIL", "NORMAL", "j**n@x.org", t, None, t)],
                              "file_name string, file_path string, data_type string, risk_level string, "
                              "masked_value string, scan_ts timestamp_ntz, file_created timestamp_ntz, "
                              "file_modified timestamp_ntz").coalesce(1)
    out = report.write_report(f, str(tmp_path / "xl"), "EXCEL")
    parts = [p for p in os.listdir(out) if p.endswith(".xlsx")]
    assert len(parts) == 1
    text = xlsx_text(open(os.path.join(out, parts[0]), "rb").read())
    lines = text.splitlines()
    assert lines[0].startswith("File Name File Path Sensitive Data Type Risk Level Masked Value")
    assert "a<&>.txt /d/a.txt CARD_NUMBER CRITICAL **** 1111 2024-01-05 13:04:00  2024-01-05 13:04:00 " in lines
    empty = report.write_report(f.limit(0), str(tmp_path / "xl0"), "excel")
    only = [p for p in os.listdir(empty) if p.endswith(".xlsx")]
    assert len(only) == 1 and xlsx_text(open(os.path.join(empty, only[0]), "rb").read()).count("\n") == 1


def test_display_timestamps(spark):
    from piisift.operators import browse
    df = spark.createDataFrame([("2024-01-05T13:04:00",), ("2024-01-05T00:30:00",), ("not a time",), ("",), (None,)],
                               "s string")
    got = [r.d for r in df.select(browse.display_ts_text(F.col("s")).alias("d")).collect()]
    assert got == ["05 Jan 2024, 1:04 PM", "05 Jan 2024, 12:30 AM", "not a time", "–", "–"]


def test_restore_keeps_an_empty_run_id(spark):
    lines = [",COMPLETED,2024-01-01T10:00,2024-01-01T10:05,/data,1,0,0,0,0,0,", ""]
    got = history.restore_history(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [(r.run_id, r.status) for r in got] == [("", "COMPLETED")]
