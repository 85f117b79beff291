"""Cases that were lost or repeated before: long cells, dialects, replays, lost folders, equal folder names."""

import os

import pytest
from pyspark.sql import functions as F

from piisift.operators import browse, history
from piisift.operators.run import run_scan, run_states
from piisift.plans import sources_q, stream_q, tables
from piisift.sources.extract import csv_text, extract_text
from piisift.sources.files import list_files
from piisift.streaming import stream as S


def test_long_csv_cells_are_read_whole():
    cell = "x" * 300_000 + " 4111 1111 1111 1111"
    assert csv_text(f'"{cell}",b\n'.encode()) == f"{cell} | b | \n"


def test_error_texts_are_whole(spark, tmp_path):
    name = "n" * 200
    files = spark.createDataFrame([(str(tmp_path / name / name / name), "txt")], "path string, extension string")
    error = extract_text(files).first().error
    assert error.count(name) == 3


@pytest.mark.skipif(os.geteuid() == 0, reason="the root user can read every folder")
def test_unreadable_folders_are_errors(spark, tmp_path):
    (tmp_path / "shut").mkdir(mode=0)
    got = extract_text(list_files(spark, [str(tmp_path)])).collect()
    assert [(r.status, bool(r.error)) for r in got] == [("ERROR", True)]


def test_vanished_files_are_errors(spark, tmp_path):
    os.symlink(tmp_path / "gone", tmp_path / "dangling.txt")
    got = extract_text(list_files(spark, [str(tmp_path)])).collect()
    assert [(r.file_name, r.status, "FileNotFoundError" in r.error) for r in got] == [("dangling.txt", "ERROR", True)]


ROW = '{},COMPLETED,2024-01-01T10:00,2024-01-01T10:05,{},1,2,3,4,5,6,{}'


@pytest.mark.parametrize("field,value", [
    ('"a ""q"", b"', 'a "q", b'), ('"C:\\data\\"', "C:\\data\\"), ('"a ""q"" b"', 'a "q" b'), ("C:\\x", "C:\\x"), ('"two\nlines"', "two\nlines"),
])
def test_restore_reads_standard_csv(spark, tmp_path, field, value):
    line = ROW.format("r", field, "rep")
    got = history.restore_history(spark.createDataFrame([(line,)], "value string")).collect()
    assert [r.scan_path for r in got] == [value]
    (tmp_path / "h.csv").write_text(line + "\r\n" + ROW.format("s", "plain", "") + "\r\n", newline="")
    got = {r.run_id: r.scan_path for r in history.read_history(spark, str(tmp_path)).collect()}
    assert got == {"r": value, "s": "plain"}


def test_external_ids_are_stable_and_running_is_stored_completed(spark):
    body = '{"startTime":"2024-01-01T10:00:00","endTime":"2024-01-01T10:01:00","status":"%s","findings":[{"dataType":"EMAIL","riskLevel":"NORMAL"}]}'
    frame = spark.createDataFrame([(body % "running",), (body % "DONE",)], "payload string")
    parsed = history.parse_external(frame)
    first, again = parsed.collect(), parsed.collect()
    assert [r.run_id for r in first] == [r.run_id for r in again]
    assert [(r.status, r.reject_reason is None) for r in first] == [("COMPLETED", True), (None, False)]
    assert {r.run_id for r in history.external_findings(parsed).collect()} == {first[0].run_id}


def test_a_run_records_its_start(spark, tmp_path):
    share = tmp_path / "share"
    share.mkdir()
    (share / "a.txt").write_text("card 4111 1111 1111 1111")
    past = str(tmp_path / "history")
    run = run_scan(spark, [str(share)], run_id="r")
    assert not os.path.exists(past + "-events")  # nothing before write
    run.write(str(tmp_path / "out"), "csv", past)
    assert [(r.run_id, r.status) for r in run_states(spark, past + "-events").collect()] == [("r", "COMPLETED")]


def test_failed_runs_keep_the_counts_they_reached(spark, tmp_path):
    from piisift.operators import report
    share = tmp_path / "share"
    share.mkdir()
    (share / "a.txt").write_text("card 4111 1111 1111 1111")

    @report.writer("failing")
    def failing(df, path):
        raise OSError("disk")
    past = str(tmp_path / "history")
    with pytest.raises(OSError):
        run_scan(spark, [str(share)], run_id="f").write(str(tmp_path / "out"), "failing", past)
    row = history.read_history(spark, past).first()
    assert (row.status, row.files_scanned, row.critical) == ("FAILED", 1, 1)
    assert [r.status for r in run_states(spark, past + "-events").collect()] == ["FAILED"]


def test_java_patterns_are_accepted_and_bad_ones_refused(spark, tmp_path):
    (tmp_path / "a.txt").write_text("a.b and aXb")
    run = run_scan(spark, [str(tmp_path)], types=["PAN_NUMBER"], custom_patterns={"PAN_NUMBER": r"\Qa.b\E"})
    assert run.findings.count() == 1
    with pytest.raises(ValueError):
        run_scan(spark, [str(tmp_path)], custom_patterns={"PAN_NUMBER": "(unclosed"})


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([(1, "4111 1111 1111 1111")], "doc_id long, text string").write.parquet(str(src))
    schema = spark.read.parquet(str(src)).schema
    out = str(tmp_path / "out")
    for cp in ("one", "two"):  # a lost checkpoint: the same batch number comes again
        found = S.findings_stream(S.read_texts(spark, str(src), schema), "text", ["doc_id"])
        S.start_recent_sink(found, out, str(tmp_path / cp)).awaitTermination()
    assert spark.read.parquet(out).filter("data_type = 'CARD_NUMBER'").count() == 1


def test_counters_are_whole_versions(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for n in range(5):
        spark.createDataFrame([(n, "4111 1111 1111 1111")], "doc_id long, text string").write.mode("append").parquet(src)
        schema = spark.read.parquet(src).schema
        found = S.findings_stream(S.read_texts(spark, src, schema), "text", ["doc_id"], types=["CARD_NUMBER"])
        S.start_counter_sink(S.live_counters(found, "data_type"), out, str(tmp_path / "cp")).awaitTermination()
        assert S.read_counters(spark, out).first().total == n + 1
    os.makedirs(f"{out}/version=99")  # a version whose write never ended
    assert S.read_counters(spark, out).first().total == 5
    assert len([d for d in os.listdir(out) if d.startswith("version=")]) == 4


def test_streams_read_tables_stored_as_folders(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    want = stream_q.stream_findings(spark, "/root/testdata/sf0.001").count()
    assert stream_q.stream_findings(spark, str(tmp_path)).count() == want > 0


def test_folders_of_equal_name_hold_their_own_files(spark, tmp_path):
    roots = []
    for word in ("one", "two"):  # equal last folder, equal sizes
        place = str(tmp_path / word / "sf")
        spark.createDataFrame([(1, "en", "s", f"{word} " * 40, 160)], "doc_id long, lang string, source string, text string, n_chars long") \
            .write.parquet(place + "/documents.parquet")
        roots.append(sources_q.materialized_root(spark, place))
    texts = [open(f"{r}/s/doc-1.txt").read() for r in roots]
    assert texts == ["one " * 40, "two " * 40]


def test_deep_pages_equal_top_pages(spark, monkeypatch):
    rows = spark.range(95).select(F.col("id").alias("k"))
    want = [(r.k, r.pos, r.page, r.total) for r in browse.page(rows, 4, seq=[F.col("k")]).orderBy("pos").collect()]
    monkeypatch.setattr(browse, "TOP_ROWS", 0)
    got = [(r.k, r.pos, r.page, r.total) for r in browse.page(rows, 4, seq=[F.col("k")]).orderBy("pos").collect()]
    assert got == want and got[0] == (64, 31, 4, 95)


def test_files_are_extracted_once(spark):
    import contextlib
    import io
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        sources_q.files_findings(spark, "/root/testdata/sf0.001").explain()
    assert out.getvalue().count("MapInPandas") == 1


def test_large_inputs_are_not_reshuffled(spark):
    many = spark.range(100, numPartitions=16)
    assert tables.spread(many) is many
