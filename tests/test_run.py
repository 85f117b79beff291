"""A whole scan run over a folder: plan, write once, derive the rest."""

import os

import pytest

from piisift.operators import history
from piisift.operators.run import run_scan
from piisift.sources.paths import ScanConfig, ScanOptions


@pytest.fixture()
def share(tmp_path):
    d = tmp_path / "share"
    (d / "sub").mkdir(parents=True)
    (d / "a.txt").write_text("card 4111 1111 1111 1111, mail jo.doe@example.com")
    (d / "sub" / "b.csv").write_text("name,pan\nx,ABCPK1234L\n")
    (d / "sub" / "c.md").write_text("4111 1111 1111 1111")
    (d / "bad.txt").write_bytes(b"\xff 4111 1111 1111 1111")
    (d / "node_modules").mkdir()
    (d / "node_modules" / "z.txt").write_text("4111 1111 1111 1111")
    return str(d)


def test_run_scan_lazy_views(spark, share):
    run = run_scan(spark, [share])
    got = sorted((r.file_name, r.data_type, r.masked_value) for r in run.findings.collect())
    assert got == [("a.txt", "CARD_NUMBER", "**** **** **** 1111"), ("a.txt", "EMAIL", "j****e@example.com"),
                   ("b.csv", "PAN_NUMBER", "*1234*")]
    st = {r.file_name: r.status for r in run.files.collect()}
    assert st == {"a.txt": "SCANNED", "b.csv": "SCANNED", "c.md": "SKIPPED", "bad.txt": "ERROR"}


def test_run_scan_write(spark, share, tmp_path):
    run = run_scan(spark, [share], types=["CARD_NUMBER", "PAN_NUMBER"], run_id="run-1")
    hist = str(tmp_path / "history")
    row = run.write(str(tmp_path / "out"), "csv", history_path=hist).collect()[0]
    assert (row.files_scanned, row.files_skipped, row.errors) == (2, 1, 1)
    assert (row.critical, row.medium, row.normal) == (1, 1, 0)
    assert row.report_path and os.path.isdir(row.report_path)
    back = history.read_history(spark, hist).collect()
    assert [(r.run_id, r.status, r.critical) for r in back] == [("run-1", "COMPLETED", 1)]


def test_run_scan_rejects_bad_request(spark, share):
    with pytest.raises(ValueError):
        run_scan(spark, [share], types=["NOPE"])
    with pytest.raises(FileNotFoundError):
        run_scan(spark, [share + "/missing"], on_missing="error")
    assert run_scan(spark, [share], options=ScanOptions(recursive=False),
                    config=ScanConfig()).files.count() == 2


def test_command_line(spark, share, tmp_path, capsys):
    import json

    from piisift.__main__ import main
    assert main(["scan", share, "--out", str(tmp_path / "o"), "--types", "CARD_NUMBER", "--no-hidden"]) == 0
    row = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert (row["files_scanned"], row["errors"], row["critical"]) == (2, 1, 1)
    assert main(["scan", share, "--out", str(tmp_path / "o"), "--types", "NOPE"]) == 2


def test_failed_run_is_recorded(spark, share, tmp_path):
    run = run_scan(spark, [share], run_id="run-f")
    out = tmp_path / "blocked"
    out.write_text("a file where the output folder should go")
    hist = str(tmp_path / "history")
    with pytest.raises(Exception):
        run.write(str(out), "csv", history_path=hist)
    back = history.read_history(spark, hist).collect()
    assert [(r.run_id, r.status, r.report_path) for r in back] == [("run-f", "FAILED", None)]
    assert back[0].end_time is not None
