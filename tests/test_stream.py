"""Scheduled scans as incremental availableNow runs over a checkpoint."""

from piisift.streaming import stream as S


def test_incremental_file_stream(spark, tmp_path):
    land = tmp_path / "land"
    (land / "a").mkdir(parents=True)
    (land / "a" / "one.txt").write_text("card 4111 1111 1111 1111")
    (land / "a" / "skip.md").write_text("card 4111 1111 1111 1111")
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")

    def run():
        found = S.findings_stream(S.read_text_files(spark, str(land)), "text", ["path"])
        S.start_findings_sink(found, out, cp).awaitTermination()
        return spark.read.parquet(out)

    first = run()
    assert first.count() == 1  # the card in one.txt; .md is not read
    (land / "b").mkdir()
    (land / "b" / "two.txt").write_text("mail someone@example.org")
    second = run()
    rows = second.collect()
    assert len(rows) == 2 and sum(r.path.endswith("two.txt") for r in rows) == 1


def test_live_counters_complete_mode(spark, tmp_path):
    land = tmp_path / "land"
    land.mkdir()
    (land / "x.txt").write_text("4111 1111 1111 1111 and ab@ybl")
    found = S.findings_stream(S.read_text_files(spark, str(land)), "text", ["path"])
    out = str(tmp_path / "counts")
    S.start_counter_sink(S.live_counters(found, "path"), out, str(tmp_path / "cp")).awaitTermination()
    r = spark.read.parquet(out).collect()[0]
    assert (r.critical, r.medium, r.normal, r.total) == (1, 1, 0, 2)


def test_file_stream_with_extraction_and_counters(spark, tmp_path):
    from piisift.operators.detect import findings_per_row
    from pyspark.sql import functions as F
    from piisift.sources.extract import extract_content
    land = tmp_path / "land"
    (land / "f").mkdir(parents=True)
    (land / "f" / "a.txt").write_text("card 4111 1111 1111 1111")
    (land / "f" / "b.csv").write_text("x,4532-0151-1283-0366\n")
    (land / "f" / "c.md").write_text("card 4111 1111 1111 1111")
    (land / "f" / "d.txt").write_bytes(b"\xff\xfe 4111 1111 1111 1111")
    files = extract_content(S.read_files(spark, str(land)))
    files = files.withColumn("folder", F.substring_index("rel_path", "/", 1))
    rows = findings_per_row(files, "text", only_if=F.col("status") == "SCANNED")
    out = str(tmp_path / "counts")
    S.start_counter_sink(S.live_file_counters(rows, "folder"), out, str(tmp_path / "cp")).awaitTermination()
    r = spark.read.parquet(out).collect()[0]
    assert (r.folder, r.files_scanned, r.files_skipped, r.errors) == ("f", 2, 1, 1)
    assert (r.critical, r.total, r.has_card) == (2, 2, True)
