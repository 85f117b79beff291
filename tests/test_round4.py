"""Round 4: streams over ledgers of files."""

import os

from pyspark.sql import functions as F

from piisift.sources.extract import extract_content
from piisift.streaming import stream as S


def _read(spark, root, out, cp, **kw):
    files = S.read_files(spark, str(root), **kw).select("rel_path", "file_name", "extension", "size_bytes", "modified", "content")
    S.start_findings_sink(files, str(out), str(cp)).awaitTermination()
    return {r.rel_path: bytes(r.content) for r in spark.read.parquet(str(out)).collect()}


def test_file_stream_reads_each_file_once_by_a_ledger(spark, tmp_path):
    land, out, cp = tmp_path / "land", tmp_path / "out", tmp_path / "cp"
    (land / "a").mkdir(parents=True)
    for name in ("one.txt", "two.TXT", "_draft.txt", ".hidden.txt"):
        (land / "a" / name).write_bytes(name.encode())
    os.utime(land / "a" / "one.txt", (1_700_000_000.25, 1_700_000_000.25))
    assert _read(spark, land, out, cp) == {"a/one.txt": b"one.txt", "a/two.TXT": b"two.TXT"}
    row = spark.read.parquet(str(out)).filter("file_name = 'one.txt'").first()
    assert (row.extension, row.size_bytes, row.modified.timestamp() % 1) == ("txt", 7, 0.25)
    (land / "b c").mkdir()
    (land / "b c" / "three.csv").write_bytes(b"")
    assert len(_read(spark, land, out, cp)) == 3 and spark.read.parquet(str(out)).count() == 3
    # another checkpoint reads all that is there now
    (land / "a" / "one.txt").unlink()
    assert set(_read(spark, land, tmp_path / "out2", tmp_path / "cp2")) == {"a/two.TXT", "b c/three.csv"}
    assert set(_read(spark, land, tmp_path / "out3", tmp_path / "cp3", glob="*.[tT][xX]{t,T}")) == {"a/two.TXT"}


def test_file_stream_bounds_its_micro_batches(spark, tmp_path):
    land = tmp_path / "land"
    land.mkdir()
    for i in range(7):
        (land / f"{i}.txt").write_text("x" * i)
    files = extract_content(S.read_files(spark, str(land), max_files_per_trigger=3))
    sizes = []
    q = (files.writeStream.foreachBatch(lambda b, n: sizes.append(b.count())).trigger(availableNow=True)
         .option("checkpointLocation", str(tmp_path / "cp")).start())
    q.awaitTermination()
    assert sum(sizes) == 7 and max(sizes) <= 3


def test_file_stream_keeps_names_off_the_driver(spark, tmp_path):
    # the stream's own files are parts of the ledger, not the files that land
    land, cp = tmp_path / "land", tmp_path / "cp"
    land.mkdir()
    for i in range(300):
        (land / f"{i}.txt").write_text("x")
    files = S.read_files(spark, str(land)).select("path", F.length("content").alias("n"))
    S.start_findings_sink(files, str(tmp_path / "out"), str(cp)).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 300
    log = "".join(p.read_text() for p in (cp / "sources" / "0").iterdir() if not p.name.startswith("."))
    assert log.count("parquet") and "299.txt" not in log


def _family(rng, size, words):
    vocabulary = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    base = [rng.choice(vocabulary) for _ in range(words)]
    for _ in range(size):
        copy = list(base)
        for _ in range(rng.randint(1, 5)):
            copy[rng.randrange(words)] = rng.choice(vocabulary)
        yield " ".join(copy)


def test_near_groups_find_every_link_of_large_sparse_groups(spark):
    """Copies a few changes apart each: most pairs are below the similarity, hubs and neighbours miss links."""
    import random

    from piisift.llm import near
    rng = random.Random(5)
    texts = [t for _ in range(6) for t in _family(rng, 120, 100)]
    kmers = [near.shingles(near.words_of(t)) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i - i % 120, i):
            if label[i] != label[j] and (texts[i] == texts[j] or near.similarity(kmers[i], kmers[j])):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near.near_groups(frame).collect()}
    assert got == dict(enumerate(label))


def test_patterns_test_the_next_character_before_a_boundary():
    from piisift.functions.types import BY_NAME, ascii_boundaries, spelled_classes
    assert ascii_boundaries(r"\b\d{16}") == r"(?=\d)(?<!\w)\d{16}"
    assert ascii_boundaries(r"\b[a-z.]+@").startswith("(?=[a-z.])(?:")
    for unsure in (r"\b\d*", r"\b[a-z]?x", r"\b(?:a|b)", r"(?i)\b[a-z]+", r"\b[^a]+"):  # the class may not come, or mean more
        assert "(?=[" not in ascii_boundaries(unsure) and r"(?=\d)" not in ascii_boundaries(unsure)
    assert spelled_classes("[a-c0-2.-]") == "[abc012.-]" and spelled_classes(r"\Q[a-c0-2]\E") == r"\Q[a-c0-2]\E"
    assert "a-z" not in BY_NAME["UPI_ID"].pattern and "A-Z" not in BY_NAME["EMAIL"].pattern


def test_checksums_of_two_digits_equal_digit_by_digit(spark):
    from piisift.functions.checks import VERHOEFF_D, VERHOEFF_P, luhn_digits, verhoeff_digits

    def luhn(d):
        doubled = [int(x) * (1 + i % 2) for i, x in enumerate(reversed(d))]
        return 13 <= len(d) <= 19 and sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0

    def verhoeff(d):
        c = 0
        for i, x in enumerate(reversed(d)):
            c = int(VERHOEFF_D[c * 10 + int(VERHOEFF_P[i % 8 * 10 + int(x)])])
        return len(d) == 12 and c == 0

    values = [str((10**17 * 7 + i * 1_234_567_891) % 10**n).zfill(n) for i in range(150) for n in range(11, 21)] + ["", "0" * 12, "0" * 13]
    rows = spark.createDataFrame([(v,) for v in values], "d string").select("d", luhn_digits(F.col("d")).alias("l"), verhoeff_digits(F.col("d")).alias("v"))
    got = rows.collect()
    assert all((r.l, r.v) == (luhn(r.d), verhoeff(r.d)) for r in got) and {r.l for r in got} == {r.v for r in got} == {True, False}


def test_events_are_dealt_by_their_number(spark, tmp_path, monkeypatch):
    from piisift.plans import upkeep_q as U
    rows = spark.range(400).select(F.col("id").alias("event_id"), F.lit("{}").alias("props"),
                                   F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(id as int))").alias("ts"))
    rows.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(U, "EVENTS_PER_TASK", 50)
    assert U.event_tasks(spark, str(tmp_path)) == 8
    sizes = U.deliveries(spark, str(tmp_path), 8).groupBy(F.spark_partition_id()).count().collect()
    assert sorted(n for _, n in sizes) == [50] * 8


def test_document_files_are_written_a_few_texts_at_a_time(tmp_path):
    import pyarrow as pa
    from piisift.plans import sources_q as Q
    n = 2 * Q.TEXTS_AT_ONCE + 2
    batch = pa.record_batch([pa.array(["a b"] * n), pa.array([f"{i}.CSV" if i % 2 else f"{i}.txt" for i in range(n)]),
                             pa.array([None if i == 0 else 'say "é"' for i in range(n)]), pa.array([i in (2, 3) for i in range(n)]),
                             pa.array([1_700_000_000] * n)], list(Q.WRITTEN))
    done = [b.column(0).to_pylist() for b in Q._writer(str(tmp_path))(iter([batch]))]
    assert done == [[Q.TEXTS_AT_ONCE], [Q.TEXTS_AT_ONCE], [2]]
    got = {p.name: p.read_bytes() for p in (tmp_path / "a b").iterdir()}
    assert len(got) == n and got["0.txt"] == b"" and got["1.CSV"] == '"say ""é"""\n'.encode()
    assert got["2.txt"] == 'say "é"'.encode() + b"\xff" and got["3.CSV"] == b'"say ""\xc3\xa9""\n'
    assert os.stat(tmp_path / "a b" / "4.txt").st_mtime == 1_700_000_000
