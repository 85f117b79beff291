"""Giant texts, repeated scans, event time, live runs, stored indexes, stored runs, long exclusion lists."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from piisift.functions.types import BUILTIN_DETECTORS, Detector
from piisift.operators import browse, history, ledger, ranked, versions
from piisift.operators.detect import scan
from piisift.operators.pieces import piece_pattern, pieces, scan_long
from piisift.sources import changes as C
from piisift.sources import paths as P
from piisift.sources.files import list_files
from piisift.streaming import runs as R

VALUES = ["4111 1111 1111 1111", "4111111111111111", "2341-2341-2346", "2341 2341 2346", "ABCPK1234L", "A1234567", "MH 12 2011 1234567",
          "ABC1234567", "123456789012", "HDFC0123456", "user.x@ybl", "+91 9876543210", "91-9876543210", "a.b+c@mail-server.example.com"]


def _rows(df):
    return sorted(map(tuple, df.drop("scan_ts").collect()), key=repr)


def test_pieces_find_what_a_whole_scan_finds(spark):
    rnd = random.Random(1)
    seps = [" ", "  ", "\n", ", ", ".", "-", "é", "; ", "(", "\t", " x ", "_", "@", "+91", " ", ":"]
    texts = ["".join(rnd.choice(VALUES) + rnd.choice(seps) for _ in range(rnd.randrange(1, 80))) for _ in range(90)]
    df = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)] + [(99, None), (98, "")], "doc_id long, text string")
    want = _rows(scan(df, "text", ["doc_id"]))
    for chars in (1, 40):
        assert _rows(scan_long(df, "text", ["doc_id"], chars=chars, long_chars=50)) == want
    assert want


def test_pieces_make_up_the_text_and_user_patterns_stay_whole(spark):
    text = " ".join(f"{i}, abc" for i in range(3000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    cut = pieces(df, "text", 500)
    parts = [r["__text"] for r in cut.orderBy("__piece").collect()]
    assert "".join(parts) == text and len(parts) > 20 and cut.rdd.getNumPartitions() > 1
    across = Detector("ACROSS", r"(?s)0, abc 1,.*2999", "MEDIUM")
    found = scan_long(df, "text", ["doc_id"], detectors=[*BUILTIN_DETECTORS, across], types=["ACROSS", "EMAIL"], chars=500, long_chars=1000)
    assert [r["data_type"] for r in found.collect()] == ["ACROSS"]
    custom = {"EMAIL": r"abc 1, abc"}
    assert _rows(scan_long(df, "text", ["doc_id"], custom_patterns=custom, chars=10, long_chars=100)) == _rows(scan(df, "text", ["doc_id"], custom_patterns=custom))


def test_a_text_of_ten_megabytes_on_many_tasks(spark):
    body = ("filler words, and more of them; " * 40 + "card 4111 1111 1111 1111 ") * 7800
    df = spark.createDataFrame([(1, body)], "doc_id long, text string")
    assert len(body) > 10_000_000
    cut = pieces(df, "text")
    tasks = [n for n in cut.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()]
    assert len(tasks) > 1
    got = scan_long(df, "text", ["doc_id"]).groupBy("data_type").agg(F.count("*").alias("n"), F.max("match_idx").alias("m")).collect()
    want = scan(df, "text", ["doc_id"]).groupBy("data_type").agg(F.count("*").alias("n"), F.max("match_idx").alias("m")).collect()
    assert sorted(got) == sorted(want) and want


def test_a_text_without_a_cut_stays_whole(spark):
    df = spark.createDataFrame([(1, "a" * 5000 + "@bank")], "doc_id long, text string")
    assert pieces(df, "text", 100).count() == 1
    assert piece_pattern(5).startswith("(?s).{5}")


def test_scheduled_scan_of_files(spark, tmp_path):
    """Real files: one changed in place, one gone, one new; only two are read again."""
    root, base, read = tmp_path / "in", str(tmp_path / "store"), []
    root.mkdir()
    for name in ("a", "b", "c"):
        (root / f"{name}.txt").write_text(f"mail {name}@mail.example.com")

    def scan_paths(files):
        paths = [r["path"] for r in files.select("path").collect()]
        read.append(sorted(p[-5] for p in paths))
        texts = spark.createDataFrame([(p, open(p).read()) for p in paths] or [("", "")], "path string, text string")
        return scan(texts, "text", ["path"]).drop("scan_ts").filter("data_type = 'EMAIL'")

    def run():
        return C.scheduled_scan(spark, list_files(spark, [str(root)]), base, scan_paths)

    assert run() == {"added": 3}
    time.sleep(1.1)
    (root / "a.txt").write_text("mail z@mail.example.com and y@mail.example.com")
    (root / "b.txt").unlink()
    (root / "d.txt").write_text("nothing")
    assert run() == {"changed": 1, "deleted": 1, "added": 1, "same": 1}
    found = {(r["path"][-5], r["match_idx"], r["scanned_in"]) for r in C.current_findings(spark, base).collect()}
    assert found == {("a", 0, 2), ("a", 1, 2), ("c", 0, 1)}
    assert run() == {"same": 3} and read == [["a", "b", "c"], ["a", "d"], []]


def test_a_scan_that_fails_leaves_the_state_before(spark, tmp_path):
    files = spark.createDataFrame([("p", 1, None)], C.LISTING)
    base = str(tmp_path / "s")
    C.scheduled_scan(spark, files, base, lambda f: f.select("path"))
    more = files.unionByName(spark.createDataFrame([("q", 2, None)], C.LISTING))
    with pytest.raises(RuntimeError):
        C.scheduled_scan(spark, more, base, lambda f: (_ for _ in ()).throw(RuntimeError("lost")))
    assert [r["path"] for r in C.current_findings(spark, base).collect()] == ["p"]
    with pytest.raises(FileNotFoundError):
        C.current_findings(spark, str(tmp_path / "none"))


def test_manifest_is_switched_by_one_writer(spark, tmp_path):
    base = str(tmp_path / "t")
    assert versions.current(spark, base) == (0, {})
    assert versions.publish(spark, base, 0, {"a": 1}) == 1
    with pytest.raises(versions.Conflict):
        versions.publish(spark, base, 0, {"a": 2})
    assert versions.current(spark, base) == (1, {"a": 1})


def test_runs_sent_again_are_stored_once(spark, tmp_path):
    base, schema = str(tmp_path / "runs"), "run_id string, n int, seq long"

    def send(*rows):
        ledger.upsert(spark.createDataFrame(list(rows), schema), base, buckets=4)
        return {r["run_id"]: r["n"] for r in ledger.read(spark, base, spark.createDataFrame([], schema).schema).collect()}

    assert send(("a", 1, 1), ("b", 1, 1), ("a", 2, 2), (None, 5, 1)) == {"a": 2, "b": 1, None: 5}
    assert send(("a", 1, 1), ("b", 1, 1), (None, 5, 1)) == {"a": 2, "b": 1, None: 5}
    before = ledger.read(spark, base, spark.createDataFrame([], schema).schema)  # a reader of the state as it is now
    assert send(("b", 9, 3), ("c", 1, 1)) == {"a": 2, "b": 9, "c": 1, None: 5}
    assert {r["run_id"]: r["n"] for r in before.collect()} == {"a": 2, "b": 1, None: 5}
    for i in range(3):
        send((f"x{i}", i, 1))
    _n, state = versions.current(spark, base)
    assert len(state["paths"]) <= 4  # six batches, a folder per bucket


def test_a_writer_that_lost_merges_again(spark, tmp_path, monkeypatch):
    base, schema = str(tmp_path / "runs"), "run_id string, n int, seq long"
    real, first = versions.publish, [True]

    def publish(s, b, after, state):
        if first.pop() if first else False:
            ledger.upsert(spark.createDataFrame([("other", 7, 1)], schema), base, buckets=2)
        return real(s, b, after, state)

    monkeypatch.setattr(versions, "publish", publish)
    ledger.upsert(spark.createDataFrame([("mine", 1, 1)], schema), base, buckets=2)
    got = {r["run_id"] for r in ledger.read(spark, base, spark.createDataFrame([], schema).schema).collect()}
    assert got == {"mine", "other"}


def _findings(spark, n):
    rows = [(i // 3, f"doc-{i // 3}.txt", f"/data/Src {i % 5}/doc-{i // 3}.txt", "EMAIL" if i % 2 else "PHONE_NUMBER", "NORMAL", i % 3,
             f"***{i}") for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, file_name string, file_path string, data_type string, risk_level string, match_idx long, masked_value string")


def test_pages_of_a_stored_order(spark, tmp_path):
    f = _findings(spark, 237)
    folder = ranked.build(f.repartition(5), str(tmp_path))
    whole = [tuple(r)[:7] for r in browse.newest_first(f).collect()]
    for p in (1, 2, 13, 24, 99, 0):
        rows = ranked.page(spark, folder, p).orderBy("pos").collect()
        at = min(max(1, p), 24)
        assert [tuple(r)[:7] for r in rows] == whole[(at - 1) * 10:at * 10]
        assert all(r["page"] == at and r["total"] == 237 for r in rows) and rows[0]["pos"] == (at - 1) * 10 + 1
    plan = ranked.page(spark, folder, 13)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*part#", plan) and "Sort" not in plan and "Exchange" not in plan


def test_page_of_nothing(spark, tmp_path):
    folder = ranked.build(_findings(spark, 1).limit(0), str(tmp_path))
    assert ranked.page(spark, folder, 3).collect() == []
    ranked.build_search(spark, folder)
    assert ranked.search(spark, folder, "doc").collect() == ranked.search(spark, folder, "d").collect() == []


def test_search_by_posting_lists(spark, tmp_path):
    f = _findings(spark, 200)
    folder = ranked.build(f, str(tmp_path))
    ranked.build_search(spark, folder, chunk_rows=16)  # many short lists
    for term in ("doc-1", "SRC 3", "***19", "9", "t", "xt", "nothing here", "", None, "doc-1.txt *", "/data/src 0/doc-65.txt ***195"):
        assert _rows(ranked.search(spark, folder, term)) == _rows(browse.search(f, term)), term
    plan = ranked._lists(spark, folder, ["doc"], ranked.GRAM_BUCKETS)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#", plan)


def test_five_thousand_exclusions(spark):
    rnd = random.Random(4)
    rows = [("/data", f"/data/{rnd.randrange(40)}/{rnd.randrange(200)}/f{i}.txt") for i in range(4000)]
    rows += [("/data/1", "/data/1/x.txt"), ("/", "/x.txt"), ("/data", "/data/skipper/f"), ("/data/3/", "/data/3/7/9/f")]
    excluded = [f"/data/{a}/{b}" + rnd.choice(["", "/", "//"]) for a in range(40) for b in range(0, 200, 2)][:4990]
    excluded += ["/data/1", "/data/skip", "/data/3", "/", "/data", "relative"][:4]
    listing = spark.createDataFrame(rows, "root string, path string")
    got = P.exclude_paths(listing, spark.createDataFrame([(p,) for p in excluded], "path string"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    gone = {p.rstrip("/") or "/" for p in excluded}

    def keeps(root, path):
        d = path.rsplit("/", 1)[0]
        above = {"/".join(d.split("/")[:i + 1]) for i in range(1, len(d.split("/")))}
        return d == root.rstrip("/") or not (above & gone)

    assert sorted(map(tuple, got.collect())) == sorted(r for r in rows if keeps(*r))
    few = [p.rstrip("/") for p in excluded[:20]] + ["/data/skip", "/data/3"]
    by_rule = listing.filter(P.excluded_path_ok(F.col("path"), F.col("root"), few))
    by_join = P.exclude_paths(listing, spark.createDataFrame([(p,) for p in few], "path string"))
    assert sorted(map(tuple, by_rule.collect())) == sorted(map(tuple, by_join.collect()))


def test_attributes_of_one_folder_are_read_by_many_tasks(spark, tmp_path):
    for i in range(300):
        (tmp_path / f"f{i}.txt").write_text("x" * i)
    (tmp_path / "broken.txt").symlink_to(tmp_path / "nowhere")
    got = list_files(spark, [str(tmp_path)], files_per_task=50)
    assert got.filter("problem is null").agg(F.sum("size_bytes")).first()[0] == sum(range(300))
    assert got.filter("problem is not null").count() == 1
    assert got.select(F.spark_partition_id()).distinct().count() > 1


def test_running_flag(spark):
    rows = [("a", "RUNNING", 1), ("b", "RUNNING", 2), ("c", "COMPLETED", 3)]
    df = spark.createDataFrame(rows, "run_id string, status string, seq long")
    assert tuple(history.running(df).first()) == (True, "b")
    assert tuple(history.running(df.filter("status <> 'RUNNING'")).first()) == (False, None)
    assert tuple(history.running(df.limit(0)).first()) == (False, None)


def test_silent_run_fails_by_timer_and_a_late_end_counts(spark, tmp_path):
    schema = "run_id string, seq long, event string, at timestamp, scan_path string, report_path string"

    def deliver(*rows):
        df = spark.createDataFrame([], schema).unionByName(spark.createDataFrame(
            [(a, b, c, str(d)) for a, b, c, d in rows], "run_id string, seq long, event string, at string").select(
                "run_id", "seq", "event", F.col("at").cast("timestamp").alias("at"), F.lit("/p").alias("scan_path"),
                F.lit("r.csv").alias("report_path")))
        df.write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        R.start_changes_sink(R.run_changes(stream, 3_600_500, "1 minute"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
        now = R.states_now(spark.read.parquet(f"{tmp_path}/out")).collect()
        return {r["run_id"]: (r["status"], None if r["end_time"] is None else str(r["end_time"])[:19], r["report_path"]) for r in now}

    day = "2024-01-01 "
    first = deliver(("a", 1, "started", day + "10:00:00"), ("b", 1, "started", day + "10:10:00"), ("b", 2, "finished", day + "10:20:00"))
    assert first == {"a": ("RUNNING", None, None), "b": ("COMPLETED", day + "10:20:00", "r.csv")}
    second = deliver(("c", 1, "started", day + "12:00:00"), ("d", 2, "failed", day + "12:00:00"))
    assert second["a"] == ("FAILED", day + "11:00:00", None) and second["c"][0] == "RUNNING" and second["d"][0] == "FAILED"
    third = deliver(("a", 2, "finished", day + "12:05:00"))
    assert third["a"] == ("COMPLETED", day + "12:05:00", "r.csv") and third["c"][0] == "RUNNING"


@pytest.mark.parametrize("name", ["user_plugins_found", "rescan_findings", "stream_windows", "run_states_live", "findings_giant_texts"])
def test_queries_have_rows(spark, name):
    import __spark_entry__ as entry
    rows = entry.queries()[name](spark, "/root/testdata/sf0.001").collect()
    assert rows
    if name == "user_plugins_found":
        assert any(r["rel_path"].endswith(".md") for r in rows)
    if name == "rescan_findings":
        assert {r["scanned_in"] for r in rows} == {1, 2}
