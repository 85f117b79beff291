"""Queries over giant texts, repeated scans, event time, live runs, stored indexes and stored runs.

Stand-in inputs are rows derived from the given tables (bundles of documents, two states of a folder, events with
text, runs over batches of files); each job then works as it would on any rows of that schema.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import masks
from ..functions.types import BUILTIN_DETECTORS, Detector
from ..operators import browse, history, ledger, ranked
from ..operators.detect import findings_per_row, scan
from ..operators.pieces import scan_long
from ..session import shared_dir
from ..sources import changes as C
from ..sources import paths as P
from ..sources.extract import extract_text
from ..streaming import runs as R
from ..streaming import windows as SW
from ..streaming.stream import start_findings_sink
from . import duck
from .registry import register
from .runs import _FIND_COLS, _SEQ_DESC, hist_sql, run_ctes, run_events, run_findings, state_as_of, stored_runs
from .sources_q import listed
from .tables import REC_TEXT, corpus, doc_files, read_table, with_ctes


def _fresh(spark: SparkSession, label: str) -> str:
    return shared_dir(spark, "upkeep", f"{label}-{uuid.uuid4().hex}")


# ---- F1 on giant texts: the corpus bound into files of 2,000 texts of a table --------------------
BUNDLE = 2000
_BUNDLES_SQL = (f"bundles as (select src, doc_id // {BUNDLE} as doc_id, string_agg(text, chr(10) order by doc_id) as text "
                f"from corpus group by src, doc_id // {BUNDLE})")


def bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = corpus(spark, sf_dir, balance=False).withColumn("bundle", F.floor(F.col("doc_id") / BUNDLE))
    rows = F.array_sort(F.collect_list(F.struct("doc_id", "text")))  # at most ``BUNDLE`` texts
    return texts.groupBy("src", F.col("bundle").alias("doc_id")).agg(
        F.array_join(F.transform(rows, lambda r: r["text"]), "\n").alias("text"))


@register("findings_giant_texts", with_ctes("", "corpus").rstrip("\n") + ",\n" + _BUNDLES_SQL + "\n" + duck.findings(rel="bundles"))
def findings_giant_texts(spark, sf_dir):
    """texts of megabytes, cut where no pattern can match across, scanned by many tasks."""
    found = scan_long(browse.stored(bundles(spark, sf_dir), "bundles"), "text", ["src", "doc_id"], long_chars=20_000, chars=16_384)
    return found.select("src", "doc_id", "data_type", "risk_level", "match_idx", "masked_value")


# ---- T1 as a scheduled scan: two states of the document folder ------------------------------------
# Every tenth file is not there at first, every tenth is gone later, every tenth is rewritten with a line more.
_LATER = "concat(text, chr(10), 'card 4111 1111 1111 1111 and mail new', cast(doc_id as {s}), '@mail.example.com')"


def folder_state(spark: SparkSession, sf_dir: str, later: bool) -> DataFrame:
    files = doc_files(spark, sf_dir, balance=False).filter(F.col("status") == "SCANNED")
    files = files.select("doc_id", "path", "size_bytes", "modified", "text")
    if not later:
        return files.filter(F.col("doc_id") % 10 != 0)
    rewritten = F.col("doc_id") % 10 == 2
    return files.filter(F.col("doc_id") % 10 != 1).select(
        "doc_id", "path", F.when(rewritten, F.col("size_bytes") + 1).otherwise(F.col("size_bytes")).alias("size_bytes"),
        F.when(rewritten, F.col("modified") + F.expr("INTERVAL 1 DAY")).otherwise(F.col("modified")).alias("modified"),
        F.when(rewritten, F.expr(_LATER.format(s="string"))).otherwise(F.col("text")).alias("text"))


_RESCAN_SQL = (
    "select path, data_type, risk_level, match_idx, masked_value, "
    "cast(case when doc_id % 10 in (0, 2) then 2 else 1 end as bigint) as scanned_in from ("
    + duck.findings(rel="(select path, doc_id, case when doc_id % 10 = 2 then " + _LATER.format(s="varchar") + " else text end as text "
                        "from doc_files where status = 'SCANNED' and doc_id % 10 <> 1) s", keys=("path", "doc_id")) + ") f")


@register("rescan_findings", with_ctes(_RESCAN_SQL, "doc_files"))
def rescan_findings(spark, sf_dir):
    """A second scheduled scan reads only new and changed files and retires findings of changed and deleted ones."""
    base = _fresh(spark, "rescan")
    for later in (False, True):
        C.scheduled_scan(spark, folder_state(spark, sf_dir, later), base, lambda files: scan(files, "text", ["path"]).drop("scan_ts"))
    return C.current_findings(spark, base).select("path", "data_type", "risk_level", "match_idx", "masked_value", "scanned_in")


@register("rescan_changes", with_ctes(
    "select path, case doc_id % 10 when 0 then 'added' when 1 then 'deleted' when 2 then 'changed' else 'same' end as change "
    "from doc_files where status = 'SCANNED'", "doc_files"))
def rescan_changes(spark, sf_dir):
    before, after = (C.listing_of(folder_state(spark, sf_dir, later)) for later in (False, True))
    return C.difference(before, after).select("path", "change")


# ---- §2.9 event-time windows: events that arrive in four deliveries, some a delivery late ---------
# Ten days each; every 40th event is one delivery late and is left out where its hour had closed by then.
DELAY = "2 days"
_DELIVERY = ("(case when dayofmonth(ts) <= 10 then 1 when dayofmonth(ts) <= 20 then 2 else 3 end) "
             "+ (case when event_id % 40 = 7 then 1 else 0 end)")
_EVENT_TEXT = "concat(props, ' ', " + REC_TEXT + ")"
_EVENTS_SQL = ("ev as (select event_id, ts, event_id as c_custkey, props, " + _DELIVERY + " as delivery from events),\n"
               "marks as (select delivery, max(max(ts)) over (order by delivery) - INTERVAL 2 DAY as mark from ev group by delivery),\n"
               "kept as (select e.*, date_trunc('hour', ts) as window_start, " + _EVENT_TEXT.format(s="varchar") + " as text from ev e "
               "left join marks m on m.delivery = e.delivery - 1 "
               "where m.mark is null or date_trunc('hour', ts) + INTERVAL 1 HOUR > m.mark)")


#: Events of a task: a file's size says little about them, as their texts are made here and compress well.
EVENTS_PER_TASK = 50_000


def event_tasks(spark: SparkSession, sf_dir: str) -> int:
    rows = read_table(spark, sf_dir, "events").count()
    return max(spark.sparkContext.defaultParallelism, -(-rows // EVENTS_PER_TASK))


def deliveries(spark: SparkSession, sf_dir: str, tasks: int | None = None) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    ev = ev.select("event_id", "ts", "props").repartition(tasks) if tasks else ev
    ev = ev.withColumn("c_custkey", F.col("event_id")).withColumn("delivery", F.expr(_DELIVERY))
    return ev.select("event_id", "ts", "delivery", F.expr(_EVENT_TEXT.format(s="string")).alias("text"))


@register("stream_windows", "with " + _EVENTS_SQL + "\nselect window_start, window_start + INTERVAL 1 HOUR as window_end, data_type, "
          "count(*) as findings from (" + duck.findings(rel="kept", keys=("window_start", "event_id")) + ") f "
          "where window_start + INTERVAL 1 HOUR <= (select max(mark) from marks) group by window_start, data_type")
def stream_windows(spark, sf_dir):
    """Findings per hour of event time and type, written once each hour closes."""
    base = _fresh(spark, "windows")
    tasks = event_tasks(spark, sf_dir)
    events = browse.stored(deliveries(spark, sf_dir, tasks), "deliveries")
    for n in range(1, 5):
        events.filter(F.col("delivery") == n).drop("delivery").write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(events.drop("delivery").schema).parquet(f"{base}/in")
        counts = SW.windowed_findings(stream, "ts", "text", "1 hour", DELAY, num_partitions=tasks)
        start_findings_sink(counts, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    out = spark.read.parquet(f"{base}/out")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"),
                      F.col("window_end").cast("timestamp_ntz").alias("window_end"), "data_type", "findings")


# ---- H4, H7 live: runs over batches of files of a folder (fifty ids each); some fail, some never end --------
SILENCE_MS = 7_200_500
_BATCHES_SQL = (
    "batches as (select 'run-' || scan_path || '-' || cast(doc_id // 50 as varchar) as run_id, scan_path, doc_id // 50 as n, "
    "min(modified) + INTERVAL 1 HOUR as start_time, max(modified) + INTERVAL 1 HOUR + INTERVAL 1 SECOND as end_time, "
    "count(*) as files_scanned from doc_files group by scan_path, doc_id // 50)")
_LIVE_SQL = (
    ",\nlive as (select *, n % 5 = 2 as fails, n % 7 = 3 as silent from batches),\n"
    "seen as (select start_time as t from live union all select end_time from live where not silent),\n"
    "mark as (select max(t) - INTERVAL 10 MINUTE as m from seen)\n"
    "select run_id, case when silent then (case when epoch_ms(start_time) + " + str(SILENCE_MS) + " < epoch_ms(m) then 'FAILED' else 'RUNNING' end) "
    "when fails then 'FAILED' else 'COMPLETED' end as status, start_time, "
    "case when not silent then end_time when epoch_ms(start_time) + " + str(SILENCE_MS) + " < epoch_ms(m) "
    "then make_timestamp((epoch_ms(start_time) + " + str(SILENCE_MS) + ") * 1000) end as end_time, scan_path, "
    "case when not silent and not fails then 'reports/' || run_id || '.csv' end as report_path from live, mark")


def batch_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = doc_files(spark, sf_dir, balance=False).withColumn("n", F.floor(F.col("doc_id") / 50))
    run_id = F.concat(F.lit("run-"), "scan_path", F.lit("-"), F.col("n").cast("string"))
    return files.groupBy("scan_path", "n").agg(
        (F.min("modified") + F.expr("INTERVAL 1 HOUR")).alias("start_time"),
        (F.max("modified") + F.expr("INTERVAL 1 HOUR") + F.expr("INTERVAL 1 SECOND")).alias("end_time"),
        F.count("*").alias("files_scanned")).withColumn("run_id", run_id)


def live_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = batch_runs(spark, sf_dir).withColumn("report_path", F.concat(F.lit("reports/"), "run_id", F.lit(".csv")))
    ev = run_events(r).withColumn("n", F.substring_index("run_id", "-", -1).cast("long"))
    ended = F.col("event") == "finished"
    ev = ev.filter(~(ended & (F.col("n") % 7 == 3)))
    return ev.withColumn("event", F.when(ended & (F.col("n") % 5 == 2), "failed").otherwise(F.col("event"))).drop("n")


@register("run_states_live", with_ctes("", "doc_files").rstrip("\n") + ",\n" + _BATCHES_SQL + _LIVE_SQL)
def run_states_live(spark, sf_dir):
    """H4, H7: the state of every run once all events have arrived, in two deliveries; silent runs failed by timer."""
    base = _fresh(spark, "live")
    events = browse.stored(live_events(spark, sf_dir), "run-events")
    half = events.agg((F.unix_seconds(F.min("at").cast("timestamp")) + F.unix_seconds(F.max("at").cast("timestamp"))) / 2).first()[0]
    early = F.unix_seconds(F.col("at").cast("timestamp")) <= F.lit(half)
    for mine in (early, ~early):
        events.filter(mine).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(events.schema).parquet(f"{base}/in")
        R.start_changes_sink(R.run_changes(stream, SILENCE_MS), f"{base}/out", f"{base}/checkpoint").awaitTermination()
    now = R.states_now(spark.read.parquet(f"{base}/out"))
    return now.select("run_id", "status", F.col("start_time").cast("timestamp_ntz").alias("start_time"),
                      F.col("end_time").cast("timestamp_ntz").alias("end_time"), "scan_path", "report_path")


# ---- H4: the flag while runs run and when none does -----------------------------------------------
@register("history_running", hist_sql(
    "select 'first end' as moment, bool_or(status = 'RUNNING') as any_running, "
    "max_by(run_id, start_time) filter (where status = 'RUNNING') as run_id from folded "
    "union all select 'last end', false, null"))
def history_running(spark, sf_dir):
    r = stored_runs(spark, sf_dir)
    done = history.fold_events(run_events(r)).withColumn("seq", F.unix_micros(F.col("start_time").cast("timestamp")))
    out = [history.running(rows).select(F.lit(moment).alias("moment"), "any_running", "run_id")
           for moment, rows in (("first end", state_as_of(r)), ("last end", done))]
    return out[0].unionByName(out[1])


# ---- Q5, Q6: pages of a stored order; Q4: search by posting lists ----------------------------------
PAGES = (1, 21, 10**9)


def _page_no(p: int) -> str:
    return f"least({p}, greatest(1, cast(ceil(total / {browse.PAGE_SIZE}.0) as bigint)))"


@register("findings_indexed_pages", run_ctes(" union ".join(
    f"select {_FIND_COLS}, pos, cast({_page_no(p)} as integer) as page, total from (select *, "
    f"row_number() over (order by {_SEQ_DESC}) as pos, count(*) over () as total from run_findings) x "
    f"where pos > ({_page_no(p)} - 1) * {browse.PAGE_SIZE} and pos <= {_page_no(p)} * {browse.PAGE_SIZE}" for p in PAGES), "run_findings"))
def findings_indexed_pages(spark, sf_dir):
    """Q6: the first page, one far down and the last, from one stored order."""
    folder = ranked.build(run_findings(spark, sf_dir), _fresh(spark, "pages"))
    out = None
    for p in PAGES:
        one = ranked.page(spark, folder, p)
        out = one if out is None else out.unionByName(one)
    return out.distinct()  # a page number beyond the end is the last page


TERMS = ("Doc-1", "*9", "/src", "EXAMPLE.com", "x", "no such text")


@register("findings_indexed_search", run_ctes(" union all ".join(
    f"select {duck.q(t)} as term, {_FIND_COLS} from run_findings where contains(lower(concat_ws(' ', file_name, file_path, masked_value)), "
    f"{duck.q(t.lower())})" for t in TERMS), "run_findings"))
def findings_indexed_search(spark, sf_dir):
    """Q4: six terms, short ones too, by posting lists of three letters."""
    folder = ranked.build(run_findings(spark, sf_dir), _fresh(spark, "search"))
    ranked.build_search(spark, folder)
    out = None
    for t in TERMS:
        one = ranked.search(spark, folder, t).select(F.lit(t).alias("term"), *_FIND_COLS.split(", "))
        out = one if out is None else out.unionByName(one)
    return out


# ---- H1, H3, H8: runs reported in three batches, some again ------------------------------------------
@register("history_upsert", with_ctes("", "doc_files").rstrip("\n") + ",\n" + _BATCHES_SQL +
          "\nselect run_id, scan_path, start_time, end_time, case when n % 3 = 0 then files_scanned + 100 else files_scanned end as files_scanned, "
          "cast(case when n % 3 = 0 then 2 else 1 end as bigint) as seq from batches")
def history_upsert(spark, sf_dir):
    """Runs sent again: a newer state replaces the stored one, an old one sent again changes nothing."""
    base = _fresh(spark, "ledger")
    runs = browse.stored(batch_runs(spark, sf_dir), "batch-runs")
    cols = ["run_id", "scan_path", "start_time", "end_time", "files_scanned", "seq"]

    def sent(rows: DataFrame, more: int, seq: int) -> DataFrame:
        return rows.withColumn("files_scanned", F.col("files_scanned") + more).withColumn("seq", F.lit(seq).cast("long")).select(*cols)

    for batch in (sent(runs, 0, 1), sent(runs.filter("n % 3 = 0"), 100, 2), sent(runs.filter("n % 2 = 0"), -1, 1)):
        ledger.upsert(batch, base)
    return ledger.read(spark, base, sent(runs, 0, 1).schema)


# ---- S4 with many exclusions: every third folder of eight files ----------------------------------------
_TREE_SQL = ("tree as (select '/data' as root, '/data/' || source || '/' || lang || '/' || cast(doc_id // 8 as varchar) || '/doc-' "
             "|| cast(doc_id as varchar) || '.txt' as path, doc_id from documents)")


def folder_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    n = F.floor(F.col("doc_id") / 8)
    path = F.concat_ws("/", F.lit("/data"), "source", "lang", n.cast("string"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt")))
    return docs.select(F.lit("/data").alias("root"), path.alias("path"), n.alias("n"))


@register("paths_excluded_many", "with " + _TREE_SQL + " select root, path from tree where doc_id // 8 % 3 <> 0")
def paths_excluded_many(spark, sf_dir):
    """As many excluded folders as the table has thirds of folders, by a join on the folders' ancestors."""
    tree = folder_tree(spark, sf_dir)
    excluded = tree.filter("n % 3 = 0").select(F.concat(P.dir_of(F.col("path")), F.lit("/")).alias("path")).distinct()
    return P.exclude_paths(tree.drop("n"), excluded)


# ---- U1, U2 on texts that hold what the user looks for ----------------------------------------------------
_STAFF_CODE = r"\b[A-Z][a-z]{5}\b"


@register("user_plugins_found", with_ctes(
    "select rel_path, data_type, risk_level, match_idx, masked_value from ("
    "select scan_path || '/' || file_name as rel_path, 'STAFF_CODE' as data_type, 'MEDIUM' as risk_level, "
    "cast(m.i as bigint) as match_idx, " + duck.mask_last4("m.v") + " as masked_value from (select scan_path, file_name, "
    f"unnest(list_transform(regexp_extract_all(text, {duck.q(_STAFF_CODE)}), lambda x, i: {{'v': x, 'i': i - 1}})) as m "
    "from doc_files where status <> 'ERROR') t) f", "doc_files"))
def user_plugins_found(spark, sf_dir):
    """A user's type (a capital and five letters), and a user's extractor that opens notes (.md)."""
    code = Detector("STAFF_CODE", r"(?<!\w)[A-Z][a-z]{5}(?!\w)", "MEDIUM", "Staff code", mask=masks.mask_last4)
    files = extract_text(listed(spark, sf_dir), extractors={"md": lambda data: data.decode("utf-8")},
                         supported_extensions=(*P.SUPPORTED_EXTENSIONS, "md"))
    rows = findings_per_row(files, "text", types=["STAFF_CODE"], detectors=[*BUILTIN_DETECTORS, code],
                            only_if=F.col("status") == "SCANNED")
    return rows.select("rel_path", F.inline("findings")).select("rel_path", "data_type", "risk_level", "match_idx", "masked_value")
