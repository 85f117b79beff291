"""Queries over files and paths: selection predicates, listing, extraction.

``path_variants`` places every document file in seven spots of a tree under
'/data' (plain, hidden folder, excluded folder name, excluded prefix, a
look-alike prefix, the root itself, a hidden file), so each rule of the
selection has rows to keep and rows to drop.  ``materialized_root`` writes
the document files to the shared folder once, for the lister and extractors.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from typing import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import masks
from ..functions.types import BUILTIN_DETECTORS, Detector
from ..operators.detect import findings_per_row
from ..operators import summary
from ..session import shared_dir
from ..sources import paths as P
from ..sources.extract import extract_content, extract_text
from ..sources.files import balance, list_files
from . import duck
from .registry import register
from .tables import DAMAGED, FILE_EXT, _path, doc_files, read_table, with_ctes

ROOT = "/data"
EXCLUDED_PREFIX = ["/data/skip"]
TYPE_FILTERS = [".TXT", "Csv"]


def path_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = doc_files(spark, sf_dir, balance=False).select("scan_path", "file_name")
    s, n = F.col("scan_path"), F.col("file_name")
    spots = F.array(
        F.concat_ws("/", F.lit(ROOT), s, n), F.concat_ws("/", F.lit(ROOT), s, F.lit(".hidden"), n),
        F.concat_ws("/", F.lit(ROOT), s, F.lit("Node_Modules"), F.lit("x"), n),
        F.concat_ws("/", F.lit(ROOT), F.lit("skip"), s, n), F.concat_ws("/", F.lit(ROOT), F.lit("skipper"), s, n),
        F.concat_ws("/", F.lit(ROOT), n), F.concat_ws("/", F.lit(ROOT), F.concat(F.lit("."), n)))
    return f.select(F.lit(ROOT).alias("root"), F.explode(spots).alias("path"))


_VARIANTS_SQL = (
    "select '/data' as root, unnest(["
    "'/data/' || scan_path || '/' || file_name, '/data/' || scan_path || '/.hidden/' || file_name, "
    "'/data/' || scan_path || '/Node_Modules/x/' || file_name, '/data/skip/' || scan_path || '/' || file_name, "
    "'/data/skipper/' || scan_path || '/' || file_name, '/data/' || file_name, '/data/.' || file_name]) as path "
    "from doc_files")


def _paths_sql(where: str, extra_cols: str = "") -> str:
    body = (f"select path{extra_cols} from (select *, string_split(substr(path, 7), '/') as parts, "
            "regexp_replace(path, '/[^/]*$', '') as dir, regexp_extract(path, '[^/]*$') as fname "
            f"from variants) v where {where}")
    return with_ctes("", "doc_files").rstrip("\n") + f",\nvariants as ({_VARIANTS_SQL})\n" + body


_EXT_SQL = ("case when contains(fname, '.') then lower(regexp_extract(fname, '\\.([^.]*)$', 1)) else '' end")
_DIR_PARTS = "list_slice(parts, 1, len(parts) - 1)"


def _select(spark, sf_dir, options: P.ScanOptions, config: P.ScanConfig) -> DataFrame:
    return P.select_files(path_variants(spark, sf_dir), options, config).select("path")


_NO_EXCL = P.ScanConfig(excluded_paths=(), excluded_folder_names=())


@register("paths_hidden", _paths_sql("len(list_filter(parts, lambda x: starts_with(x, '.'))) = 0"))
def paths_hidden(spark, sf_dir):
    return _select(spark, sf_dir, P.ScanOptions(include_hidden_files=False), _NO_EXCL)


@register("paths_excluded_prefix", _paths_sql(
    "dir = '/data' or not (dir = '/data/skip' or starts_with(dir, '/data/skip/'))"))
def paths_excluded_prefix(spark, sf_dir):
    return _select(spark, sf_dir, P.ScanOptions(),
                   P.ScanConfig(excluded_paths=EXCLUDED_PREFIX, excluded_folder_names=()))


_NAMES_SQL = ", ".join(duck.q(x.lower()) for x in P.EXCLUDED_FOLDER_NAMES)


@register("paths_excluded_name", _paths_sql(
    f"len(list_filter({_DIR_PARTS}, lambda x: lower(x) in ({_NAMES_SQL}))) = 0"))
def paths_excluded_name(spark, sf_dir):
    return _select(spark, sf_dir, P.ScanOptions(), P.ScanConfig(excluded_paths=()))


@register("paths_depth", _paths_sql("len(parts) = 1"))
def paths_depth(spark, sf_dir):
    return _select(spark, sf_dir, P.ScanOptions(recursive=False), _NO_EXCL)


@register("paths_extension", _paths_sql("true", f", {_EXT_SQL} as extension"))
def paths_extension(spark, sf_dir):
    v = path_variants(spark, sf_dir)
    return v.select("path", P.extension_of(P.file_name_of(F.col("path"))).alias("extension"))


@register("paths_type_filter", _paths_sql(f"{_EXT_SQL} in ('txt', 'csv')"))
def paths_type_filter(spark, sf_dir):
    return _select(spark, sf_dir, P.ScanOptions(file_type_filters=TYPE_FILTERS), _NO_EXCL)


# ---- real files -------------------------------------------------------------------
def csv_record(text: str) -> str:
    """The text as one CSV record of one quoted cell."""
    return '"' + text.replace('"', '""') + '"\n'


WRITTEN = ("scan_path", "file_name", "text", "damaged", "modified_s")
#: Texts that a task holds as strings at once, of the many of a batch.
TEXTS_AT_ONCE = 64


def _writer(root: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (b.slice(at, TEXTS_AT_ONCE) for b in batches for at in range(0, b.num_rows, TEXTS_AT_ONCE)):
            n = 0
            for folder, name, text, damaged, at in zip(*(part.column(c).to_pylist() for c in WRITTEN)):
                d = os.path.join(root, folder)
                os.makedirs(d, exist_ok=True)
                table = name.lower().endswith(".csv")
                data = (csv_record(text or "") if table else (text or "")).encode("utf-8")
                if damaged:  # an open quote, or a byte that is not UTF-8
                    data = data[:-2] + b"\n" if table else data + b"\xff"
                p = os.path.join(d, name)
                tmp = f"{p}.{uuid.uuid4().hex}.part"
                with open(tmp, "wb") as fh:
                    fh.write(data)
                os.utime(tmp, (at, at))
                os.replace(tmp, p)
                n += 1
            yield pa.record_batch([pa.array([n], pa.int64())], ["n"])
    return run


def materialized_root(spark: SparkSession, sf_dir: str) -> str:
    """documents written as files under the shared folder (once per table):
    .txt/.TXT/.md hold the text, .csv one quoted cell with the text, so the
    extracted text of every scanned file is known in SQL."""
    base = shared_dir(spark, "doc-files-v3", table_version(spark, _path(sf_dir, "documents")))
    if "://" in base and not base.startswith("file://"):
        raise ValueError(f"file queries need a mounted shared folder, not {base}")
    base = base.replace("file://", "", 1).replace("file:", "", 1)
    done = base + "/written"
    if not os.path.exists(done):
        root = f"{base}/{uuid.uuid4().hex}"  # always a fresh folder; the marker names the whole one
        files = doc_files(spark, sf_dir).select(
            "scan_path", "file_name", "text", "damaged",
            F.unix_seconds(F.col("modified").cast("timestamp")).alias("modified_s"))
        files.mapInArrow(_writer(root), "n long").agg(F.sum("n")).collect()
        os.makedirs(root, exist_ok=True)
        with open(f"{done}.{os.path.basename(root)}", "w") as fh:
            fh.write(root)
        os.replace(f"{done}.{os.path.basename(root)}", done)
    with open(done) as fh:
        return fh.read()


def table_version(spark: SparkSession, path: str) -> str:
    """A name for the table's state: its full path and its files with lengths and times."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    parts = [fs.makeQualified(place).toString()]
    for f in fs.listStatus(place):
        parts.append(f"{f.getPath().getName()}:{f.getLen()}:{f.getModificationTime()}")
    return hashlib.sha256("\n".join([parts[0], *sorted(parts[1:]), FILE_EXT, DAMAGED]).encode()).hexdigest()[:32]


def listed(spark, sf_dir) -> DataFrame:
    # spread: a folder of a third of all files is read by all tasks
    return balance(list_files(spark, [materialized_root(spark, sf_dir)]))


_IS_CSV = "extension = 'csv'"
_FILE_BYTES = (f"case when {_IS_CSV} then cast(strlen('\"' || replace(text, '\"', '\"\"') || '\"') + 1 as bigint) "
               "else size_bytes end + case when damaged then case when " + _IS_CSV + " then -1 else 1 end else 0 end")


@register("files_listing", with_ctes(
    f"select scan_path || '/' || file_name as rel_path, file_name, extension, {_FILE_BYTES} as size_bytes "
    "from doc_files", "doc_files"))
def files_listing(spark, sf_dir):
    return listed(spark, sf_dir).select("rel_path", "file_name", "extension", "size_bytes")


@register("extract_txt", with_ctes(
    "select scan_path || '/' || file_name as rel_path, status, "
    "case when status = 'SCANNED' then sha256(text) end as text_sha256 from doc_files where extension = 'txt'",
    "doc_files"))
def extract_txt(spark, sf_dir):
    f = extract_text(listed(spark, sf_dir).filter(F.col("extension") == "txt"))
    return f.select("rel_path", "status", F.sha2("text", 256).alias("text_sha256"))


_EXTRACTED = "case when extension = 'csv' then text || ' | ' || chr(10) else text end"


@register("extract_text", with_ctes(
    "select scan_path || '/' || file_name as rel_path, extension, status, status = 'ERROR' as has_error, "
    f"case when status = 'SCANNED' then sha256({_EXTRACTED}) end as text_sha256 from doc_files", "doc_files"))
def extract_text_all(spark, sf_dir):
    f = extract_text(listed(spark, sf_dir))
    return f.select("rel_path", "extension", "status", F.col("error").isNotNull().alias("has_error"),
                    F.sha2("text", 256).alias("text_sha256"))


# E3 on long cells: each benchmark passage repeated to a cell of over 131,072 characters, a card at its end
LONG_CELL = 140_000
_CELL = "repeat(text || ', ', cast(floor({n} / (length(text) + 2)) as {int}) + 1) || ' 4111111111111111'"


@register("csv_long_cell", (
    "select item_id, 'SCANNED' as status, sha256(cell || ' | x | ' || chr(10)) as text_sha256, 1 as n_cards "
    f"from (select item_id, {_CELL.format(n=LONG_CELL, int='bigint')} as cell from benchmark)"))
def csv_long_cell(spark, sf_dir):
    cell = F.expr(_CELL.format(n=LONG_CELL, int="int"))
    quoted = F.concat(F.lit('"'), F.replace(cell, F.lit('"'), F.lit('""')), F.lit('",x\n'))
    files = read_table(spark, sf_dir, "benchmark").select(
        "item_id", F.lit("csv").alias("extension"), F.encode(quoted, "utf-8").alias("content"))
    found = findings_per_row(extract_content(files), "text", types=["CARD_NUMBER"])
    return found.select("item_id", "status", F.sha2("text", 256).alias("text_sha256"),
                        F.size("findings").alias("n_cards"))


_SCANNED_DOCS = "(select * from doc_files where status = 'SCANNED') s"


@register("files_findings", with_ctes(
    "select f.folder, coalesce(k.critical, 0) as critical, coalesce(k.medium, 0) as medium, "
    "coalesce(k.normal, 0) as normal, coalesce(k.total, 0) as total from "
    "(select distinct scan_path as folder from doc_files where status = 'SCANNED') f left join "
    "(select scan_path as folder, count(*) filter (where risk_level = 'CRITICAL') as critical, "
    "count(*) filter (where risk_level = 'MEDIUM') as medium, count(*) filter (where risk_level = 'NORMAL') "
    "as normal, count(*) as total from (" + duck.findings(rel=_SCANNED_DOCS, keys=("scan_path", "file_name"))
    + ") x group by scan_path) k using (folder)", "doc_files"))
def files_findings(spark, sf_dir):
    """End to end: list → extract → scan → counts by risk per folder."""
    f = extract_text(listed(spark, sf_dir)).filter(F.col("status") == "SCANNED")
    f = f.withColumn("folder", F.substring_index(F.col("rel_path"), "/", 1))
    # one extraction: each file's findings are counted in its own row
    rows = findings_per_row(f, "text").select("folder", *summary.row_risk_counts(F.col("findings")))
    return rows.groupBy("folder").agg(*summary.group_risk_counts()).drop("has_card")


@register("csv_row_text", with_ctes(
    "select c_custkey, concat(cast(c_custkey as varchar), ' | ', c_name, ' | ', cast(c_nationkey as varchar), ' | ', "
    "cast(c_acctbal as varchar), ' | ', c_mktsegment, ' | ') as text from customer"))
def csv_row_text(spark, sf_dir):
    """E3 on a table: every cell and ' | ', the row's text ready to scan."""
    cust = read_table(spark, sf_dir, "customer")
    return cust.select("c_custkey", row_text(cust, cust.columns).alias("text"))


def row_text(df: DataFrame, cols) -> "F.Column":
    """Cells of a tabular row as CSV-extracted text: 'cell | cell | '."""
    return F.concat(*[x for c in cols for x in (F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(" | "))])


@register("scan_run", with_ctes(
    "select scan_path || '/' || file_name as rel_path, data_type, risk_level, match_idx, masked_value from ("
    + duck.findings(rel=_SCANNED_DOCS, keys=("scan_path", "file_name")) + ") f", "doc_files"))
def scan_run(spark, sf_dir):
    """Entry A end to end: a scan request over the folder (all types, default
    options), planned by ``run_scan``; its findings as rows."""
    from ..operators.run import run_scan
    root = materialized_root(spark, sf_dir)
    run = run_scan(spark, [root], run_id="scan-run")
    rel = F.substring(F.col("file_path"), len(root.rstrip("/")) + 2, 1 << 30)
    return run.findings.select(rel.alias("rel_path"), "data_type", "risk_level", "match_idx", "masked_value")


# ---- S2, S7, S11: roots, links, times -----------------------------------------------
@register("files_missing_roots", with_ctes(
    "select scan_path || '/' || file_name as rel_path, cast(n as bigint) as n from doc_files, "
    "(select unnest([1, 1]) as n) two", "doc_files"))
def files_missing_roots(spark, sf_dir):
    """A missing root is skipped; overlapping roots list a file once each."""
    root = materialized_root(spark, sf_dir)
    got = list_files(spark, [root, root + "-missing", root + "/"])
    return got.select("rel_path", F.lit(1).cast("long").alias("n"))


def _linked_root(spark, sf_dir) -> str:
    """A folder that holds a link to the document files and a link back to itself."""
    root = materialized_root(spark, sf_dir)
    place = f"{os.path.dirname(root)}/links-{uuid.uuid4().hex}"
    os.makedirs(place)
    os.symlink(root, f"{place}/docs")
    os.symlink(place, f"{place}/again")
    return place


@register("files_links", with_ctes(
    "select 'docs/' || scan_path || '/' || file_name as rel_path, extension from doc_files", "doc_files"))
def files_links(spark, sf_dir):
    """Links to folders are followed on request, cycles are not; without the request there is nothing here."""
    place = _linked_root(spark, sf_dir)
    followed = list_files(spark, [place], P.ScanOptions(follow_symbolic_links=True))
    plain = list_files(spark, [place]).filter(F.col("extension") == "txt")
    return followed.unionByName(plain).select("rel_path", "extension")


@register("files_times", with_ctes(
    "select scan_path || '/' || file_name as rel_path, date_trunc('second', modified) as modified, "
    "date_trunc('second', modified) as created from doc_files", "doc_files"))
def files_times(spark, sf_dir):
    """Modified time of each file, and its creation time (the modified time where the system keeps none)."""
    got = listed(spark, sf_dir)
    return got.select("rel_path", "modified", "created")


# ---- U1, U2: a user's detector and extractor -------------------------------------------
_USER_PATTERN = r"\b(?:AKIA[A-Z0-9]{16})\b"


@register("user_plugins", with_ctes(
    "select rel_path, data_type, risk_level, match_idx, masked_value from ("
    "select scan_path || '/' || file_name as rel_path, 'ACCESS_KEY' as data_type, 'CRITICAL' as risk_level, "
    "cast(m.i as bigint) as match_idx, " + duck.mask_last4("m.v") + " as masked_value from (select scan_path, file_name, "
    f"unnest(list_transform(regexp_extract_all(text, {duck.q(_USER_PATTERN)}), lambda x, i: {{'v': x, 'i': i - 1}})) as m "
    "from doc_files where status <> 'ERROR') t) f", "doc_files"))
def user_plugins(spark, sf_dir):
    """A user's type among the detectors, and a user's extractor for notes (.md)."""
    key = Detector("ACCESS_KEY", _USER_PATTERN, "CRITICAL", "Access key", mask=masks.mask_last4)
    files = extract_text(listed(spark, sf_dir), extractors={"md": lambda data: data.decode("utf-8")},
                         supported_extensions=(*P.SUPPORTED_EXTENSIONS, "md"))
    rows = findings_per_row(files, "text", types=["ACCESS_KEY"], detectors=[*BUILTIN_DETECTORS, key],
                            only_if=F.col("status") == "SCANNED")
    return rows.select("rel_path", F.inline("findings")).select(
        "rel_path", "data_type", "risk_level", "match_idx", "masked_value")


# ---- D14: a pattern only Java reads; H4, H7: a run records its start and its end ---------
@register("custom_pattern_java", with_ctes(
    "select rel_path, data_type, match_idx, masked_value from (select scan_path || '/' || file_name as rel_path, "
    "'PAN_NUMBER' as data_type, cast(m.i as bigint) as match_idx, " + duck.mask_pan("m.v") + " as masked_value "
    "from (select scan_path, file_name, unnest(list_transform(regexp_extract_all(text, 'a\\.\\n[A-Z]'), "
    "lambda x, i: {'v': x, 'i': i - 1})) as m from doc_files where status = 'SCANNED') t) f", "doc_files"))
def custom_pattern_java(spark, sf_dir):
    r"""A whole request with a pattern in Java's own syntax: quoted text and a code point in hex."""
    from ..operators.run import run_scan
    root = materialized_root(spark, sf_dir)
    run = run_scan(spark, [root], types=["PAN_NUMBER"], custom_patterns={"PAN_NUMBER": r"\Qa.\E\x{A}[A-Z]"}, run_id="java")
    rel = F.substring(F.col("file_path"), len(root.rstrip("/")) + 2, 1 << 30)
    return run.findings.select(rel.alias("rel_path"), "data_type", "match_idx", "masked_value")


@register("run_lifecycle", with_ctes(
    "select unnest(['ended', 'failed', 'started']) as run_id, unnest(['COMPLETED', 'FAILED', 'RUNNING']) as status, "
    "unnest([(select count(*) from doc_files where status = 'SCANNED'), null, null]) as files_scanned", "doc_files"))
def run_lifecycle(spark, sf_dir):
    """Three runs over the files: one ends, one fails while it writes its report, one is still running."""
    from ..operators import history, report
    from ..operators.run import run_scan, run_states
    root, base = materialized_root(spark, sf_dir), shared_dir(spark, "lifecycle", uuid.uuid4().hex)
    past = f"{base}/history"
    run_scan(spark, [root], run_id="ended").write(f"{base}/ended", "csv", past)

    @report.writer("broken")
    def broken(df, path):
        raise OSError("no report today")

    try:
        run_scan(spark, config=P.ScanConfig(roots=(root,)), run_id="failed").write(f"{base}/failed", "broken", past)
    except OSError:
        pass
    running = run_scan(spark, [root], run_id="started")
    running._event(past + "-events", "started", 0, running.start_time)
    states = run_states(spark, past + "-events").select("run_id", "status")
    ended = history.read_history(spark, past).filter("status = 'COMPLETED'")
    counts = ended.select("run_id", F.col("files_scanned").cast("long").alias("files_scanned"))
    return states.join(counts, "run_id", "left")
