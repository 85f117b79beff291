"""Browsing a findings table: recent slice, filters, search, pages, exports
(Q1–Q9, K1, K3).

DataFrames have no order, so every order-dependent view takes an explicit
``seq`` ordering: by default (scan_ts, file_path, type ordinal, match_idx).
Top-N views use ``orderBy().limit()`` which Spark runs as a per-task top-N
plus one small merge (TakeOrderedAndProject), never a full sort.
"""

from __future__ import annotations

import uuid
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.types import LABEL_BY_TYPE, TYPE_NAMES
from ..session import shared_dir

# --------------------------------------------------------------------------
# Fixed values (must equal the reference): window and page sizes, time
# formats, the placeholder for a missing time, and the report headers.
# --------------------------------------------------------------------------
RECENT_WINDOW = 200   # live findings window
PAGE_SIZE = 10        # findings and history pages
DISPLAY_TS = "dd MMM yyyy, h:mm a"
REPORT_TS = "yyyy-MM-dd HH:mm:ss"
NO_VALUE = "–"
REPORT_HEADER = ["File Name", "File Path", "Sensitive Data Type", "Risk Level", "Masked Value",
                 "Scan Timestamp", "File Created", "File Modified"]
EXPORT_HEADER = ["File Name", "File Path", "PII Type", "Risk Level", "Masked Value",
                 "Scan Timestamp", "File Created", "File Modified"]
# --------------------------------------------------------------------------


def type_ordinal(col: Column) -> Column:
    return F.array_position(F.array(*[F.lit(n) for n in TYPE_NAMES]), col)


def default_seq(df: DataFrame) -> list[Column]:
    cols = []
    for c in ("scan_ts", "file_path", "path", "doc_id"):
        if c in df.columns:
            cols.append(F.col(c))
    cols += [type_ordinal(F.col("data_type")), F.col("match_idx")]
    return cols


def recent(findings: DataFrame, n: int = RECENT_WINDOW, seq: Sequence[Column] | None = None) -> DataFrame:
    """The last ``n`` findings by ``seq``, oldest first inside the slice (Q1).

    A per-task top-n and one small merge; only the ``n`` survivors are sorted
    again."""
    seq = list(seq or default_seq(findings))
    return findings.orderBy(*[c.desc() for c in seq]).limit(n).orderBy(*seq)


def filter_risk(findings: DataFrame, level: str | None) -> DataFrame:
    """Equality on risk level; blank → everything (Q2)."""
    return findings if not (level or "").strip() else findings.filter(F.col("risk_level") == level)


def filter_type(findings: DataFrame, data_type: str | None) -> DataFrame:
    """Equality on type; blank → everything (Q3)."""
    return findings if not (data_type or "").strip() else findings.filter(F.col("data_type") == data_type)


def search(findings: DataFrame, query: str | None, name_col="file_name", path_col="file_path") -> DataFrame:
    """Literal, case-insensitive substring of 'name path masked' (Q4)."""
    q = (query or "").strip().lower()
    if not q:
        return findings
    hay = F.lower(F.concat_ws(" ", F.col(name_col), F.col(path_col), F.col("masked_value")))
    return findings.filter(F.contains(hay, F.lit(q)))


def newest_first(findings: DataFrame, seq: Sequence[Column] | None = None) -> DataFrame:
    """Q5: reverse order of arrival."""
    seq = list(seq or default_seq(findings))
    return findings.orderBy(*[c.desc() for c in seq])


def stored(df: DataFrame, label: str = "view") -> DataFrame:
    """The rows written once to the shared folder: later steps read them and
    do not scan the texts again."""
    path = shared_dir(df.sparkSession, "views", f"{label}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def positioned(df: DataFrame, seq: Sequence[Column] | None = None, descending: bool = True) -> DataFrame:
    """Adds ``pos``, the 1-based position of each row in the whole ordered list.

    The rows are dealt to ranges of the sort key and ranked inside each range;
    a running sum over the ranges' sizes (one number each) makes the ranks
    global.  No task sees more than its range.  The input is stored first:
    the ranges are sampled and counted from it.
    """
    seq = list(seq or default_seq(df))
    ordered = [c.desc() for c in seq] if descending else list(seq)
    ranged = stored(stored(df, "rows").repartitionByRange(*ordered).withColumn("__part", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("__part").count()
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__base"))
    ranks = ranged.withColumn("__rank", F.row_number().over(Window.partitionBy("__part").orderBy(*ordered)))
    return (ranks.join(bases, "__part")
            .withColumn("pos", (F.col("__base") + F.col("__rank")).cast("long")).drop("__part", "__rank", "__base"))


#: Rows up to which a page is taken as a top-N; deeper pages go by position.
TOP_ROWS = 10_000


def page(df: DataFrame, page_no: int, size: int = PAGE_SIZE, seq: Sequence[Column] | None = None,
         descending: bool = True) -> DataFrame:
    """One page of ``size`` rows, page clamped to [1, max(1, ceil(n/size))] (Q6).

    Adds ``pos`` (1-based position in the whole ordered list) and ``total``.
    The rows are stored once, then counted; the first pages are a top-N, deep
    ones are picked by their position, which no single task has to sort.
    """
    seq = list(seq or default_seq(df))
    rows = stored(df, "page")
    total = rows.count()
    last = max(1, -(-total // size))
    p = min(max(1, int(page_no)), last)
    if p * size > TOP_ROWS:
        found = positioned(rows, seq, descending).filter(
            (F.col("pos") > (p - 1) * size) & (F.col("pos") <= p * size))
    else:
        ordered = [c.desc() for c in seq] if descending else list(seq)
        # position inside the page: a window over at most ``size`` rows
        found = (rows.orderBy(*ordered).offset((p - 1) * size).limit(size)
                 .withColumn("pos", F.row_number().over(Window.orderBy(*ordered)).cast("long") + F.lit((p - 1) * size)))
    return found.withColumn("page", F.lit(p)).withColumn("total", F.lit(total).cast("long"))


def type_label(col: Column) -> Column:
    """Friendly label; unknown code → the code itself (Q7)."""
    m = F.create_map(*[x for k, v in LABEL_BY_TYPE.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[col], col)


def display_ts(col: Column) -> Column:
    """'dd Mon yyyy, h:mm AM' ; null → '–' (Q8)."""
    return F.coalesce(F.date_format(col, DISPLAY_TS), F.lit(NO_VALUE))


def display_ts_text(col: Column) -> Column:
    """Q8 for time stamps held as text: formatted when it parses, the text
    itself when it does not, '–' when empty or null."""
    blank = col.isNull() | (F.trim(col) == "")
    shown = F.coalesce(F.date_format(F.try_to_timestamp(col), DISPLAY_TS), col)
    return F.when(blank, F.lit(NO_VALUE)).otherwise(shown)


def location(path_col: Column, name_col: Column) -> Column:
    """Folder of a file: path minus the name and its separator; else up to the
    last separator; null → '-' (Q9)."""
    n_path, n_name = F.length(path_col), F.length(name_col)
    strip_name = F.regexp_replace(F.substring(path_col, 1, n_path - n_name), r"[\\/]$", "")
    def last_pos(sep: str) -> Column:  # 1-based position of the last ``sep``, 0 if none
        return F.when(F.instr(path_col, sep) > 0,
                      n_path - F.locate(sep, F.reverse(path_col)) + 1).otherwise(0)
    last_sep = F.greatest(last_pos("/"), last_pos("\\"))
    fallback = F.when(last_sep > 0, F.substring(path_col, 1, last_sep - 1)).otherwise(path_col)
    by_name = (name_col.isNotNull() & (F.length(name_col) > 0) & F.endswith(path_col, name_col))
    return (F.when(path_col.isNull() | (F.length(path_col) == 0), F.lit("-"))
            .when(by_name, strip_name).otherwise(fallback))


def report_rows(findings: DataFrame) -> DataFrame:
    """The 8 report columns; times as yyyy-MM-dd HH:mm:ss, null → '' (K1)."""
    def ts(c):
        return F.coalesce(F.date_format(F.col(c), REPORT_TS), F.lit(""))
    return findings.select(
        F.col("file_name").alias(REPORT_HEADER[0]), F.col("file_path").alias(REPORT_HEADER[1]),
        F.col("data_type").alias(REPORT_HEADER[2]), F.col("risk_level").alias(REPORT_HEADER[3]),
        F.col("masked_value").alias(REPORT_HEADER[4]), ts("scan_ts").alias(REPORT_HEADER[5]),
        ts("file_created").alias(REPORT_HEADER[6]), ts("file_modified").alias(REPORT_HEADER[7]))


def export_rows(findings: DataFrame) -> DataFrame:
    """Filtered-export projection: friendly type labels and display times (K3)."""
    return findings.select(
        F.col("file_name").alias(EXPORT_HEADER[0]), F.col("file_path").alias(EXPORT_HEADER[1]),
        type_label(F.col("data_type")).alias(EXPORT_HEADER[2]),
        F.col("risk_level").alias(EXPORT_HEADER[3]), F.col("masked_value").alias(EXPORT_HEADER[4]),
        display_ts(F.col("scan_ts")).alias(EXPORT_HEADER[5]),
        display_ts(F.col("file_created")).alias(EXPORT_HEADER[6]),
        display_ts(F.col("file_modified")).alias(EXPORT_HEADER[7]))
