"""Run-level aggregates over findings and file outcomes.

All of them are hash aggregates with a partial (map-side) step, so a run that
holds most of the rows still ships only one partial row per task.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.types import CARD_NOTICE, CRITICAL, MEDIUM, NORMAL


def _by(by) -> list[str]:
    return [by] if isinstance(by, str) else list(by)


def _fill_zero(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.fillna(0, subset=list(cols))


def risk_counts(findings: DataFrame, by="run_id", runs: DataFrame | None = None) -> DataFrame:
    """critical, medium, normal and total findings per group (A1, A3).

    With ``runs`` (one row per group) groups without findings show zeros.
    """
    keys = _by(by)
    agg = findings.groupBy(*keys).agg(
        F.count_if(F.col("risk_level") == CRITICAL).alias("critical"),
        F.count_if(F.col("risk_level") == MEDIUM).alias("medium"),
        F.count_if(F.col("risk_level") == NORMAL).alias("normal"),
        F.count(F.lit(1)).alias("total"))
    if runs is not None:
        agg = _fill_zero(runs.select(*keys).join(agg, keys, "left"),
                         ["critical", "medium", "normal", "total"])
    return agg


def row_risk_counts(findings: Column) -> list[Column]:
    """critical, medium, normal, total and has_card of one row's findings array."""
    def n(level):
        return F.size(F.filter(findings, lambda x: x["risk_level"] == level)).cast("long")
    return [n(CRITICAL).alias("critical"), n(MEDIUM).alias("medium"), n(NORMAL).alias("normal"),
            F.size(findings).cast("long").alias("total"),
            F.exists(findings, lambda x: x["data_type"] == "CARD_NUMBER").alias("has_card")]


def group_risk_counts() -> list[Column]:
    """Aggregates over rows carrying ``row_risk_counts`` columns."""
    return [F.sum("critical").alias("critical"), F.sum("medium").alias("medium"),
            F.sum("normal").alias("normal"), F.sum("total").alias("total"),
            F.bool_or("has_card").alias("has_card")]


def risk_share(counts: DataFrame) -> DataFrame:
    """Share of each level in percent, one decimal: 100*n/max(total,1) (A4)."""
    denom = F.greatest(F.col("total"), F.lit(1))
    out = counts
    for level in ("critical", "medium", "normal"):
        pct = F.round(F.lit(100.0) * F.col(level) / denom, 1)
        out = out.withColumn(f"{level}_pct", pct).withColumn(
            f"{level}_share", F.concat(pct.cast("string"), F.lit("%")))
    return out


def file_counters(files: DataFrame, by="run_id", status_col: str = "status") -> DataFrame:
    """files_scanned, files_skipped, errors per group (A2)."""
    s = F.col(status_col)
    return files.groupBy(*_by(by)).agg(
        F.count_if(s == "SCANNED").cast("int").alias("files_scanned"),
        F.count_if(s == "SKIPPED").cast("int").alias("files_skipped"),
        F.count_if(s == "ERROR").cast("int").alias("errors"))


def card_notice(stats: DataFrame) -> DataFrame:
    """Adds the fixed Luhn caveat where a group of ``run_stats`` has a card (A5)."""
    return stats.withColumn("notice", F.when(F.col("has_card"), F.lit(CARD_NOTICE)))


def run_stats(per_file: DataFrame, by, *more: Column) -> DataFrame:
    """Everything per run from one pass over its files (A1–A3, A5, A6): file
    outcomes, findings by risk, the card flag, and the aggregates in ``more``.

    ``per_file`` has a ``findings`` array per file: each is counted in its own
    row, so one small partial aggregate per task is shuffled, however large a
    run is.
    """
    s = F.col("status")
    rows = per_file.select("*", *row_risk_counts(F.col("findings"))).drop("findings")
    return rows.groupBy(*_by(by)).agg(
        *more, F.count_if(s == "SCANNED").cast("int").alias("files_scanned"),
        F.count_if(s == "SKIPPED").cast("int").alias("files_skipped"),
        F.count_if(s == "ERROR").cast("int").alias("errors"), *group_risk_counts())


def duration_ms(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MILLISECOND", start, end)


def duration_text(ms: Column) -> Column:
    """HH:MM:SS.mmm; null or negative → 00:00:00.000; hours may exceed 99."""
    safe = F.when(ms.isNull() | (ms < 0), F.lit(0)).otherwise(ms)
    secs = F.floor(safe / 1000)
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(secs / 3600), F.floor((secs % 3600) / 60),
                           secs % 60, safe % 1000)


def extension_profile(files: DataFrame, ext_col: str = "extension") -> DataFrame:
    """Files and bytes per lower-case extension, with their outcomes."""
    return files.groupBy(F.lower(F.col(ext_col)).alias("extension")).agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("size_bytes").cast("long").alias("total_bytes"),
        F.count_if(F.col("status") == "SCANNED").alias("scanned"),
        F.count_if(F.col("status") == "SKIPPED").alias("skipped"))
