"""Report sinks.

A report is a DataFrame write: one directory per run, written by all tasks in
parallel.  ``single_file=True`` coalesces to one task and is meant for small
results only.
"""

from __future__ import annotations

import os
from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import browse

# format name (case-insensitive) → writer(df, path); extend to add a format
WRITERS: dict[str, Callable[[DataFrame, str], None]] = {}


def writer(name: str):
    def deco(fn: Callable[[DataFrame, str], None]):
        WRITERS[name.lower()] = fn
        return fn
    return deco


def _csv_writer(df: DataFrame):
    # values are written as they are (no trimming, '"' doubled inside quotes),
    # records end with CRLF like the reference's report files
    return (df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"')
            .option("emptyValue", "").option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False).option("lineSep", "\r\n"))


@writer("csv")
def _csv(df: DataFrame, path: str) -> None:
    _csv_writer(df).csv(path)


@writer("parquet")
def _parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


@writer("json")
def _json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


@writer("excel")
def _excel(df: DataFrame, path: str) -> None:
    """Workbooks of one sheet, written by the tasks: a task starts a new one
    every ``XLSX_FILE_ROWS`` rows, which bounds its memory.  Needs a folder
    mounted on the executors; elsewhere use csv or parquet."""
    if "://" in path and not path.startswith("file://"):
        raise ValueError(f"excel reports need a mounted folder, not {path}")
    folder = path.replace("file://", "", 1)
    os.makedirs(folder, exist_ok=True)
    header = list(df.columns)
    strings = df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in header])
    written = strings.mapInPandas(_xlsx_writer(folder, header), "part string, n long")
    total = written.agg(F.sum("n")).first()[0]  # one number back to the driver
    if not total:  # no findings: a workbook with the header only
        _write_workbook(folder, header, [])


SHEET_NAME = "Scan Results"   # fixed: the sheet's name
XLSX_FILE_ROWS = 100_000      # rows held in a task before its workbook is written


def _write_workbook(folder: str, header: list[str], rows: list[list[str]]) -> str:
    import uuid
    name = os.path.join(folder, f"part-{uuid.uuid4().hex}.xlsx")
    tmp = name + ".part"
    with open(tmp, "wb") as fh:
        fh.write(xlsx_bytes(header, rows))
    os.replace(tmp, name)
    return name


def _xlsx_writer(folder: str, header: list[str]):
    def run(batches):
        import pandas as pd
        rows: list[list[str]] = []
        for pdf in batches:
            rows.extend(pdf.astype(object).values.tolist())
            while len(rows) >= XLSX_FILE_ROWS:
                chunk, rows = rows[:XLSX_FILE_ROWS], rows[XLSX_FILE_ROWS:]
                yield pd.DataFrame({"part": [_write_workbook(folder, header, chunk)], "n": [len(chunk)]})
        if rows:
            yield pd.DataFrame({"part": [_write_workbook(folder, header, rows)], "n": [len(rows)]})
    return run


def _xml_text(v) -> str:
    t = "" if v is None else str(v)
    t = "".join(ch for ch in t if ch in "\t\n\r" or ord(ch) >= 32)  # XML 1.0 characters only
    return t.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def _col_name(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def _sheet_xml(header: list[str], rows: list[list[str]]) -> str:
    def row(r: int, values, style: str) -> str:
        cells = "".join(f'<c r="{_col_name(j)}{r}" t="inlineStr"{style}><is><t xml:space="preserve">'
                        f"{_xml_text(v)}</t></is></c>" for j, v in enumerate(values))
        return f'<row r="{r}">{cells}</row>'
    body = [row(1, header, ' s="1"')] + [row(i + 2, v, "") for i, v in enumerate(rows)]
    return ('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
            '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">'
            f'<sheetData>{"".join(body)}</sheetData></worksheet>')


def xlsx_bytes(header: list[str], rows: list[list[str]]) -> bytes:
    """A minimal workbook of inline-string cells; the header row is bold."""
    import io
    import zipfile
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    pkg = "http://schemas.openxmlformats.org/package/2006/relationships"
    sheets = f'<sheet name="{SHEET_NAME}" sheetId="1" r:id="rId1"/>'
    wb_rels = (f'<Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/>'
               f'<Relationship Id="rId2" Type="{rel}/styles" Target="styles.xml"/>')
    overrides = ('<Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/'
                 'vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>')
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml",
                   '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
                   '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
                   '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
                   '<Default Extension="xml" ContentType="application/xml"/>'
                   '<Override PartName="/xl/workbook.xml" ContentType="application/'
                   'vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
                   '<Override PartName="/xl/styles.xml" ContentType="application/'
                   'vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>' + overrides + '</Types>')
        z.writestr("_rels/.rels", f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Relationships xmlns="{pkg}">'
                   f'<Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
                   f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{sheets}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
                   f'<Relationships xmlns="{pkg}">{wb_rels}</Relationships>')
        z.writestr("xl/styles.xml", f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><styleSheet xmlns="{main}">'
                   '<fonts count="2"><font><sz val="11"/><name val="Calibri"/></font>'
                   '<font><b/><sz val="11"/><name val="Calibri"/></font></fonts>'
                   '<fills count="2"><fill><patternFill patternType="none"/></fill>'
                   '<fill><patternFill patternType="gray125"/></fill></fills>'
                   '<borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs>'
                   '<cellXfs count="2"><xf fontId="0"/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", _sheet_xml(header, rows))
    return buf.getvalue()


def resolve_format(fmt: str | None) -> Callable[[DataFrame, str], None] | None:
    """Writer for a format name; unknown or missing → None (no report, the
    run still completes)."""
    return WRITERS.get((fmt or "").strip().lower())


def report_path(output_directory: str, fmt: str = "csv", now_ms: int | None = None) -> str:
    """Report location named by the run's wall-clock millis (K1):
    <dir>/scan-report-<epoch millis>.<fmt> (a directory of part files)."""
    import time
    ms = int(time.time() * 1000) if now_ms is None else now_ms
    ext = {"excel": "xlsx"}.get((fmt or "csv").lower(), (fmt or "csv").lower())
    return f"{output_directory.rstrip('/')}/scan-report-{ms}.{ext}"


def write_report(findings: DataFrame, path: str, fmt: str | None = "csv",
                 single_file: bool = False) -> str | None:
    """Write the 8-column findings report (K1, K2); returns the path or None."""
    w = resolve_format(fmt)
    if w is None:
        return None
    rows = browse.report_rows(findings)
    w(rows.coalesce(1) if single_file else rows, path)
    return path


def write_export(findings: DataFrame, path: str, single_file: bool = False) -> str:
    """Filtered export (K3): friendly labels, display times, CRLF lines."""
    rows = browse.export_rows(findings)
    rows = rows.coalesce(1) if single_file else rows
    _csv_writer(rows).csv(path)
    return path
