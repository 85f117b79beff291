"""Text extraction from files.

``extract_text`` reads and converts each file inside executor tasks
(``mapInPandas``): bytes are never a column that travels through a shuffle
or the driver, and one bad file only sets that file's status to ERROR.

Per extension (case-insensitive):
  txt   strict UTF-8; malformed bytes → ERROR
  csv   UTF-8 with replacement; every cell followed by ' | ', every record
        by a line break; empty lines skipped; quoted commas and line breaks kept;
        malformed quoting → ERROR
  xlsx  all sheets, rows, cells in order; each cell's text and one space,
        a line break per row; numbers in Java's double notation (so a
        16-digit number shows as 4.111111111111111E15), date-formatted
        numbers as dd-MMM-yyyy, formulas as their formula text
  docx  headers, body paragraphs (one line each) and tables (tab-separated
        cells per row), footers
  pdf   no extractor here → SKIPPED (plug one in through ``extractors``)
Unsupported extensions → SKIPPED.
"""

from __future__ import annotations

import csv
import datetime as dt
import io
import math
import re
import sys
import zipfile
from decimal import Decimal
from typing import Callable, Iterable, Iterator, Mapping
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame

from .paths import SUPPORTED_EXTENSIONS

LINE = "\n"  # the line separator of a Unix host


def txt_text(data: bytes) -> str:
    return data.decode("utf-8", errors="strict")


def csv_text(data: bytes) -> str:
    csv.field_size_limit(sys.maxsize)  # cells of any length
    text = data.decode("utf-8", errors="replace")
    out = io.StringIO()
    # strict: a quote left open or text after a closing quote is an error,
    # and the file is counted as ERROR
    for record in csv.reader(io.StringIO(text, newline=""), strict=True):
        if not record:
            continue
        for cell in record:
            out.write(cell)
            out.write(" | ")
        out.write(LINE)
    return out.getvalue()


def java_double(v: float) -> str:
    """Double.toString: plain notation for 1e-3 <= |v| < 1e7, else d.dddE±n
    (shortest digits that read back as the same double)."""
    if math.isnan(v):
        return "NaN"
    if math.isinf(v):
        return "Infinity" if v > 0 else "-Infinity"
    if v == 0:
        return "-0.0" if math.copysign(1, v) < 0 else "0.0"
    sign, digits, exp = Decimal(repr(abs(v))).normalize().as_tuple()
    ds = "".join(map(str, digits))
    point = len(ds) + exp  # position of the decimal point within ds
    neg = "-" if v < 0 else ""
    if 1e-3 <= abs(v) < 1e7:
        if point <= 0:
            return f"{neg}0.{'0' * -point}{ds}"
        if point >= len(ds):
            return f"{neg}{ds}{'0' * (point - len(ds))}.0"
        return f"{neg}{ds[:point]}.{ds[point:]}"
    return f"{neg}{ds[0]}.{ds[1:] or '0'}E{point - 1}"


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main",
       "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
       "w": "http://schemas.openxmlformats.org/wordprocessingml/2006/main"}


def _xlsx_sheet_paths(z: zipfile.ZipFile) -> list[str]:
    wb = ET.fromstring(z.read("xl/workbook.xml"))
    rels = ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))
    target = {r.get("Id"): r.get("Target") for r in rels}
    out = []
    for s in wb.iterfind("m:sheets/m:sheet", _NS):
        t = target.get(s.get(f"{{{_NS['r']}}}id"), "")
        t = t.lstrip("/")
        out.append(t if t.startswith("xl/") else "xl/" + t)
    return out


# Built-in number formats that show dates (ids 14-22 and 45-47).
_DATE_FORMAT_IDS = set(range(14, 23)) | {45, 46, 47}
_MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def _is_date_format(code: str) -> bool:
    """A custom number format shows a date when, without quoted text, escapes
    and [..] sections, it is made of date/time letters and separators."""
    f = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", code or "").split(";")[0]
    f = re.sub(r"(?i)am/pm|a/p", "", f)
    return bool(f) and bool(re.fullmatch(r"[yYmMdDhHsSeE0\-/,.: ]+", f)) and bool(re.search(r"[yYdD]|[mM]", f))


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    """Indexes of cell styles whose number format is a date."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    st = ET.fromstring(z.read("xl/styles.xml"))
    custom = {int(n.get("numFmtId")): n.get("formatCode", "") for n in st.iterfind("m:numFmts/m:numFmt", _NS)}
    out = set()
    for i, xf in enumerate(st.iterfind("m:cellXfs/m:xf", _NS)):
        fid = int(xf.get("numFmtId", "0"))
        if fid in _DATE_FORMAT_IDS or (fid in custom and _is_date_format(custom[fid])):
            out.add(i)
    return out


def _excel_date(serial: float, date1904: bool) -> str:
    """dd-MMM-yyyy of an Excel day number (1900 system keeps its 29 Feb 1900)."""
    days = int(math.floor(serial))
    if date1904:
        d = dt.date(1904, 1, 1) + dt.timedelta(days=days)
    elif days == 60:
        return "29-Feb-1900"
    else:
        d = dt.date(1899, 12, 31) + dt.timedelta(days=days - (1 if days > 60 else 0))
    return f"{d.day:02d}-{_MONTHS[d.month - 1]}-{d.year:04d}"


def xlsx_text(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iterfind("m:si", _NS):
                shared.append("".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")))
        dates = _date_styles(z)
        wb = ET.fromstring(z.read("xl/workbook.xml"))
        pr = wb.find("m:workbookPr", _NS)
        date1904 = pr is not None and pr.get("date1904") in ("1", "true")
        out = io.StringIO()
        for sheet in _xlsx_sheet_paths(z):
            root = ET.fromstring(z.read(sheet))
            for row in root.iterfind("m:sheetData/m:row", _NS):
                for c in row.iterfind("m:c", _NS):
                    out.write(_cell_text(c, shared, dates, date1904))
                    out.write(" ")
                out.write(LINE)
        return out.getvalue()


def _cell_text(c, shared: list[str], dates: set[int] = frozenset(), date1904: bool = False) -> str:
    t = c.get("t")
    f = c.find("m:f", _NS)
    v = c.find("m:v", _NS)
    if f is not None and f.text:
        return f.text
    if t == "s" and v is not None:
        return shared[int(v.text)]
    if t == "inlineStr":
        return "".join(x.text or "" for x in c.iter(f"{{{_NS['m']}}}t"))
    if t == "b" and v is not None:
        return "TRUE" if v.text == "1" else "FALSE"
    if t in ("str", "e") and v is not None:
        return v.text or ""
    if v is not None and v.text:
        num = float(v.text)
        if int(c.get("s", "0")) in dates and num >= 0:
            return _excel_date(num, date1904)
        return java_double(num)
    return ""


def docx_text(data: bytes) -> str:
    """Headers, then body paragraphs (one line each) and tables (tab-separated
    cells, a line per row, an empty line after the table), then footers."""
    w = f"{{{_NS['w']}}}"

    def para(p) -> str:
        return "".join((t.text or "") if t.tag == w + "t" else ("\t" if t.tag == w + "tab" else "\n")
                       for t in p.iter() if t.tag in (w + "t", w + "tab", w + "br", w + "cr"))

    def blocks(container, out: io.StringIO) -> None:
        for el in container if container is not None else []:
            if el.tag == w + "p":
                out.write(para(el) + LINE)
            elif el.tag == w + "tbl":
                for tr in el.iterfind("w:tr", _NS):
                    cells = [LINE.join(para(p) for p in tc.iterfind("w:p", _NS)) for tc in tr.iterfind("w:tc", _NS)]
                    out.write("\t".join(cells) + LINE)
                out.write(LINE)

    out = io.StringIO()
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        parts = sorted(n for n in names if re.fullmatch(r"word/header\d*\.xml", n))
        for n in parts:
            blocks(ET.fromstring(z.read(n)), out)
        blocks(ET.fromstring(z.read("word/document.xml")).find("w:body", _NS), out)
        for n in sorted(n for n in names if re.fullmatch(r"word/footer\d*\.xml", n)):
            blocks(ET.fromstring(z.read(n)), out)
    return out.getvalue()


DEFAULT_EXTRACTORS: dict[str, Callable[[bytes], str]] = {
    "txt": txt_text, "csv": csv_text, "xlsx": xlsx_text, "docx": docx_text,
}

EXTRACT_SCHEMA = "status string, text string, error string"


OUT_BATCH_BYTES = 64 << 20   # flush extracted text in slices of about this size
OUT_BATCH_ROWS = 1024


def _read_path(path: str) -> bytes:
    with open(path, "rb") as fh:
        return fh.read()


def _extract_fn(extractors: Mapping[str, Callable[[bytes], str]], supported: set[str],
                source_col: str, ext_col: str, keep: list[str], from_path: bool = True):
    def one(source, ext, problem=None):
        if problem:  # the listing could not read it
            return "ERROR", None, problem
        e = (ext or "").lower()
        fn = extractors.get(e)
        if e not in supported or fn is None:
            return "SKIPPED", None, None
        try:
            data = _read_path(source) if from_path else bytes(source)
            return "SCANNED", fn(data), None
        except Exception as exc:  # noqa: BLE001 - one bad file never fails the job
            return "ERROR", None, f"{type(exc).__name__}: {exc}"

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            start, size, out = 0, 0, []
            problems = pdf["problem"] if "problem" in pdf else [None] * len(pdf)
            for k, (source, ext, problem) in enumerate(zip(pdf[source_col], pdf[ext_col], problems)):
                res = one(source, ext, problem)
                out.append(res)
                size += len(res[1] or "")
                if size >= OUT_BATCH_BYTES or len(out) >= OUT_BATCH_ROWS:
                    yield _frame(pdf, keep, start, k + 1, out)
                    start, size, out = k + 1, 0, []
            if out:
                yield _frame(pdf, keep, start, len(pdf), out)
    return run


def _frame(pdf: pd.DataFrame, keep: list[str], lo: int, hi: int, rows: list[tuple]) -> pd.DataFrame:
    part = pdf.iloc[lo:hi][keep].reset_index(drop=True)
    part["status"] = [r[0] for r in rows]
    part["text"] = [r[1] for r in rows]
    part["error"] = [r[2] for r in rows]
    return part


def extract_text(files: DataFrame, extractors: Mapping[str, Callable[[bytes], str]] | None = None,
                 supported_extensions=SUPPORTED_EXTENSIONS, path_col: str = "path",
                 ext_col: str = "extension") -> DataFrame:
    """Add status (SCANNED / SKIPPED / ERROR), text and error to a file listing."""
    ex = dict(DEFAULT_EXTRACTORS)
    ex.update({k.lower(): v for k, v in (extractors or {}).items()})
    keep = list(files.columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)
    fn = _extract_fn(ex, {e.lower() for e in supported_extensions}, path_col, ext_col, keep)
    return files.mapInPandas(fn, schema + ", " + EXTRACT_SCHEMA)


def extract_content(files: DataFrame, extractors: Mapping[str, Callable[[bytes], str]] | None = None,
                    supported_extensions=SUPPORTED_EXTENSIONS, content_col: str = "content",
                    ext_col: str = "extension") -> DataFrame:
    """Like ``extract_text`` for rows that already carry the bytes (the
    ``binaryFile`` source, batch or stream); the bytes column is dropped."""
    ex = dict(DEFAULT_EXTRACTORS)
    ex.update({k.lower(): v for k, v in (extractors or {}).items()})
    keep = [c for c in files.columns if c != content_col]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields
                       if f.name != content_col)
    fn = _extract_fn(ex, {e.lower() for e in supported_extensions}, content_col, ext_col, keep,
                     from_path=False)
    return files.mapInPandas(fn, schema + ", " + EXTRACT_SCHEMA)
