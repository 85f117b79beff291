"""Lister, selection predicates and extractors on a real temporary tree."""

import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from piisift.operators.detect import scan
from piisift.sources import paths as P
from piisift.sources.extract import csv_text, docx_text, extract_text, xlsx_text
from piisift.sources.files import list_files

CARD = "4111 1111 1111 1111"


def _write(root, rel, data):
    p = os.path.join(root, rel)
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "wb") as fh:
        fh.write(data if isinstance(data, bytes) else data.encode())


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tree"))
    for rel in ["a.txt", ".h.txt", "_u.txt", "sub/b.CSV", ".hid/c.txt", "node_modules/d.txt",
                "Node_Modules/x/e.pdf", "skip/f.txt", "skipper/g.txt", "noext", ".txt", "v1.2/readme"]:
        _write(root, rel, f"card {CARD} in {rel}\n")
    _write(root, "bad.txt", b"abc\xff\xfedef " + CARD.encode())
    _write(root, "bad.csv", b"abc\xff\xfedef, " + CARD.encode() + b"\n")
    return root


def rels(df):
    return sorted(r.rel_path for r in df.select("rel_path").collect())


def test_listing_includes_hidden_and_underscore(spark, tree):
    got = rels(list_files(spark, [tree], config=P.ScanConfig(excluded_folder_names=())))
    assert ".h.txt" in got and "_u.txt" in got and ".hid/c.txt" in got and "node_modules/d.txt" in got


def test_listing_prunes(spark, tree):
    cfg = P.ScanConfig(excluded_paths=(os.path.join(tree, "skip"),))
    got = rels(list_files(spark, [tree], P.ScanOptions(include_hidden_files=False), cfg))
    assert ".h.txt" not in got and ".hid/c.txt" not in got
    assert "node_modules/d.txt" not in got and "Node_Modules/x/e.pdf" not in got
    assert "skip/f.txt" not in got and "skipper/g.txt" in got and "v1.2/readme" in got


def test_listing_non_recursive_and_filters(spark, tree):
    got = rels(list_files(spark, [tree], P.ScanOptions(recursive=False)))
    assert all("/" not in r for r in got) and "a.txt" in got
    got = rels(list_files(spark, [tree], P.ScanOptions(file_type_filters=[".CSV"])))
    assert got == ["bad.csv", "sub/b.CSV"]


def test_missing_roots(spark, tree):
    assert rels(list_files(spark, [tree + "/nope", tree], P.ScanOptions(recursive=False)))
    with pytest.raises(FileNotFoundError):
        list_files(spark, [tree + "/nope"], on_missing="error")


def test_extract_status_and_scan(spark, tree):
    files = extract_text(list_files(spark, [tree], config=P.ScanConfig(excluded_folder_names=())))
    st = {r.rel_path: r.status for r in files.select("rel_path", "status").collect()}
    assert st["bad.txt"] == "ERROR" and st["bad.csv"] == "SCANNED"
    assert st["noext"] == "SKIPPED" and st["Node_Modules/x/e.pdf"] == "SKIPPED" and st["sub/b.CSV"] == "SCANNED"
    found = scan(files.filter(F.col("status") == "SCANNED"), "text", ["rel_path"], types=["CARD_NUMBER"])
    hit = {r.rel_path for r in found.collect()}
    assert "bad.csv" in hit and "a.txt" in hit and "bad.txt" not in hit


def test_path_predicates(spark):
    rows = [("/data", p) for p in ["/data/a.txt", "/data/.h.txt", "/data/_u.txt", "/data/sub/b.CSV",
                                   "/data/.hid/c.txt", "/data/node_modules/d.txt", "/data/Node_Modules/x/e.pdf",
                                   "/data/skip/f.txt", "/data/skipper/g.txt", "/data/noext", "/data/.txt",
                                   "/data/v1.2/readme"]]
    df = spark.createDataFrame(rows, "root string, path string")
    sel = lambda o, c: sorted(r.path for r in P.select_files(df, o, c).collect())
    none = P.ScanConfig(excluded_folder_names=())
    assert "/data/.h.txt" not in sel(P.ScanOptions(include_hidden_files=False), none)
    got = sel(P.ScanOptions(), P.ScanConfig(excluded_paths=("/data/skip",)))
    assert "/data/skip/f.txt" not in got and "/data/skipper/g.txt" in got
    assert "/data/Node_Modules/x/e.pdf" not in sel(P.ScanOptions(), P.ScanConfig())
    ext = {r.path: r.e for r in df.select("path", P.extension_of(P.file_name_of(F.col("path"))).alias("e")).collect()}
    assert ext["/data/sub/b.CSV"] == "csv" and ext["/data/noext"] == "" and ext["/data/.txt"] == "txt"
    assert ext["/data/v1.2/readme"] == ""


def test_root_exempt_from_exclusion(spark):
    df = spark.createDataFrame([("/data/skip", "/data/skip/a.txt"), ("/data/skip", "/data/skip/s/b.txt")],
                               "root string, path string")
    got = [r.path for r in P.select_files(df, P.ScanOptions(), P.ScanConfig(excluded_paths=("/data/skip",))).collect()]
    assert got == ["/data/skip/a.txt"]


def test_csv_text_shape():
    assert csv_text(b'a,"b,c"\n\n"x\ny",2') == "a | b,c | \nx\ny | 2 | \n"


def _zip(files):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for name, data in files.items():
            z.writestr(name, data)
    return buf.getvalue()


def test_xlsx_text():
    m = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    r = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    data = _zip({
        "xl/workbook.xml": f'<workbook {m} {r}><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                                      '<Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": f'<sst {m}><si><t>card</t></si></sst>',
        "xl/worksheets/sheet1.xml": f'<worksheet {m}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c>'
                                    f'<c r="B1"><v>4111111111111111</v></c><c r="C1"><v>12.5</v></c></row>'
                                    f'</sheetData></worksheet>'})
    assert xlsx_text(data) == "card 4.111111111111111E15 12.5 \n"


def test_docx_text():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    data = _zip({"word/document.xml": f'<w:document {w}><w:body><w:p><w:r><w:t>card {CARD}</w:t></w:r></w:p>'
                                      f'</w:body></w:document>'})
    assert docx_text(data) == f"card {CARD}\n"


def test_user_extractor(spark, tree):
    files = list_files(spark, [tree], P.ScanOptions(recursive=False))
    out = extract_text(files, extractors={"": lambda b: b.decode().upper()},
                       supported_extensions=(*P.SUPPORTED_EXTENSIONS, ""))
    st = {r.rel_path: (r.status, r.text) for r in out.collect()}
    assert st["noext"][0] == "SCANNED" and st["noext"][1].startswith("CARD")


def test_symlinked_dirs(spark, tmp_path):
    real = tmp_path / "real"
    (real / "in").mkdir(parents=True)
    (real / "in" / "a.txt").write_text("x")
    root = tmp_path / "root"
    root.mkdir()
    (root / "b.txt").write_text("y")
    os.symlink(real, root / "link")
    os.symlink(root, root / "loop")  # a cycle back to the root
    plain = rels(list_files(spark, [str(root)]))
    followed = rels(list_files(spark, [str(root)], P.ScanOptions(follow_symbolic_links=True)))
    assert "link/in/a.txt" not in plain and "b.txt" in plain
    assert "link/in/a.txt" in followed and not any(r.startswith("loop/") for r in followed)


def test_xlsx_date_cells():
    m = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    r = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    data = _zip({
        "xl/workbook.xml": f'<workbook {m} {r}><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                                      '<Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet {m}><numFmts count="1"><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd"/>'
                         f'</numFmts><cellXfs count="3"><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/>'
                         f'</cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f'<worksheet {m}><sheetData><row r="1"><c r="A1" s="1"><v>45296</v></c>'
                                    f'<c r="B1" s="2"><v>1</v></c><c r="C1" s="0"><v>45296</v></c>'
                                    f'<c r="D1" s="1"><v>60</v></c></row></sheetData></worksheet>'})
    assert xlsx_text(data) == "05-Jan-2024 01-Jan-1900 45296.0 29-Feb-1900 \n"


def test_docx_headers_tables_footers():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    data = _zip({
        "word/header1.xml": f'<w:hdr {w}><w:p><w:r><w:t>HEAD jo@ybl</w:t></w:r></w:p></w:hdr>',
        "word/document.xml": f'<w:document {w}><w:body><w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t></w:r></w:p>'
                             f'<w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc>'
                             f'<w:tc><w:p><w:r><w:t>{CARD}</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>',
        "word/footer1.xml": f'<w:ftr {w}><w:p><w:r><w:t>FOOT</w:t></w:r></w:p></w:ftr>'})
    assert docx_text(data) == f"HEAD jo@ybl\na\tb\nx\t{CARD}\n\nFOOT\n"


def test_malformed_csv_is_an_error(spark, tmp_path):
    (tmp_path / "ok.csv").write_text('a,"b,c"\n')
    (tmp_path / "open.csv").write_text('a,"b,c\n')
    (tmp_path / "after.csv").write_text('a,"b"c\n')
    st = {r.file_name: r.status for r in extract_text(list_files(spark, [str(tmp_path)])).collect()}
    assert st == {"ok.csv": "SCANNED", "open.csv": "ERROR", "after.csv": "ERROR"}


def test_binary_file_listing_and_content_extraction(spark, tree):
    from piisift.sources.extract import extract_content
    from piisift.sources.files import list_files_binary
    files = list_files_binary(spark, tree)
    names = {r.file_name for r in files.select("file_name").collect()}
    assert "a.txt" in names and "b.CSV" in names
    assert ".h.txt" not in names and "_u.txt" not in names  # Spark's file sources skip these
    st = {r.file_name: r.status for r in extract_content(files).select("file_name", "status").collect()}
    assert st["a.txt"] == "SCANNED" and st["bad.txt"] == "ERROR" and st["noext"] == "SKIPPED"


def test_skipped_status_column(spark):
    df = spark.createDataFrame([("TXT",), ("pdf",), ("md",), ("",)], "extension string")
    got = [r.s for r in df.select(P.skipped_status(F.col("extension")).alias("s")).collect()]
    assert got == [None, None, "SKIPPED", "SKIPPED"]
    got = [r.s for r in df.select(P.skipped_status(F.col("extension"), extractors=["txt"]).alias("s")).collect()]
    assert got == [None, "SKIPPED", "SKIPPED", "SKIPPED"]  # pdf has no extractor


def test_file_root_and_empty_root(spark, tmp_path):
    f = tmp_path / "one.txt"
    f.write_text("x")
    (tmp_path / "empty").mkdir()
    rows = list_files(spark, [str(f), str(tmp_path / "empty")]).collect()
    assert [(r.rel_path, r.extension) for r in rows] == [("one.txt", "txt")]
    assert rows[0].created is not None and rows[0].modified is not None


def test_balance_spreads_one_big_folder(spark, tmp_path):
    from piisift.sources.files import balance
    big = tmp_path / "big"
    big.mkdir()
    for i in range(40):
        (big / f"f{i}.txt").write_text("x")
    listing = list_files(spark, [str(tmp_path)])
    spread_out = balance(listing, files_per_task=5)
    sizes = spread_out.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(sizes) >= 8 and max(r["count"] for r in sizes) <= 5
    assert spread_out.count() == 40
