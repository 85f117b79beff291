"""File selection as column predicates over a table of paths.

A listing is a DataFrame with ``root`` and ``path`` columns ('/' separated).
Every rule is a plain Column expression, so selection runs where the listing
lives (inside the lister's tasks or over a catalogued table of paths) and
no path list ever passes through the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --------------------------------------------------------------------------
# Default supported extensions and folder names skipped
# anywhere in the tree (case-insensitive).
# --------------------------------------------------------------------------
SUPPORTED_EXTENSIONS = ("pdf", "docx", "xlsx", "txt", "csv")
EXCLUDED_FOLDER_NAMES = ("node_modules", ".git", ".vscode", ".idea", "target", "build", "dist",
                         ".gradle", ".m2", "venv", ".venv", "site-packages", "__pycache__", ".cache",
                         "Google Cloud SDK", "AppData")
# --------------------------------------------------------------------------


@dataclass(frozen=True)
class ScanOptions:
    """Walk options; defaults: recursive, hidden files included, configured
    exclusions applied, symbolic links to directories not followed, no
    file-type filter."""

    recursive: bool = True
    include_hidden_files: bool = True
    exclude_configured_paths: bool = True
    follow_symbolic_links: bool = False
    file_type_filters: Sequence[str] | None = None


@dataclass(frozen=True)
class ScanConfig:
    supported_extensions: Sequence[str] = SUPPORTED_EXTENSIONS
    excluded_paths: Sequence[str] = ()
    excluded_folder_names: Sequence[str] = EXCLUDED_FOLDER_NAMES
    report_format: str = "csv"
    roots: Sequence[str] = ()  # scanned when a request names no paths


def normalize_filters(filters: Sequence[str] | None) -> list[str]:
    """'.TXT' → 'txt': one leading '.' dropped, lower-cased ('' keeps files
    without an extension)."""
    return [(f[1:] if f.startswith(".") else f).lower() for f in filters or () if f is not None]


def extension_of(name: Column) -> Column:
    """Text after the last '.', lower-cased; '' when there is none."""
    return F.when(F.instr(name, ".") > 0, F.lower(F.substring_index(name, ".", -1))).otherwise(F.lit(""))


def file_name_of(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dir_of(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def relative_parts(path: Column, root: Column) -> Column:
    """Components of ``path`` below ``root`` (directories, then the file name)."""
    rel = F.substring(path, F.length(F.regexp_replace(root, "/+$", "")) + 2, 1 << 30)
    return F.split(rel, "/")


def _dir_parts(parts: Column) -> Column:
    return F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))


def hidden_ok(parts: Column) -> Column:
    """No hidden directory below the root and no hidden file (S3)."""
    return ~F.exists(parts, lambda c: F.startswith(c, F.lit(".")))


def excluded_path_ok(path: Column, root: Column, excluded_paths: Sequence[str]) -> Column:
    """Directory not equal to, nor component-wise below, an excluded path;
    the root itself is exempt (S4)."""
    if not excluded_paths:
        return F.lit(True)
    d = dir_of(path)
    r = F.regexp_replace(root, "/+$", "")
    hit = F.lit(False)
    for p in excluded_paths:
        p = p.rstrip("/") or "/"
        hit = hit | (d == F.lit(p)) | F.startswith(d, F.lit(p + "/"))
    return (d == r) | ~hit


#: A folder's files are dealt to so many places in a join, as one folder may hold a third of them.
SALTS = 16


def exclude_paths(listing: DataFrame, excluded: DataFrame, path_col: str = "path", root_col: str = "root") -> DataFrame:
    """The rows that :func:`excluded_path_ok` keeps, for any number of excluded paths (column ``path``).

    Each folder's ancestors are looked up among the excluded paths by a hash join, once per folder; files are
    then left out by their folder.  The work grows with folders times depth, not with the number of exclusions.
    """
    p = F.regexp_replace("path", "/+$", "")
    gone = excluded.select(F.when(p == "", "/").otherwise(p).alias("__p")).distinct()
    d, r = dir_of(F.col(path_col)), F.regexp_replace(F.col(root_col), "/+$", "")
    rows = listing.filter(F.col(path_col).isNotNull() & F.col(root_col).isNotNull()).withColumn("__d", d).withColumn("__r", r)
    parts = F.split("__d", "/")
    above = F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    folders = rows.select("__d", "__r").distinct().filter(F.col("__d") != F.col("__r"))
    hits = (folders.withColumn("__p", F.explode(above)).join(gone, "__p", "left_semi").select("__d", "__r").distinct()
            .withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    salted = rows.withColumn("__s", F.pmod(F.xxhash64(path_col), F.lit(SALTS)).cast("int"))
    return salted.join(hits, ["__d", "__r", "__s"], "left_anti").select(*listing.columns)


def excluded_name_ok(parts: Column, names: Sequence[str]) -> Column:
    """No directory below the root named like an excluded folder."""
    if not names:
        return F.lit(True)
    lowered = F.array(*[F.lit(n.lower()) for n in names])
    return ~F.arrays_overlap(F.transform(_dir_parts(parts), F.lower), lowered)


def depth_ok(parts: Column, recursive: bool) -> Column:
    """Non-recursive walks see only files directly in the root."""
    return F.lit(True) if recursive else (F.size(parts) == 1)


def type_filter_ok(ext: Column, filters: Sequence[str] | None) -> Column:
    """Optional extension filter of a request (S10, decision X7)."""
    norm = normalize_filters(filters)
    return F.lit(True) if not norm else ext.isin(*norm)


def selection(path: Column, root: Column, options: ScanOptions = ScanOptions(),
              config: ScanConfig = ScanConfig()) -> Column:
    """The combined file-selection predicate of one scan."""
    parts = relative_parts(path, root)
    ok = depth_ok(parts, options.recursive)
    if not options.include_hidden_files:
        ok = ok & hidden_ok(parts)
    if options.exclude_configured_paths:
        ok = ok & excluded_path_ok(path, root, config.excluded_paths)
        ok = ok & excluded_name_ok(parts, config.excluded_folder_names)
    return ok & type_filter_ok(extension_of(file_name_of(path)), options.file_type_filters)


def select_files(listing: DataFrame, options: ScanOptions = ScanOptions(),
                 config: ScanConfig = ScanConfig(), path_col: str = "path",
                 root_col: str = "root") -> DataFrame:
    return listing.filter(selection(F.col(path_col), F.col(root_col), options, config))


def skipped_status(ext: Column, config: ScanConfig = ScanConfig(),
                   extractors: Sequence[str] | None = None) -> Column:
    """'SKIPPED' when the extension is unsupported or has no extractor, else
    null (S9)."""
    supported = [e.lower() for e in config.supported_extensions]
    if extractors is not None:
        have = {x.lower() for x in extractors}
        supported = [e for e in supported if e in have]
    return F.when(F.lower(ext).isin(*supported), F.lit(None).cast("string")).otherwise(F.lit("SKIPPED"))
