"""Distributed file listing.

``list_files`` walks directory trees level by level: each level is one Spark
job in which executors list a partition of the current directories
(``mapInPandas`` over ``os.scandir``), prune excluded and hidden
sub-directories on the spot, and hand the surviving ones to the next level.
Names and kinds come from the directory alone; sizes and times are read
afterwards, by all tasks, once the names are dealt evenly, so one folder that
holds a third of all files costs one task a stream of names and no more.
A tree with millions of directories is thus listed by all executors, not by
one task, and each level is checkpointed to the shared checkpoint folder so
a lost executor costs one level at most.  Paths never pass through the
driver; the driver only learns whether another level exists.

``os.scandir`` needs the tree mounted on every executor (shared file
systems).  For object stores use ``list_files_binary`` (Spark's own
``binaryFile`` source), which skips names starting with '.' or '_'.
"""

from __future__ import annotations

import os
from typing import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .paths import ScanConfig, ScanOptions, extension_of, normalize_filters

ENTRY_SCHEMA = ("root string, path string, is_dir boolean, size_bytes long, "
                "created_s double, modified_s double, depth int, problem string")
FILES_COLUMNS = ["root", "path", "rel_path", "file_name", "extension", "size_bytes", "created", "modified", "problem"]


def _is_hidden(name: str) -> bool:
    return name.startswith(".")


def _dir_excluded(path: str, name: str, config: ScanConfig) -> bool:
    for p in config.excluded_paths:
        p = p.rstrip("/") or "/"
        if path == p or path.startswith(p + "/"):
            return True
    lowered = {n.lower() for n in config.excluded_folder_names}
    return name.lower() in lowered


def _lister(options: ScanOptions, config: ScanConfig):
    """mapInPandas function: directories of one level → their entries."""

    def entries(root: str, d: str, depth: int) -> Iterator[tuple]:
        try:
            it = os.scandir(d)
        except OSError as exc:  # an unreadable directory is a row of the listing
            yield (root, d, False, None, None, None, depth, f"{type(exc).__name__}: {exc.strerror or exc}")
            return
        with it:
            yield from _walk_entries(root, d, depth, it)

    def _walk_entries(root: str, d: str, depth: int, it) -> Iterator[tuple]:
        for e in it:
            try:
                is_link = e.is_symlink()
                is_dir = e.is_dir(follow_symlinks=options.follow_symbolic_links)
                if is_dir and is_link and not options.follow_symbolic_links:
                    is_dir = False
                if is_dir:
                    if not options.recursive:
                        continue  # depth 1: sub-directories are not descended
                    if options.exclude_configured_paths and _dir_excluded(e.path, e.name, config):
                        continue
                    if not options.include_hidden_files and _is_hidden(e.name):
                        continue
                    if is_link:  # followed link: refuse cycles back into an ancestor
                        real, here = os.path.realpath(e.path), os.path.realpath(d)
                        if here == real or here.startswith(real.rstrip("/") + "/"):
                            continue
                    yield (root, e.path, True, None, None, None, depth + 1, None)
                    continue
                if not options.include_hidden_files and _is_hidden(e.name):
                    continue
                yield (root, e.path, False, None, None, None, depth + 1, None)
            except OSError as exc:
                yield (root, e.path, False, None, None, None, depth + 1, f"{type(exc).__name__}: {exc.strerror or exc}")

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = ["root", "path", "is_dir", "size_bytes", "created_s", "modified_s", "depth", "problem"]
        for pdf in batches:
            rows: list[tuple] = []
            for root, d, depth in zip(pdf["root"], pdf["dir"], pdf["depth"]):
                for row in entries(root, d, int(depth)):  # a huge folder streams through
                    rows.append(row)
                    if len(rows) >= 10000:
                        yield pd.DataFrame(rows, columns=cols)
                        rows = []
            if rows:
                yield pd.DataFrame(rows, columns=cols)

    return run


def _attributes(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """mapInPandas function: listed names → the same rows with sizes and times."""
    for pdf in batches:
        sizes, created, modified, problems = [], [], [], []
        for path, problem in zip(pdf["path"], pdf["problem"]):
            found = (None, None, None, problem)
            if problem is None:
                try:
                    st = os.stat(path)
                    # birth time where the OS has one, else the modified time (as Java does)
                    found = (int(st.st_size), float(getattr(st, "st_birthtime", None) or st.st_mtime), float(st.st_mtime), None)
                except OSError as exc:
                    found = (None, None, None, f"{type(exc).__name__}: {exc.strerror or exc}")
            for column, value in zip((sizes, created, modified, problems), found):
                column.append(value)
        yield pdf.assign(size_bytes=pd.array(sizes, dtype="Int64"), created_s=pd.array(created, dtype="Float64"),
                         modified_s=pd.array(modified, dtype="Float64"), problem=problems)


def _created(path: str) -> float:
    st = os.stat(path)
    return getattr(st, "st_birthtime", None) or st.st_mtime


MISSING_ROOTS = "Path(s) do not exist: "  # fixed value: the answer callers show


def check_roots(roots: Sequence[str], on_missing: str = "skip") -> list[str]:
    """Missing roots are skipped (default) or rejected together."""
    missing = [r for r in roots if not os.path.exists(r)]
    if missing and on_missing == "error":
        raise FileNotFoundError(MISSING_ROOTS + ", ".join(missing))
    return [r for r in roots if r not in missing]


def list_files(spark: SparkSession, roots: Sequence[str], options: ScanOptions = ScanOptions(),
               config: ScanConfig = ScanConfig(), on_missing: str = "skip",
               dirs_per_task: int = 64, files_per_task: int = 5000) -> DataFrame:
    """All files selected under ``roots``: root, path, rel_path, file_name,
    extension, size_bytes, created, modified.  Overlapping roots give
    duplicate rows, as separate walks would."""
    ensure_checkpoint_dir(spark)
    live = [os.path.abspath(r) for r in check_roots(list(roots), on_missing)]
    frontier = spark.createDataFrame([(r, r, 0) for r in live if os.path.isdir(r)],
                                     "root string, dir string, depth int")
    single = [(r, r) for r in live if os.path.isfile(r)]
    fn = _lister(options, config)
    parts: list[DataFrame] = []
    while True:
        listed = frontier.mapInPandas(fn, ENTRY_SCHEMA).checkpoint()
        parts.append(listed.filter(~F.col("is_dir")))
        frontier = listed.filter(F.col("is_dir")).select("root", F.col("path").alias("dir"), "depth")
        n_dirs = frontier.count() if options.recursive else 0  # one number per level to the driver
        if n_dirs == 0:
            break
        frontier = frontier.repartition(max(1, -(-n_dirs // dirs_per_task)))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    names = found.count()  # of checkpointed rows; one number
    tasks = max(1, min(names, max(spark.sparkContext.defaultParallelism, -(-names // files_per_task))))
    found = found.repartition(tasks).mapInPandas(_attributes, ENTRY_SCHEMA).checkpoint()
    if single:  # a root that is a file is handed over as a file
        extra = spark.createDataFrame(
            [(r, p, False, os.path.getsize(p), _created(p), os.path.getmtime(p), 0, None) for r, p in single],
            ENTRY_SCHEMA)
        found = found.unionByName(extra)
    name = F.substring_index(F.col("path"), "/", -1)
    rel = F.when(F.col("path") == F.col("root"), name).otherwise(
        F.substring(F.col("path"), F.length(F.regexp_replace("root", "/+$", "")) + 2, 1 << 30))
    out = found.select(
        "root", "path", rel.alias("rel_path"), name.alias("file_name"), extension_of(name).alias("extension"),
        "size_bytes",
        F.timestamp_seconds("created_s").cast("timestamp_ntz").alias("created"),
        F.timestamp_seconds("modified_s").cast("timestamp_ntz").alias("modified"), "problem")
    filters = normalize_filters(options.file_type_filters)
    return out.filter(F.col("extension").isin(*filters)) if filters else out


def list_files_binary(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """Listing through the ``binaryFile`` source (object stores).  Content is
    read lazily only if selected later."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    df = reader.load(root)
    name = F.substring_index(F.col("path"), "/", -1)
    return df.select(F.lit(root).alias("root"), "path", name.alias("file_name"),
                     extension_of(name).alias("extension"), F.col("length").alias("size_bytes"),
                     F.lit(None).cast("timestamp_ntz").alias("created"),
                     F.col("modificationTime").cast("timestamp_ntz").alias("modified"), "content")


def balance(listing: DataFrame, files_per_task: int = 1000, bytes_per_task: int = 128 << 20) -> DataFrame:
    """Spread a listing evenly before the files are read.

    Listings come out grouped by folder, so a folder holding most of the files
    would otherwise be read and scanned by one task.  The listing is small
    metadata: one count, then ranges of paths of equal size (never bytes).
    """
    files, size = listing.agg(F.count(F.lit(1)), F.sum("size_bytes")).first()
    files, size = int(files or 0), int(size or 0)
    try:
        cores = listing.sparkSession.sparkContext.defaultParallelism
    except Exception:  # noqa: BLE001 - no SparkContext access
        cores = 1
    n = max(cores, -(-files // files_per_task), -(-size // bytes_per_task))
    return listing.repartitionByRange(max(1, min(n, max(files, 1))), "path")
