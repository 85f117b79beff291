"""Command line: plan and run one scan over folders.

    python -m piisift scan /mnt/share --out /mnt/scans [--types CARD_NUMBER,EMAIL]
        [--pattern EMAIL='\\b[a-z]+@corp\\.example\\b'] [--no-hidden] [--no-exclusions]
        [--not-recursive] [--follow-links] [--filter txt,csv] [--format csv] [--history PATH]
        [--master local[*]]

Prints the run row (12 history fields) as one JSON line.
"""

from __future__ import annotations

import argparse
import json
import sys


def _pairs(items):
    out = {}
    for it in items or ():
        key, _, pat = it.partition("=")
        out[key.strip()] = pat
    return out


def main(argv=None) -> int:
    ap = argparse.ArgumentParser(prog="piisift")
    sub = ap.add_subparsers(dest="cmd", required=True)
    sc = sub.add_parser("scan", help="scan folders for personal data")
    sc.add_argument("paths", nargs="*", help="folders (default: those given by --root)")
    sc.add_argument("--root", action="append", help="configured folder, scanned when no path is given")
    sc.add_argument("--extensions", help="comma-separated supported extensions (default: the built-in list)")
    sc.add_argument("--exclude-path", action="append", help="folder left out with everything below it")
    sc.add_argument("--exclude-folder", action="append", help="folder name left out anywhere (replaces the built-in list)")
    sc.add_argument("--out", required=True, help="folder for the findings table and reports")
    sc.add_argument("--types", help="comma-separated type names (default: all)")
    sc.add_argument("--pattern", action="append", help="TYPE=REGEX, replaces that type's pattern")
    sc.add_argument("--no-hidden", action="store_true")
    sc.add_argument("--no-exclusions", action="store_true")
    sc.add_argument("--not-recursive", action="store_true")
    sc.add_argument("--follow-links", action="store_true")
    sc.add_argument("--filter", help="comma-separated extensions to keep")
    sc.add_argument("--format", default="csv", help="report format: csv, excel, parquet, json")
    sc.add_argument("--history", help="history table to append the run row to")
    sc.add_argument("--on-missing", default="error", choices=["error", "skip"])
    sc.add_argument("--master", help="Spark master when no session is configured")
    a = ap.parse_args(argv)

    from pyspark.sql import SparkSession

    from .operators.run import run_scan
    from .session import ensure_checkpoint_dir, ship_package
    from .sources.paths import ScanConfig, ScanOptions

    builder = SparkSession.builder.appName("piisift-scan")
    if a.master:
        builder = builder.master(a.master)
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    opts = ScanOptions(recursive=not a.not_recursive, include_hidden_files=not a.no_hidden,
                       exclude_configured_paths=not a.no_exclusions, follow_symbolic_links=a.follow_links,
                       file_type_filters=a.filter.split(",") if a.filter else None)
    given = {"supported_extensions": a.extensions and tuple(e.strip().lower() for e in a.extensions.split(",")),
             "excluded_paths": a.exclude_path, "excluded_folder_names": a.exclude_folder, "roots": a.root}
    config = ScanConfig(**{k: tuple(v) for k, v in given.items() if v})
    types = [t.strip() for t in (a.types or "").split(",") if t.strip()] or None
    try:
        run = run_scan(spark, a.paths or None, types=types, custom_patterns=_pairs(a.pattern), options=opts,
                       config=config, on_missing=a.on_missing)
    except (ValueError, FileNotFoundError) as exc:
        print(json.dumps({"error": str(exc)}), file=sys.stderr)
        return 2
    row = run.write(a.out, a.format, history_path=a.history).first().asDict()
    print(json.dumps({k: (v.isoformat() if hasattr(v, "isoformat") else v) for k, v in row.items()}))
    return 0


if __name__ == "__main__":
    sys.exit(main())
