"""Scanning of giant texts in pieces (F1): one document on many tasks, with the findings of a whole scan.

A text may be cut where no match of a built-in pattern can lie across the cut and where the
patterns' look-arounds see the same as at the end of a text:

* after a character that no pattern contains and that is no word character (a comma, a quote, an accented
  letter); all patterns together contain ASCII letters and digits, ``. _ % + @ -`` and white space;
* after white space that no digit follows: inside a match, white space always stands before a digit.

Pieces are at least ``PIECE_CHARS`` long and end at the next such place; where none comes the piece goes on, so a
text without any stays whole.  Pieces are dealt round-robin, scanned like texts, and their candidates
numbered again: a candidate's index is its index in the piece plus the number of that type's candidates in
the pieces before, a running sum over one short row per piece and type.  Values are masked before they leave the task.

User patterns may contain anything, so types with a user pattern, and user detectors, see long texts whole.
Texts up to ``LONG_CHARS`` take the narrow path of :func:`piisift.operators.detect.scan` and are not moved.
"""

from __future__ import annotations

from typing import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.types import Detector
from .browse import stored
from .detect import _keys, _resolve, checked_array, scan, with_guards

#: Characters of a piece (before it goes on to a cut); texts longer than this many are cut; pieces per task.
PIECE_CHARS, LONG_CHARS, PIECES_PER_TASK = 65_536, 1_000_000, 32


def piece_pattern(chars: int = PIECE_CHARS) -> str:
    """Java regex whose matches, one after the other, are a text's pieces."""
    return rf"(?s).{{{chars}}}.*?(?:[^A-Za-z0-9_.%+@\s-]|\s(?!\d)|\z)|.+"


def pieces(df: DataFrame, text_col: str, chars: int = PIECE_CHARS) -> DataFrame:
    """Every text's pieces: the columns of ``df`` but the text, ``__row``, ``__piece`` and ``__text``, dealt
    over the cluster."""
    rows = df.withColumn("__row", F.monotonically_increasing_id())
    others = [c for c in rows.columns if c != text_col]
    cut = F.regexp_extract_all(F.col(text_col), F.lit(piece_pattern(chars)), F.lit(0))
    length = df.agg(F.sum(F.length(text_col))).first()[0] or 0  # one number
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, length // (chars * PIECES_PER_TASK))
    return rows.select(*others, F.posexplode(cut).alias("__piece", "__text")).repartition(tasks)


def _scan_cut(df: DataFrame, text_col: str, keys: list[str], detectors: Sequence[Detector], chars: int,
              use_guards: bool) -> DataFrame:
    cut = pieces(df.select(*keys, F.col(text_col).alias("__long")), "__long", chars)
    cut, guards = with_guards(cut, "__text", detectors, use_guards)
    found = stored(cut.select(*keys, "__row", "__piece", F.inline(checked_array("__text", detectors, use_guards, guards))), "pieces")
    counts = found.groupBy("__row", "data_type", "__piece").count()
    before = Window.partitionBy("__row", "data_type").orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("__row", "data_type", "__piece", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    return (found.join(bases, ["__row", "data_type", "__piece"]).filter("is_valid")
            .select(*keys, "data_type", "risk_level", (F.col("match_idx") + F.col("__before")).alias("match_idx"), "masked_value"))


def scan_long(df: DataFrame, text_col: str = "text", key_cols: Iterable[str] | str | None = None,
              types: Sequence[str] | None = None, custom_patterns: Mapping[str, str] | None = None,
              detectors: Sequence[Detector] | None = None, scan_ts: Column | str | None = None,
              use_guards: bool = True, chars: int = PIECE_CHARS, long_chars: int = LONG_CHARS) -> DataFrame:
    """:func:`piisift.operators.detect.scan` with the same rows, for tables in which some texts are giant."""
    chosen = _resolve(df, types, custom_patterns, detectors)
    keys = _keys(key_cols)
    ts = F.localtimestamp() if scan_ts is None else scan_ts if isinstance(scan_ts, Column) else F.lit(scan_ts).cast("timestamp_ntz")
    is_long = F.coalesce(F.length(text_col) > long_chars, F.lit(False))
    cuttable = [d for d in chosen if d.cuttable]
    whole = [d for d in chosen if not d.cuttable]
    out = scan(df.filter(~is_long), text_col, keys, detectors=chosen, use_guards=use_guards).drop("scan_ts")
    if whole and chosen:
        out = out.unionByName(scan(df.filter(is_long), text_col, keys, detectors=whole, use_guards=use_guards).drop("scan_ts"))
    if cuttable:
        out = out.unionByName(_scan_cut(df.filter(is_long), text_col, keys, cuttable, chars, use_guards))
    return out.withColumn("scan_ts", ts)
