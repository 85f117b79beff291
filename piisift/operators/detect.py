"""Detection: text → candidates → findings, in one narrow pass.

For every chosen type the plan holds one ``regexp_extract_all`` over the text.
The type's validator, mask and risk are applied *inside* that type's branch,
so no per-row type dispatch is left and the raw value never becomes a column
of the findings.  The per-type arrays are concatenated and exploded once:
Project → Generate → Project, no Exchange, so the same function serves batch
tables and Structured Streaming alike.
"""

from __future__ import annotations

from typing import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.checks import digits_only
from ..functions.types import (BUILTIN_GUARDS, GUARD_IMPLIES, NORMAL, Detector, java_compile_check,
                              resolve_types)

CANDIDATE_TYPE = T.ArrayType(T.StructType([
    T.StructField("data_type", T.StringType()),
    T.StructField("match_idx", T.LongType()),
    T.StructField("value", T.StringType()),
]))
CANDIDATE_VALID_TYPE = T.ArrayType(T.StructType(
    CANDIDATE_TYPE.elementType.fields + [T.StructField("is_valid", T.BooleanType())]))
FINDING_TYPE = T.ArrayType(T.StructType([
    T.StructField("data_type", T.StringType()),
    T.StructField("risk_level", T.StringType()),
    T.StructField("match_idx", T.LongType()),
    T.StructField("masked_value", T.StringType()),
]))


def _matches(text: Column, det: Detector) -> Column:
    """array<string>: every non-overlapping match, left to right."""
    return F.regexp_extract_all(text, F.lit(det.pattern), F.lit(0))


def _indexed(found: Column, with_digits: bool) -> Column:
    """array<struct<i, v[, d]>>; ``d`` = the value stripped to digits, made once
    for a checksum that reads it many times."""
    def build(v, i):
        fields = [i.cast("long").alias("i"), v.alias("v")]
        if with_digits:
            fields.append(digits_only(v).alias("d"))
        return F.struct(*fields)
    return F.transform(found, build)


def _guard_name(det: Detector) -> str:
    """Column key of a guard: built-in guards by name (so equal guards are
    shared and the digit-run chain applies), any other by identity."""
    name = getattr(det.guard, "__name__", "")
    if BUILTIN_GUARDS.get(name) is det.guard:
        return name
    return f"user{id(det.guard)}"


def _guarded(text: Column, det: Detector, arr: Column, empty_type: T.DataType,
             use_guards: bool, guard_cols: Mapping[str, str] | None = None) -> Column:
    if use_guards and det.guard is not None:
        cond = F.col(guard_cols[_guard_name(det)]) if guard_cols else det.guard(text)
        return F.when(cond, arr).otherwise(F.array().cast(empty_type))
    return arr


def with_guards(df: DataFrame, text_col: str, detectors: Sequence[Detector],
                use_guards: bool = True) -> tuple[DataFrame, dict[str, str]]:
    """Evaluate every distinct guard once, as a column, before the regex work.

    A stronger guard (longer digit run) is only tested where the weaker one
    held, so text without digits is read once by the cheapest test only.
    """
    if not use_guards:
        return df, {}
    text = F.col(text_col)
    guards: dict[str, Column] = {}
    for det in detectors:
        if det.guard is not None:
            guards.setdefault(_guard_name(det), det.guard(text))
    names = {g: f"__guard_{g}" for g in guards}
    out = df
    for g in sorted(guards, key=_guard_depth):
        cond = guards[g]
        weaker = GUARD_IMPLIES.get(g)
        while weaker is not None and weaker not in names:
            weaker = GUARD_IMPLIES.get(weaker)
        if weaker is not None:
            cond = F.col(names[weaker]) & cond
        out = out.withColumn(names[g], cond)
    return out, names


def _guard_depth(name: str) -> int:
    d = 0
    while name in GUARD_IMPLIES:
        name, d = GUARD_IMPLIES[name], d + 1
    return d


def _as_column(text) -> Column:
    return F.col(text) if isinstance(text, str) else text


# Built expressions, by session and arguments.  An expression refers to its
# input columns by name only, so one build serves every DataFrame of the
# session; building the ~11-branch expression costs hundreds of driver calls.
_EXPR_CACHE: dict[tuple, Column] = {}


def _cached(kind: str, text, detectors, use_guards, guard_cols, extra, build) -> Column:
    if not isinstance(text, str):
        return build()
    from pyspark.sql import SparkSession
    session = SparkSession.getActiveSession()
    if session is None:
        return build()
    # expressions live in the application's JVM: an id of a later one never meets them
    key = (kind, session.sparkContext.applicationId, text, tuple(detectors), use_guards,
           tuple(sorted((guard_cols or {}).items())), extra)
    try:
        hit = _EXPR_CACHE.get(key)
    except TypeError:  # an unhashable user detector: build each time
        return build()
    if hit is None:
        hit = _EXPR_CACHE[key] = build()
    return hit


def candidate_array(text, detectors: Sequence[Detector], use_guards: bool = True,
                    guard_cols: Mapping[str, str] | None = None, with_validity: bool = False) -> Column:
    """All raw candidates of a text as array<struct<data_type, match_idx, value
    [, is_valid]>>; ``is_valid`` applies the type's own validator in its branch."""
    return _cached("candidates", text, detectors, use_guards, guard_cols, with_validity,
                   lambda: _candidate_array(text, detectors, use_guards, guard_cols, with_validity))


def _candidate_array(text, detectors, use_guards, guard_cols, with_validity) -> Column:
    text = _as_column(text)
    empty = CANDIDATE_VALID_TYPE if with_validity else CANDIDATE_TYPE
    parts = []
    for det in detectors:
        found = _matches(text, det)
        if with_validity:
            raw = _indexed(found, det.digits_validator is not None)
            arr = F.transform(raw, _candidate_struct(det, with_validity))
        else:  # one pass: (value, index) → candidate
            arr = F.transform(found, _candidate_of(det))
        parts.append(_guarded(text, det, arr, empty, use_guards, guard_cols))
    return F.flatten(F.array(*parts)) if parts else F.array().cast(empty)


def _candidate_of(det: Detector):
    def build(v: Column, i: Column) -> Column:
        return F.struct(F.lit(det.name).alias("data_type"), i.cast("long").alias("match_idx"),
                        v.alias("value"))
    return build


def _candidate_struct(det: Detector, with_validity: bool = False):
    def build(x: Column) -> Column:
        fields = [F.lit(det.name).alias("data_type"), x["i"].alias("match_idx"), x["v"].alias("value")]
        if with_validity:
            if det.digits_validator is not None:
                ok = det.digits_validator(x["d"])
            elif det.validator is not None:
                ok = det.validator(x["v"])
            else:
                ok = F.lit(True)
            fields.append(ok.alias("is_valid"))
        return F.struct(*fields)
    return build


def _validity(det: Detector):
    # F.filter passes exactly the lambda's declared arguments: bind via closure
    def keep(x: Column) -> Column:
        if det.digits_validator is not None:
            return det.digits_validator(x["d"])
        return det.validator(x["v"])
    return keep


def _finding_of(det: Detector):
    def build(v: Column, i: Column) -> Column:
        return F.struct(F.lit(det.name).alias("data_type"), F.lit(det.risk or NORMAL).alias("risk_level"),
                        i.cast("long").alias("match_idx"), det.mask(v).alias("masked_value"))
    return build


def _finding_struct(det: Detector):
    def build(x: Column) -> Column:
        return F.struct(F.lit(det.name).alias("data_type"),
                        F.lit(det.risk or NORMAL).alias("risk_level"),
                        x["i"].alias("match_idx"),
                        det.mask(x["v"]).alias("masked_value"))
    return build


def finding_array(text, detectors: Sequence[Detector], use_guards: bool = True,
                  guard_cols: Mapping[str, str] | None = None) -> Column:
    """Validated, masked findings of a text as array<struct<data_type, risk_level,
    match_idx, masked_value>>; the raw value stays inside the expression."""
    return _cached("findings", text, detectors, use_guards, guard_cols, None,
                   lambda: _finding_array(text, detectors, use_guards, guard_cols))


def _finding_array(text, detectors, use_guards, guard_cols) -> Column:
    text = _as_column(text)
    parts = []
    for det in detectors:
        found = _matches(text, det)
        if det.validator is not None:
            arr = F.filter(_indexed(found, det.digits_validator is not None), _validity(det))
            arr = F.transform(arr, _finding_struct(det))
        else:  # one pass: (value, index) → masked finding
            arr = F.transform(found, _finding_of(det))
        parts.append(_guarded(text, det, arr, FINDING_TYPE, use_guards, guard_cols))
    return F.flatten(F.array(*parts)) if parts else F.array().cast(FINDING_TYPE)


CHECKED_TYPE = T.ArrayType(T.StructType(FINDING_TYPE.elementType.fields + [T.StructField("is_valid", T.BooleanType())]))


def checked_array(text, detectors: Sequence[Detector], use_guards: bool = True,
                  guard_cols: Mapping[str, str] | None = None) -> Column:
    """Every candidate, masked and classified, with the verdict of its validator: findings whose
    ``match_idx`` is still to be moved need the invalid candidates before them, but never their values."""
    return _cached("checked", text, detectors, use_guards, guard_cols, None,
                   lambda: _checked_array(text, detectors, use_guards, guard_cols))


def _checked_array(text, detectors, use_guards, guard_cols) -> Column:
    text = _as_column(text)
    parts = []
    for det in detectors:
        raw = _indexed(_matches(text, det), det.digits_validator is not None)
        arr = F.transform(raw, _checked_struct(det))
        parts.append(_guarded(text, det, arr, CHECKED_TYPE, use_guards, guard_cols))
    return F.flatten(F.array(*parts)) if parts else F.array().cast(CHECKED_TYPE)


def _checked_struct(det: Detector):
    finding, keep = _finding_struct(det), None if det.validator is None else _validity(det)

    def build(x: Column) -> Column:
        f = finding(x)
        return F.struct(*[f[n].alias(n) for n in FINDING_TYPE.elementType.fieldNames()],
                        (F.lit(True) if keep is None else keep(x)).alias("is_valid"))
    return build


def _resolve(df: DataFrame, types, custom_patterns, detectors) -> list[Detector]:
    """Chosen detectors; user patterns are compiled by Java, as Spark will."""
    check = None
    if custom_patterns and any(p and str(p).strip() for p in custom_patterns.values()):
        try:
            check = java_compile_check(df.sparkSession)
        except Exception:  # noqa: BLE001 - no session access: fall back to a Python check
            check = None
    return resolve_types(types, custom_patterns, detectors, compile_check=check)


def _keys(key_cols) -> list[str]:
    if key_cols is None:
        return []
    return [key_cols] if isinstance(key_cols, str) else list(key_cols)


def _spread(df: DataFrame, num_partitions: int | None) -> DataFrame:
    return df.repartition(num_partitions) if num_partitions else df


def candidates(df: DataFrame, text_col: str = "text", key_cols: Iterable[str] | str | None = None,
               types: Sequence[str] | None = None,
               custom_patterns: Mapping[str, str] | None = None,
               detectors: Sequence[Detector] | None = None, use_guards: bool = True,
               num_partitions: int | None = None, with_validity: bool = False) -> DataFrame:
    """Raw detector output, before validation: keys…, data_type, match_idx, value
    (and ``is_valid`` by the type's validator when ``with_validity``).

    One row per match; no dedup and no overlap resolution across types.
    """
    chosen = _resolve(df, types, custom_patterns, detectors)
    keys = _keys(key_cols)
    src = _spread(df.select(*keys, F.col(text_col).alias("__text")), num_partitions)
    src, gcols = with_guards(src, "__text", chosen, use_guards)
    return src.select(*keys, F.inline(candidate_array("__text", chosen, use_guards, gcols, with_validity)))


def scan(df: DataFrame, text_col: str = "text", key_cols: Iterable[str] | str | None = None,
         types: Sequence[str] | None = None, custom_patterns: Mapping[str, str] | None = None,
         detectors: Sequence[Detector] | None = None, scan_ts: Column | str | None = None,
         use_guards: bool = True, num_partitions: int | None = None) -> DataFrame:
    """Find, validate, mask and classify personal data in ``df[text_col]``.

    Returns keys…, data_type, risk_level, match_idx, masked_value, scan_ts.

    * ``types``: names to run (None → all).  Unknown names raise ValueError.
    * ``custom_patterns``: type → Java regex replacing that type's pattern;
      validator, mask and risk of the type still apply.  User patterns run
      unguarded; a pattern with heavy back-tracking is the caller's risk.
    * ``detectors``: a full registry (e.g. built-ins plus a user Detector).
    * ``scan_ts``: fixed timestamp for the run; default is the query's
      ``localtimestamp()`` (one value per query, TIMESTAMP_NTZ).
    * ``num_partitions``: spread the input round-robin before the regex work,
      for inputs that arrive in a few large partitions.  Documents are never
      split, since a match may straddle any cut.
    """
    chosen = _resolve(df, types, custom_patterns, detectors)
    keys = _keys(key_cols)
    if scan_ts is None:
        ts = F.localtimestamp()
    elif isinstance(scan_ts, Column):
        ts = scan_ts
    else:
        ts = F.lit(scan_ts).cast("timestamp_ntz")
    src = _spread(df.select(*keys, F.col(text_col).alias("__text")), num_partitions)
    src, gcols = with_guards(src, "__text", chosen, use_guards)
    found = src.select(*keys, F.inline(finding_array("__text", chosen, use_guards, gcols)))
    return found.withColumn("scan_ts", ts)


def findings_per_row(df: DataFrame, text_col: str = "text", types: Sequence[str] | None = None,
                     custom_patterns: Mapping[str, str] | None = None,
                     detectors: Sequence[Detector] | None = None, use_guards: bool = True,
                     only_if: Column | None = None, out_col: str = "findings") -> DataFrame:
    """Every input row with its findings as one array column (nothing exploded).

    Per-row counts, flags or nested payloads are then plain array functions
    on ``out_col`` — the per-group aggregates need no second pass over the
    text and no shuffle of single findings.  ``only_if``: rows where it is
    false get an empty array without running any regex.
    """
    chosen = _resolve(df, types, custom_patterns, detectors)
    src, gcols = with_guards(df, text_col, chosen, use_guards)
    arr = finding_array(text_col, chosen, use_guards, gcols)
    if only_if is not None:
        arr = F.when(only_if, arr).otherwise(F.array().cast(FINDING_TYPE))
    return src.withColumn(out_col, arr).drop(*gcols.values())
