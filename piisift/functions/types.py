"""The type dimension: what each kind of personal data looks like.

Every detector is a regular expression plus three column functions
(validator, mask, risk).  All of them are plain Spark expressions, so the
whole detection step stays inside the JVM and needs no Python UDF.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import checks, masks

# --------------------------------------------------------------------------
# Fixed values (must equal the reference for equal results).
# Type names in their fixed order, risk level, display label and pattern.
# Patterns are given verbatim in Java syntax, with the original \b.
# --------------------------------------------------------------------------
CRITICAL, MEDIUM, NORMAL = "CRITICAL", "MEDIUM", "NORMAL"
RISK_LEVELS = (CRITICAL, MEDIUM, NORMAL)

TYPE_TABLE = [
    # name,            risk,     label,                 pattern
    ("CARD_NUMBER",     CRITICAL, "Card Number",
     r"\b(?:4\d{12}(?:\d{3})?|5[1-5]\d{14}|2(?:2[2-9][1-9]|[3-6]\d{2}|7(?:[01]\d|20))\d{12}|3[47]\d{13}|3(?:0[0-5]|[68]\d)\d{11}|6(?:011|5\d{2})\d{12}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7})\b"),
    ("AADHAAR_NUMBER",  CRITICAL, "Aadhaar Number",      r"\b[2-9]\d{3}[ -]?\d{4}[ -]?\d{4}\b"),
    ("PAN_NUMBER",      MEDIUM,   "PAN Number",          r"\b[A-Z]{3}[ABCFGHJLPT][A-Z]\d{4}[A-Z]\b"),
    ("PASSPORT",        CRITICAL, "Passport Number",     r"\b[A-Z][0-9]{7}\b"),
    ("DRIVING_LICENCE", MEDIUM,   "Driving Licence",     r"\b[A-Z]{2}[- ]?\d{2}[- ]?\d{4}[- ]?\d{7}\b"),
    ("VOTER_ID",        MEDIUM,   "Voter ID",            r"\b[A-Z]{3}[0-9]{7}\b"),
    ("BANK_ACCOUNT",    CRITICAL, "Bank Account Number", r"\b\d{9,18}\b"),
    ("IFSC",            MEDIUM,   "IFSC Code",           r"\b[A-Z]{4}0[A-Z0-9]{6}\b"),
    ("UPI_ID",          MEDIUM,   "UPI ID",              r"\b[a-zA-Z0-9.\-_]{2,256}@[a-zA-Z]{3,64}\b(?!\.)"),
    ("PHONE_NUMBER",    NORMAL,   "Phone Number",        r"\b(?:(?:\+91|91)[-\s]?)?[6-9]\d{9}\b"),
    ("EMAIL",           NORMAL,   "Email Address",       r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
]

# Caveat attached to any run with a card finding (fixed text).
CARD_NOTICE = ("Card number findings passed the Luhn checksum, which only confirms the number is "
               "mathematically well-formed. Luhn Pass ≠ Real/Active Card — it does NOT "
               "confirm the card is genuine, active, or usable.")
# --------------------------------------------------------------------------

TYPE_NAMES = tuple(t[0] for t in TYPE_TABLE)

# Java 17 treats accented letters as word characters for \b, Java 21 (and the
# reference) does not.  We spell the ASCII boundary out with look-arounds.
_W = r"\w"
# the look-ahead comes first: it is the cheaper test
BOUNDARY_LONG = rf"(?:(?={_W})(?<!{_W})|(?!{_W})(?<={_W}))"
BOUNDARY_BEFORE_WORD = rf"(?<!{_W})"   # \b right before a certain word character
BOUNDARY_AFTER_WORD = rf"(?!{_W})"     # \b right after a certain word character


_ATOM = re.compile(r"\\d|\[(?:[A-Za-z0-9]-[A-Za-z0-9]|[A-Za-z0-9_.%+]|\\[.d-])+-?\]")
_AT_LEAST_ONE = re.compile(r"\+|\{[1-9][0-9]*(?:,[0-9]*)?\}|(?![*?{])")
_FLAGS = re.compile(r"\(\?[A-Za-z-]")


def _atom_after(pattern: str, at: int) -> str | None:
    """The plain class or ``\\d`` that certainly comes right after ``at``, once or more."""
    found = _ATOM.match(pattern, at)
    return found[0] if found and _AT_LEAST_ONE.match(pattern, found.end()) else None


_CLASS = re.compile(r"\[((?:[A-Za-z0-9]-[A-Za-z0-9]|[A-Za-z0-9_.%+]|\\[.-])+)(-?)\]")
_NOT_PLAIN = re.compile(r"\\Q|\\\[|\[[^\]]*\[|&&")


def spelled_classes(pattern: str) -> str:
    """Classes of several ranges with each character spelled out: Java tests them by one table, not range by range."""
    if _FLAGS.search(pattern) or _NOT_PLAIN.search(pattern):
        return pattern

    def spell(found: re.Match) -> str:
        if len(re.findall(r"[A-Za-z0-9]-[A-Za-z0-9]", found[1])) < 2:
            return found[0]
        each = lambda r: "".join(map(chr, range(ord(r[0][0]), ord(r[0][2]) + 1)))
        return "[" + re.sub(r"[A-Za-z0-9]-[A-Za-z0-9]", each, found[1]) + found[2] + "]"

    return _CLASS.sub(spell, pattern)


def ascii_boundaries(pattern: str, lead_word: bool = False, tail_word: bool = False) -> str:
    """Rewrite every ``\\b`` outside a character class into an ASCII-only form.

    ``lead_word``/``tail_word`` say that the first/last ``\\b`` of the pattern
    sits next to a character that is certainly a word character; there the
    cheaper one-sided look-around is equal to the full boundary.
    """
    out: list[str] = []
    positions: list[int] = []
    i, in_class, n = 0, False, len(pattern)
    flags = _FLAGS.search(pattern) is not None  # case, comments and Unicode classes change what a class means
    while i < n:
        ch = pattern[i]
        if ch == "\\" and i + 1 < n:
            nxt = pattern[i + 1]
            if nxt == "b" and not in_class:
                positions.append(len(out))
                # a boundary costs most where no match can begin, so the next character is tested before it
                atom = None if flags else _atom_after(pattern, i + 2)
                if atom is None:
                    out.append(BOUNDARY_LONG)
                else:
                    out.append(rf"(?={atom})" + (BOUNDARY_BEFORE_WORD if atom == r"\d" else BOUNDARY_LONG))
            elif nxt == "Q":  # quoted span: copy through \E untouched
                end = pattern.find("\\E", i + 2)
                end = n if end < 0 else end + 2
                out.append(pattern[i:end])
                i = end
                continue
            else:
                out.append(pattern[i:i + 2])
            i += 2
            continue
        if ch == "[" and not in_class:
            in_class = True
            out.append(ch)
            # a ']' right after '[' or '[^' is a literal
            j = i + 1
            if j < n and pattern[j] == "^":
                out.append("^")
                j += 1
            if j < n and pattern[j] == "]":
                out.append("]")
                j += 1
            i = j
            continue
        if ch == "]" and in_class:
            in_class = False
        out.append(ch)
        i += 1
    if positions:
        if lead_word and positions[0] == 0:
            atom = _atom_after(pattern, 2)
            out[0] = (f"(?={atom})" if atom and not flags else "") + BOUNDARY_BEFORE_WORD
        if tail_word and positions[-1] == len(out) - 1:
            out[-1] = BOUNDARY_AFTER_WORD
        elif tail_word and "".join(out[positions[-1] + 1:]) == r"(?!\.)":
            out[positions[-1]] = BOUNDARY_AFTER_WORD
    return "".join(out)


# Equal forms of built-in patterns that Java runs faster: a run before '@' holds no '@', so none of it is given
# back; a phone number begins with '+' or a digit from 6 on.
_FASTER = {
    "UPI_ID": (r"[a-zA-Z0-9.\-_]{2,256}@", r"[a-zA-Z0-9.\-_]{2,256}+@"),
    "EMAIL": (r"[A-Za-z0-9._%+-]+@", r"[A-Za-z0-9._%+-]++@"),
    "PHONE_NUMBER": (BOUNDARY_LONG, r"(?=[+6-9])" + BOUNDARY_LONG),
}


def _digits(n: int) -> Callable[[Column], Column]:
    """A run of at least ``n`` digits (a necessary condition of the pattern)."""
    def guard(text: Column) -> Column:
        return text.rlike(f"[0-9]{{{n}}}")
    guard.__name__ = f"digits{n}"
    return guard


_digits_run = _digits(4)
_digits7 = _digits(7)
_digits9 = _digits(9)
_digits10 = _digits(10)


def _has_at(text: Column) -> Column:
    return F.instr(text, "@") > 0


def _ifsc_head(text: Column) -> Column:
    return text.rlike("[A-Z]{4}0")


# A longer run implies a shorter one: each guard is evaluated only when the
# weaker one holds (``implies`` names the weaker guard).
GUARD_IMPLIES = {"digits7": "digits4", "digits9": "digits7", "digits10": "digits9"}


@dataclass(frozen=True)
class Detector:
    """One kind of personal data.

    ``validator`` and ``mask`` map a raw-value Column to a boolean / string
    Column.  ``guard`` is a cheap predicate on the whole text that is false
    only when the pattern cannot match; it lets Spark skip the regex.
    """

    name: str
    pattern: str                      # Java regex as run by Spark
    risk: str = NORMAL
    label: str | None = None
    validator: Callable[[Column], Column] | None = None
    mask: Callable[[Column], Column] = masks.mask_last4
    guard: Callable[[Column], Column] | None = None
    source_pattern: str | None = field(default=None, compare=False)
    # checksum on the digits-only form (lets a caller strip the value once)
    digits_validator: Callable[[Column], Column] | None = None
    # a match never holds a cut as ``operators.pieces`` makes them; unknown for user patterns
    cuttable: bool = field(default=False, compare=False)

    def with_pattern(self, pattern: str, rewrite_boundaries: bool = True) -> "Detector":
        """Same type (validator, mask, risk) with a user pattern and no guard."""
        spark_pattern = spelled_classes(ascii_boundaries(pattern)) if rewrite_boundaries else pattern
        return Detector(self.name, spark_pattern, self.risk, self.label, self.validator,
                        self.mask, None, pattern, self.digits_validator)


# Which ends of each built-in pattern are certainly word characters, which
# cheap guard applies, and which validator / mask belong to the type.
_ENDS = {  # name: (lead_word, tail_word)
    "CARD_NUMBER": (True, True), "AADHAAR_NUMBER": (True, True), "PAN_NUMBER": (True, True),
    "PASSPORT": (True, True), "DRIVING_LICENCE": (True, True), "VOTER_ID": (True, True),
    "BANK_ACCOUNT": (True, True), "IFSC": (True, True), "UPI_ID": (False, True),
    "PHONE_NUMBER": (False, True), "EMAIL": (False, True),
}
_GUARDS = {  # each pattern needs: card 4-digit groups, Aadhaar/PAN 4 digits,
    # passport/licence/voter 7, bank 9, phone 10 consecutive digits; IFSC four
    # capitals and a '0'; e-mail and UPI an '@'
    "CARD_NUMBER": _digits_run, "AADHAAR_NUMBER": _digits_run, "PAN_NUMBER": _digits_run,
    "PASSPORT": _digits7, "DRIVING_LICENCE": _digits7, "VOTER_ID": _digits7,
    "BANK_ACCOUNT": _digits9, "PHONE_NUMBER": _digits10, "IFSC": _ifsc_head,
    "UPI_ID": _has_at, "EMAIL": _has_at,
}
BUILTIN_GUARDS = {g.__name__: g for g in set(_GUARDS.values())}
_VALIDATORS = {"CARD_NUMBER": checks.luhn_valid, "AADHAAR_NUMBER": checks.verhoeff_valid}
_DIGIT_VALIDATORS = {"CARD_NUMBER": checks.luhn_digits, "AADHAAR_NUMBER": checks.verhoeff_digits}
_MASKS = {"PAN_NUMBER": masks.mask_pan, "UPI_ID": masks.mask_email_like,
          "EMAIL": masks.mask_email_like}


def _builtin(name: str, risk: str, label: str, pattern: str) -> Detector:
    lead, tail = _ENDS[name]
    java = spelled_classes(ascii_boundaries(pattern, lead, tail).replace(*_FASTER.get(name, ("", "")), 1))
    return Detector(name=name, pattern=java, risk=risk,
                    label=label, validator=_VALIDATORS.get(name),
                    mask=_MASKS.get(name, masks.mask_last4), guard=_GUARDS[name],
                    source_pattern=pattern, digits_validator=_DIGIT_VALIDATORS.get(name), cuttable=True)


BUILTIN_DETECTORS: tuple[Detector, ...] = tuple(_builtin(*row) for row in TYPE_TABLE)
BY_NAME = {d.name: d for d in BUILTIN_DETECTORS}
RISK_BY_TYPE = {d.name: d.risk for d in BUILTIN_DETECTORS}
LABEL_BY_TYPE = {d.name: d.label for d in BUILTIN_DETECTORS}


# --------------------------------------------------------------------------
# Answers to a bad request, which callers show and parse.
# --------------------------------------------------------------------------
BAD_TYPES = "Invalid data type(s): {}. Valid options: {}"
BAD_PATTERN_TYPE = "Unknown PII type '{}' in customPatterns"
BAD_PATTERN = "Invalid regex for {}: {}"
# --------------------------------------------------------------------------


def resolve_types(types=None, custom_patterns=None, detectors=None,
                  rewrite_boundaries: bool = True, compile_check=None) -> list[Detector]:
    """Pick the detectors of one run (plan-time; no data is touched).

    ``types``: None/empty → all.  Unknown names and bad custom patterns are
    gathered and reported together, as one ``ValueError``.
    """
    registry = list(detectors) if detectors is not None else list(BUILTIN_DETECTORS)
    by_name = {d.name: d for d in registry}
    if types:  # names are exact (case-sensitive), as enum names
        unknown = [t for t in types if t not in by_name]
        if unknown:
            raise ValueError(BAD_TYPES.format(', '.join(map(str, unknown)), ', '.join(by_name)))
        chosen = [d for d in registry if d.name in set(types)]
    else:
        chosen = registry
    errors: list[str] = []
    overrides: dict[str, Detector] = {}
    for name, pat in (custom_patterns or {}).items():
        if pat is None or not str(pat).strip():
            continue  # a blank pattern keeps the type's own
        if name not in by_name:
            errors.append(BAD_PATTERN_TYPE.format(name))
            continue
        try:
            if compile_check is not None:  # else Java compiles it at run time
                compile_check(pat)
        except Exception as exc:  # noqa: BLE001 - any compile error is the user's
            errors.append(BAD_PATTERN.format(name, exc))
            continue
        overrides[name] = by_name[name].with_pattern(pat, rewrite_boundaries)
    if errors:
        raise ValueError(" | ".join(errors))
    return [overrides.get(d.name, d) for d in chosen]


def java_compile_check(spark):
    """A check that compiles the pattern with Java's engine (the one Spark
    runs), through a one-row query on a literal; raises with Java's message."""
    def check(pattern: str) -> None:
        try:
            spark.range(1).select(F.regexp_extract_all(F.lit(""), F.lit(pattern), F.lit(0))).collect()
        except Exception as exc:  # noqa: BLE001
            text = str(exc)
            raise ValueError(text.splitlines()[0] if text else repr(exc)) from None
    return check


def type_dimension_rows(detectors=None):
    registry = list(detectors) if detectors is not None else list(BUILTIN_DETECTORS)
    return [(i, d.name, d.risk, d.label or d.name, d.source_pattern or d.pattern,
             d.validator is not None) for i, d in enumerate(registry)]
