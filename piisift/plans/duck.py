"""DuckDB (RE2) forms of the detection steps, for the oracle SQL only.

RE2's ``\\b`` is ASCII, so the original patterns are used as they are.  RE2
has no look-ahead: the UPI tail ``\\b(?!\\.)`` becomes a consumed
non-[word or dot] character (or the end) and the handle is taken from group 1.
"""

from __future__ import annotations

from ..functions.checks import VERHOEFF_D, VERHOEFF_P
from ..functions.types import TYPE_TABLE

UPI_RE2 = r"\b([a-zA-Z0-9.\-_]{2,256}@[a-zA-Z]{3,64})(?:[^A-Za-z0-9_.]|$)"
PATTERNS = {name: (pat, 0) for name, _r, _l, pat in TYPE_TABLE}
PATTERNS["UPI_ID"] = (UPI_RE2, 1)
RISK = {name: risk for name, risk, _l, _p in TYPE_TABLE}
LABEL = {name: label for name, _r, label, _p in TYPE_TABLE}
NAMES = [name for name, *_ in TYPE_TABLE]
LAST4 = ("CARD_NUMBER", "AADHAAR_NUMBER", "BANK_ACCOUNT", "PHONE_NUMBER", "PASSPORT",
         "DRIVING_LICENCE", "VOTER_ID", "IFSC")


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def candidates(names=None, rel="corpus", keys=("src", "doc_id"), text="text", patterns=None) -> str:
    """union of per-type candidate rows: keys…, data_type, match_idx, value."""
    k = ", ".join(keys)
    pats = dict(PATTERNS)
    pats.update(patterns or {})
    parts = []
    for name in names or NAMES:
        pat, grp = pats[name]
        parts.append(
            f"select {k}, {q(name)} as data_type, cast(m.i as bigint) as match_idx, m.v as value "
            f"from (select {k}, unnest(list_transform(regexp_extract_all({text}, {q(pat)}, {grp}), "
            f"lambda x, i: {{'v': x, 'i': i - 1}})) as m from {rel}) t")
    return "\nunion all ".join(parts)


def digits(v: str) -> str:
    return f"regexp_replace(coalesce({v}, ''), '[^0-9]', '', 'g')"


def luhn(v: str) -> str:
    d = digits(v)
    dig = f"(ascii(substr({d}, length({d}) - i + 1, 1)) - 48)"
    term = (f"case when i % 2 = 0 then (case when 2 * {dig} > 9 then 2 * {dig} - 9 else 2 * {dig} end) "
            f"else {dig} end")
    return (f"(case when length({d}) between 13 and 19 then "
            f"list_sum(list_transform(range(1, length({d}) + 1), lambda i: {term})) % 10 = 0 "
            f"else false end)")


def verhoeff(v: str) -> str:
    d = digits(v)
    dig = f"(ascii(substr({d}, 12 - i, 1)) - 48)"
    p = f"(ascii(substr({q(VERHOEFF_P)}, (i % 8) * 10 + {dig} + 1, 1)) - 48)"
    step = f"(ascii(substr({q(VERHOEFF_D)}, c * 10 + {p} + 1, 1)) - 48)"
    return (f"(case when length({d}) = 12 then "
            f"list_reduce(range(0, 12), lambda c, i: {step}, 0) = 0 else false end)")


def mask_last4(v: str) -> str:
    n = f"length({v})"
    return (f"(case when {v} is null or {v} = '' then '' when {n} <= 4 then repeat('*', {n}) "
            f"else regexp_replace(substr({v}, 1, {n} - 4), '[^ -]', '*', 'g') || substr({v}, {n} - 3, 4) end)")


def mask_pan(v: str) -> str:
    n = f"length({v})"
    return (f"(case when {v} is null or {v} = '' then '' when {n} <> 10 then repeat('*', {n}) "
            f"else '*' || substr({v}, 6, 4) || '*' end)")


def mask_email(v: str) -> str:
    at = f"instr({v}, '@')"
    return (f"(case when {v} is null or {v} = '' then '' when {at} <= 1 then repeat('*', length({v})) "
            f"when {at} - 1 <= 2 then repeat('*', {at} - 1) || substr({v}, {at}) "
            f"else substr({v}, 1, 1) || repeat('*', {at} - 3) || substr({v}, {at} - 1, 1) || substr({v}, {at}) end)")


def valid(v: str = "value", t: str = "data_type") -> str:
    return (f"(case {t} when 'CARD_NUMBER' then {luhn(v)} when 'AADHAAR_NUMBER' then {verhoeff(v)} "
            f"else true end)")


def mask(v: str = "value", t: str = "data_type") -> str:
    return (f"(case when {t} = 'PAN_NUMBER' then {mask_pan(v)} "
            f"when {t} in ('UPI_ID', 'EMAIL') then {mask_email(v)} else {mask_last4(v)} end)")


def risk(t: str = "data_type") -> str:
    whens = " ".join(f"when {q(n)} then {q(r)}" for n, r in RISK.items())
    return f"(case {t} {whens} else 'NORMAL' end)"


def label(t: str = "data_type") -> str:
    whens = " ".join(f"when {q(n)} then {q(lb)}" for n, lb in LABEL.items())
    return f"(case {t} {whens} else {t} end)"


def ordinal(t: str = "data_type") -> str:
    return f"list_position([{', '.join(q(n) for n in NAMES)}], {t})"


def findings(names=None, rel="corpus", keys=("src", "doc_id"), text="text", patterns=None) -> str:
    """validated + masked + classified findings: keys…, data_type, risk_level, match_idx, masked_value."""
    k = ", ".join(keys)
    return (f"select {k}, data_type, {risk()} as risk_level, match_idx, {mask()} as masked_value "
            f"from ({candidates(names, rel, keys, text, patterns)}) c where {valid()}")
