"""Checksums as Spark column expressions (no UDF).

Both return a boolean Column that is false, never an error, for any input,
including null, empty and over-long strings (safe under ANSI mode).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --------------------------------------------------------------------------
# The Verhoeff tables (dihedral group D5), row by row.
# multiplication: 10 rows of 10 digits; permutation: 8 rows of 10 digits.
# --------------------------------------------------------------------------
VERHOEFF_D = ("0123456789" "1234067895" "2340178956" "3401289567" "4012395678"
              "5987604321" "6598710432" "7659821043" "8765932104" "9876543210")
VERHOEFF_P = ("0123456789" "1576283094" "5803796142" "8916043527"
              "9453126870" "4286573901" "2793806415" "7046913258")
# --------------------------------------------------------------------------


def digits_only(value: Column) -> Column:
    """Drop everything but 0-9; null becomes ''."""
    return F.regexp_replace(F.coalesce(value, F.lit("")), "[^0-9]", "")


def _table(values) -> Column:
    """A literal array: split and cast are folded when the plan is made."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")


def _two_digits(d: Column, pos: int) -> Column:
    """The number from the two digits at ``pos``."""
    return F.substring(d, pos, 2).cast("int")


LUHN_MIN, LUHN_MAX = 13, 19
AADHAAR_LEN = 12
#: Of two digits, the left one doubled (its digits added) and the right one.
LUHN_TWO = [(x * 2 - 9 if x > 4 else x * 2) + y for x in range(10) for y in range(10)]


def _verhoeff_two(i: int) -> list[int]:
    """Of two digits, at places i + 1 and i from the right, what they do to a checksum: c becomes D[c][value].

    The multiplication of the group is associative, so the effects of pairs multiply."""
    at = lambda table, row, x: int(table[row * 10 + x])
    return [at(VERHOEFF_D, at(VERHOEFF_P, i % 8, y), at(VERHOEFF_P, (i + 1) % 8, x)) for x in range(10) for y in range(10)]


def luhn_digits(d: Column) -> Column:
    """Luhn over a string of digits (13 to 19 of them), two at a time; zeros on the left add nothing."""
    n, table = F.length(d), _table(LUHN_TWO)
    total = None
    for k in range(1, 21, 2):
        two = F.get(table, _two_digits(F.lpad(d, 20, "0"), k))
        total = two if total is None else total + two
    return F.when(n.between(LUHN_MIN, LUHN_MAX), total % 10 == 0).otherwise(F.lit(False))


def verhoeff_digits(d: Column) -> Column:
    """Verhoeff over a string of exactly 12 digits: from the right with the multiplication and permutation
    tables, two digits at a time; 0 means valid."""
    mul, folded = _table(VERHOEFF_D), F.lit(0)
    for i in range(0, AADHAAR_LEN, 2):
        effect = F.get(_table(_verhoeff_two(i)), _two_digits(d, AADHAAR_LEN - i - 1))
        folded = effect if i == 0 else F.get(mul, folded * 10 + effect)
    return F.when(F.length(d) == AADHAAR_LEN, folded == 0).otherwise(F.lit(False))


def _on_digits(value: Column, fold) -> Column:
    # strip once and hand the digits to the fold as a bound lambda variable;
    # otherwise every step of the fold would strip the value again
    return F.transform(F.array(digits_only(value)), fold)[0]


def luhn_valid(value: Column) -> Column:
    """Luhn mod-10 over the digits of ``value``; 13 to 19 digits required."""
    return _on_digits(value, luhn_digits)


def verhoeff_valid(value: Column) -> Column:
    """Verhoeff check over exactly 12 digits (the Aadhaar form)."""
    return _on_digits(value, verhoeff_digits)
