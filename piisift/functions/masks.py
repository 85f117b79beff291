"""Masks as Spark column expressions.  null or '' always masks to ''."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STAR = "*"
VISIBLE_TAIL = 4


def _stars(n: Column) -> Column:
    return F.repeat(F.lit(STAR), n)


def _empty_guard(value: Column, masked: Column) -> Column:
    return F.when(value.isNull() | (F.length(value) == 0), F.lit("")).otherwise(masked)


def mask_last4(value: Column) -> Column:
    """Keep the last four characters and every space or '-'; star the rest."""
    n = F.length(value)
    head = F.substring(value, 1, n - VISIBLE_TAIL)
    plain = (F.instr(head, " ") == 0) & (F.instr(head, "-") == 0)  # nothing to keep: no regex needed
    head = F.when(plain, _stars(n - VISIBLE_TAIL)).otherwise(F.regexp_replace(head, "[^ -]", STAR))
    tail = F.substring(value, n - VISIBLE_TAIL + 1, VISIBLE_TAIL)
    return _empty_guard(value, F.when(n <= VISIBLE_TAIL, _stars(n)).otherwise(F.concat(head, tail)))


def mask_pan(value: Column) -> Column:
    """10 characters → '*' + characters 6..9 + '*'; other lengths → all stars."""
    n = F.length(value)
    masked = F.when(n != 10, _stars(n)).otherwise(
        F.concat(F.lit(STAR), F.substring(value, 6, 4), F.lit(STAR)))
    return _empty_guard(value, masked)


def mask_email_like(value: Column) -> Column:
    """Mask the part before the first '@' but its first and last character."""
    n = F.length(value)
    at = F.instr(value, "@")  # 1-based, 0 when absent
    local_len = at - 1
    local = F.substring(value, 1, local_len)
    domain = F.substring(value, at, n)
    masked_local = F.when(local_len <= 2, _stars(local_len)).otherwise(
        F.concat(F.substring(local, 1, 1), _stars(local_len - 2), F.substring(local, local_len, 1)))
    return _empty_guard(value, F.when(at <= 1, _stars(n)).otherwise(F.concat(masked_local, domain)))
