"""Checksums against plain-Python folds; masks on fixed cases."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from piisift.functions import (luhn_valid, mask_email_like, mask_last4, mask_pan, verhoeff_valid)
from piisift.functions.checks import VERHOEFF_D, VERHOEFF_P


def py_luhn(s):
    d = [int(c) for c in s if c.isdigit()]
    if not 13 <= len(d) <= 19:
        return False
    total = 0
    for i, x in enumerate(reversed(d)):
        if i % 2:
            x *= 2
            x -= 9 if x > 9 else 0
        total += x
    return total % 10 == 0


def py_verhoeff(s):
    d = [int(c) for c in s if c.isdigit()]
    if len(d) != 12:
        return False
    c = 0
    for i, x in enumerate(reversed(d)):
        c = int(VERHOEFF_D[c * 10 + int(VERHOEFF_P[(i % 8) * 10 + x])])
    return c == 0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="0123456789 -x", min_size=0, max_size=24), min_size=50, max_size=80))
def test_checksums_match_python(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = df.select("v", luhn_valid(F.col("v")).alias("l"), verhoeff_valid(F.col("v")).alias("h")).collect()
    for r in got:
        assert r.l == py_luhn(r.v), r.v
        assert r.h == py_verhoeff(r.v), r.v


def test_known_numbers(spark):
    rows = [("4111 1111 1111 1111", True, False), ("4532-0151-1283-0366", True, False),
            ("4539578763621486", True, False), ("234123412346", False, True),
            ("234123412347", False, False), (None, False, False), ("", False, False)]
    df = spark.createDataFrame(rows, "v string, l boolean, h boolean")
    for r in df.select("v", "l", "h", luhn_valid(F.col("v")).alias("gl"),
                       verhoeff_valid(F.col("v")).alias("gh")).collect():
        assert (r.gl, r.gh) == (r.l, r.h), r.v


def test_masks(spark):
    cases = [("4111 1111 1111 1111", "last4", "**** **** **** 1111"),
             ("4532-0151-1283-0366", "last4", "****-****-****-0366"),
             ("91 9876543210", "last4", "** ******3210"), ("123", "last4", "***"),
             ("", "last4", ""), (None, "last4", ""),
             ("ABCPK1234L", "pan", "*1234*"), ("A1234567", "pan", "********"),
             ("john.doe@ybl", "email", "j******e@ybl"), ("ab@ybl", "email", "**@ybl"),
             ("@x", "email", "**"), ("abc", "email", "***")]
    df = spark.createDataFrame(cases, "v string, kind string, want string")
    fns = {"last4": mask_last4, "pan": mask_pan, "email": mask_email_like}
    out = df.select("v", "kind", "want", *[fns[k](F.col("v")).alias(k) for k in fns]).collect()
    for r in out:
        assert r[r.kind] == r.want, (r.v, r.kind)


def py_last4(v):
    if not v:
        return ""
    if len(v) <= 4:
        return "*" * len(v)
    return "".join(c if (c in " -" or i >= len(v) - 4) else "*" for i, c in enumerate(v))


def py_pan(v):
    if not v:
        return ""
    return "*" + v[5:9] + "*" if len(v) == 10 else "*" * len(v)


def py_email(v):
    if not v:
        return ""
    at = v.find("@")
    if at <= 0:
        return "*" * len(v)
    local, domain = v[:at], v[at:]
    masked = "*" * len(local) if len(local) <= 2 else local[0] + "*" * (len(local) - 2) + local[-1]
    return masked + domain


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab9 -@.Z", min_size=0, max_size=14), min_size=40, max_size=60))
def test_masks_match_python(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = df.select("v", mask_last4(F.col("v")).alias("a"), mask_pan(F.col("v")).alias("b"),
                    mask_email_like(F.col("v")).alias("c")).collect()
    for r in got:
        assert (r.a, r.b, r.c) == (py_last4(r.v), py_pan(r.v), py_email(r.v)), r.v
