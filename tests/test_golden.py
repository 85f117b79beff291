"""Independent values: nothing here is imported from the constants under test."""

import itertools

import pytest
from pyspark.sql import functions as F

from piisift.functions import checks
from piisift.operators.detect import scan


def _check_digit(digits: str) -> int:
    """Verhoeff's check digit from the definition: the dihedral group of order ten and its permutation."""
    def times(a, b):  # rotations 0-4, reflections 5-9
        if a < 5:
            return (a + b) % 5 if b < 5 else 5 + (a + b) % 5
        return 5 + (a - b) % 5 if b < 5 else (a - b) % 5
    step = {0: 1, 1: 5, 2: 7, 3: 6, 4: 2, 5: 8, 6: 3, 7: 0, 8: 9, 9: 4}
    total = 0
    for i, ch in enumerate(reversed(digits), 1):
        d = int(ch)
        for _ in range(i % 8):
            d = step[d]
        total = times(total, d)
    return next(c for c in range(10) if times(total, c) == 0)


def _luhn_digit(digits: str) -> int:
    doubled = sum(sum(divmod(int(c) * (2 - i % 2), 10)) for i, c in enumerate(reversed(digits)))
    return -doubled % 10


def test_verhoeff_against_the_group(spark):
    rows = []
    for a, b in itertools.product(range(2, 10), range(0, 99_999_999_999 // 9, 1_371_742_111)):
        body = f"{a}{b:010d}"[:11]
        good = _check_digit(body)
        rows += [(body + str(c), c == good) for c in range(10)]
    got = spark.createDataFrame(rows, "v string, want boolean").select("want", checks.verhoeff_valid(F.col("v")).alias("is"))
    assert got.filter("want <> is").count() == 0
    assert _check_digit("23412341234") == 6  # a published example of a valid number


def test_luhn_against_the_definition(spark):
    rows = []
    for n in (12, 14, 15, 18):
        body = ("4539578763621486" * 2)[:n]
        rows += [(body + str(c), c == _luhn_digit(body)) for c in range(10)]
    got = spark.createDataFrame(rows, "v string, want boolean").select("want", checks.luhn_valid(F.col("v")).alias("is"))
    assert got.filter("want <> is").count() == 0


# (text, type, masked value, risk) written down by hand
CASES = [
    ("pay 4111 1111 1111 1111 now", "CARD_NUMBER", "**** **** **** 1111", "CRITICAL"),
    ("pay 4111-1111-1111-1112 now", "CARD_NUMBER", None, None),
    ("id 2341 2341 2346 here", "AADHAAR_NUMBER", "**** **** 2346", "CRITICAL"),
    ("id 2341 2341 2345 here", "AADHAAR_NUMBER", None, None),
    ("pan ABCPK1234L", "PAN_NUMBER", "*1234*", "MEDIUM"),
    ("write jo.doe@example.com", "EMAIL", "j****e@example.com", "NORMAL"),
]


@pytest.mark.parametrize("text,kind,masked,risk", CASES)
def test_findings_written_down_by_hand(spark, text, kind, masked, risk):
    found = scan(spark.createDataFrame([(text,)], "text string"), "text", types=[kind]).collect()
    assert [(r.masked_value, r.risk_level) for r in found] == ([] if masked is None else [(masked, risk)])
