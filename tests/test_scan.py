"""scan(): types, custom patterns, user detectors, masking invariants."""

import pytest
from pyspark.sql import functions as F

from piisift.functions import BUILTIN_DETECTORS, Detector, ascii_boundaries
from piisift.functions.types import MEDIUM
from piisift.operators.detect import candidates, scan

TEXT = ("card 4111 1111 1111 1111 bad 4111 1111 1111 1112 aadhaar 234123412346 not 234123412347 "
        "pan ABCPK1234L mail jo.doe@example.com upi jo@ybl phone +91 9876543210")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, TEXT), (2, None), (3, "nothing here")], "doc_id long, text string")


def test_findings_validated_masked(docs):
    rows = scan(docs, "text", ["doc_id"]).collect()
    got = {(r.data_type, r.masked_value) for r in rows}
    assert ("CARD_NUMBER", "**** **** **** 1111") in got
    assert not any(v.endswith("1112") for t, v in got if t == "CARD_NUMBER")
    assert ("AADHAAR_NUMBER", "********2346") in got
    assert not any(t == "AADHAAR_NUMBER" and v.endswith("2347") for t, v in got)
    assert ("PAN_NUMBER", "*1234*") in got
    assert ("EMAIL", "j****e@example.com") in got
    assert ("UPI_ID", "**@ybl") in got
    risks = {r.data_type: r.risk_level for r in rows}
    assert risks["CARD_NUMBER"] == "CRITICAL" and risks["PAN_NUMBER"] == "MEDIUM"
    assert risks["EMAIL"] == "NORMAL"
    assert {r.doc_id for r in rows} == {1}


def test_raw_value_never_in_mask(docs):
    raw = {(r.doc_id, r.data_type, r.match_idx): r.value
           for r in candidates(docs, "text", ["doc_id"]).collect()}
    for r in scan(docs, "text", ["doc_id"]).collect():
        v = raw[(r.doc_id, r.data_type, r.match_idx)]
        if len(v) > 4:
            assert v not in r.masked_value


def test_types_subset_equals_filter(docs):
    keys = ["doc_id", "data_type", "match_idx", "masked_value"]
    sub = sorted(map(tuple, scan(docs, "text", ["doc_id"], types=["EMAIL", "CARD_NUMBER"]).select(*keys).collect()))
    full = sorted(map(tuple, scan(docs, "text", ["doc_id"]).filter(
        F.col("data_type").isin("EMAIL", "CARD_NUMBER")).select(*keys).collect()))
    assert sub == full


def test_unknown_types_reported_together(docs):
    with pytest.raises(ValueError) as e:
        scan(docs, "text", ["doc_id"], types=["NOPE", "email", "EMAIL"])
    assert str(e.value).startswith("Invalid data type(s): NOPE, email. Valid options: CARD_NUMBER, ")


def test_custom_pattern_keeps_validator_mask_risk(docs):
    rows = scan(docs, "text", ["doc_id"], types=["CARD_NUMBER"],
                custom_patterns={"CARD_NUMBER": r"\b4111 1111 1111 111\d\b", "EMAIL": "  "}).collect()
    assert [r.masked_value for r in rows] == ["**** **** **** 1111"]  # the ...1112 fails Luhn


def test_invalid_regex_and_unknown_type(docs):
    with pytest.raises(ValueError) as e:
        scan(docs, "text", ["doc_id"], custom_patterns={"EMAIL": "([a-z", "FOO": "x", "PASSPORT": " "})
    msg = str(e.value)
    assert msg.startswith("Invalid regex for EMAIL: ") and msg.endswith(" | Unknown PII type 'FOO' in customPatterns")


def test_empty_matches_kept(spark):
    df = spark.createDataFrame([(1, "baab")], "id long, text string")
    vals = [r.value for r in candidates(df, "text", ["id"], types=["VOTER_ID"],
                                        custom_patterns={"VOTER_ID": "a*"}).orderBy("match_idx").collect()]
    assert vals == ["", "aa", "", ""]


def test_user_detector(spark):
    extra = Detector("EMPLOYEE_ID", ascii_boundaries(r"\bEMP-\d{6}\b"), risk=MEDIUM, label="Employee ID")
    df = spark.createDataFrame([(1, "id EMP-123456 and xEMP-123456")], "id long, text string")
    rows = scan(df, "text", ["id"], detectors=[*BUILTIN_DETECTORS, extra], types=["EMPLOYEE_ID"]).collect()
    assert [(r.data_type, r.risk_level, r.masked_value) for r in rows] == [("EMPLOYEE_ID", "MEDIUM", "***-**3456")]


def test_ascii_boundaries_rewrite():
    assert ascii_boundaries(r"[\b]x\\b") == r"[\b]x\\b"
    assert "(?<=\\w)" in ascii_boundaries(r"\bx")
    assert ascii_boundaries(r"\bx\b", True, True) == r"(?<!\w)x(?!\w)"


def test_scan_plan_has_no_exchange(docs, capsys):
    scan(docs, "text", ["doc_id"]).explain()
    plan = capsys.readouterr().out
    assert "Generate" in plan and "Exchange" not in plan


def test_split_union_invariance(spark, docs):
    keys = ["doc_id", "data_type", "match_idx", "masked_value"]
    whole = sorted(map(tuple, scan(docs, "text", ["doc_id"]).select(*keys).collect()))
    a = docs.filter("doc_id = 1")
    b = docs.filter("doc_id <> 1")
    parts = scan(a, "text", ["doc_id"]).unionByName(scan(b, "text", ["doc_id"]))
    assert sorted(map(tuple, parts.select(*keys).collect())) == whole


def test_user_guards_are_not_confused(spark):
    a = Detector("A_CODE", ascii_boundaries(r"\bAAA\d{3}\b"), guard=lambda t: F.instr(t, "AAA") > 0)
    b = Detector("B_CODE", ascii_boundaries(r"\bBBB\d{3}\b"), guard=lambda t: F.instr(t, "BBB") > 0)
    df = spark.createDataFrame([(1, "BBB123 only")], "id long, text string")
    got = [r.data_type for r in scan(df, "text", ["id"], detectors=[a, b]).collect()]
    assert got == ["B_CODE"]


def test_java_only_pattern_syntax_is_accepted(spark):
    df = spark.createDataFrame([(1, "mail abc@example.com")], "id long, text string")
    rows = scan(df, "text", ["id"], types=["EMAIL"],
                custom_patterns={"EMAIL": r"\p{javaLowerCase}+@example\.com"}).collect()
    assert [r.masked_value for r in rows] == ["a*c@example.com"]
    with pytest.raises(ValueError) as e:
        scan(df, "text", ["id"], custom_patterns={"EMAIL": "([a-z"})
    assert str(e.value).startswith("Invalid regex for EMAIL: ")
