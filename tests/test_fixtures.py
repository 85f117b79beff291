"""Counts recorded in FIXTURES §2 and SURVEY §7.1, reproduced at sf0.01."""

from pyspark.sql import functions as F

from piisift import scan
from piisift.operators.detect import candidates
from piisift.plans.tables import rec

SF = "/root/testdata/sf0.01"

# type: (candidates, total length, passing the type's check)
REC_EXPECTED = {
    "CARD_NUMBER": (1500, 24000, 150), "AADHAAR_NUMBER": (1500, 18000, 150), "PAN_NUMBER": (1500, 15000, 1500),
    "PASSPORT": (1500, 12000, 1500), "DRIVING_LICENCE": (1500, 24000, 1500), "VOTER_ID": (1500, 15000, 1500),
    "BANK_ACCOUNT": (6000, 73500, 6000), "IFSC": (1500, 16500, 1500), "UPI_ID": (1500, 16890, 1500),
    "PHONE_NUMBER": (1500, 19500, 1500), "EMAIL": (1500, 31890, 1500),
}


def test_rec_counts(spark):
    c = candidates(rec(spark, SF), "text", ["rec_id"], with_validity=True)
    got = {r.data_type: (r.n, r.length, r.valid) for r in c.groupBy("data_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("value")).alias("length"),
        F.count_if("is_valid").alias("valid")).collect()}
    assert got == REC_EXPECTED


def test_minimum_slice(spark):
    f = scan(spark.read.parquet(f"{SF}/documents.parquet"), "text", ["doc_id"])
    by_type = {r.data_type: r.n for r in f.groupBy("data_type").agg(F.count(F.lit(1)).alias("n")).collect()}
    by_risk = {r.risk_level: r.n for r in f.groupBy("risk_level").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert by_type == {"CARD_NUMBER": 22, "BANK_ACCOUNT": 30, "EMAIL": 12}
    assert by_risk == {"CRITICAL": 52, "NORMAL": 12}
