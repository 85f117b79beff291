"""Registered queries: name → (Spark query, DuckDB oracle SQL or None).

Every query reads the driver's tables (or tables Spark derives from them)
in full.  ``__spark_entry__`` exposes this registry to the driver.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checks, masks
from ..functions.types import BY_NAME, TYPE_NAMES
from ..operators.detect import candidates, scan
from . import duck
from .tables import corpus, with_ctes

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}

KEYS = ["src", "doc_id"]


def register(name: str, sql: str | None):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


# ---- D1–D11: one detector alone -----------------------------------------
_DETECT_KEYS = {
    "detect_card": "CARD_NUMBER", "detect_aadhaar": "AADHAAR_NUMBER", "detect_pan": "PAN_NUMBER",
    "detect_passport": "PASSPORT", "detect_driving_licence": "DRIVING_LICENCE",
    "detect_voter_id": "VOTER_ID", "detect_bank_account": "BANK_ACCOUNT", "detect_ifsc": "IFSC",
    "detect_upi": "UPI_ID", "detect_phone": "PHONE_NUMBER", "detect_email": "EMAIL",
}


def _detect_query(type_name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return candidates(corpus(spark, sf_dir), "text", KEYS, types=[type_name])
    run.__name__ = f"detect_{type_name.lower()}"
    return run


for _key, _type in _DETECT_KEYS.items():
    register(_key, with_ctes(duck.candidates([_type]), "corpus"))(_detect_query(_type))


# ---- D12: all detectors, raw candidates ---------------------------------
@register("candidates_all", with_ctes(duck.candidates(), "corpus"))
def candidates_all(spark, sf_dir):
    return candidates(corpus(spark, sf_dir), "text", KEYS)


# ---- V1, V2: checksums over every digit-shaped candidate -----------------
@register("validate_luhn", with_ctes(
    f"select src, doc_id, data_type, match_idx, value, {duck.luhn('value')} as is_valid "
    f"from ({duck.candidates(['CARD_NUMBER', 'BANK_ACCOUNT'])}) c", "corpus"))
def validate_luhn(spark, sf_dir):
    c = candidates(corpus(spark, sf_dir), "text", KEYS, types=["CARD_NUMBER", "BANK_ACCOUNT"])
    return c.withColumn("is_valid", checks.luhn_valid(F.col("value")))


@register("validate_verhoeff", with_ctes(
    f"select src, doc_id, data_type, match_idx, value, {duck.verhoeff('value')} as is_valid "
    f"from ({duck.candidates(['AADHAAR_NUMBER', 'BANK_ACCOUNT'])}) c", "corpus"))
def validate_verhoeff(spark, sf_dir):
    c = candidates(corpus(spark, sf_dir), "text", KEYS, types=["AADHAAR_NUMBER", "BANK_ACCOUNT"])
    return c.withColumn("is_valid", checks.verhoeff_valid(F.col("value")))


# ---- M1–M3: masks ---------------------------------------------------------
def _mask_query(types, fn):
    def run(spark, sf_dir):
        c = candidates(corpus(spark, sf_dir), "text", KEYS, types=list(types))
        return c.select(*KEYS, "data_type", "match_idx", fn(F.col("value")).alias("masked_value"))
    return run


_LAST4_TYPES = duck.LAST4
_PAN_TYPES = ("PAN_NUMBER", "VOTER_ID", "PASSPORT")  # 10-char and other lengths
_EMAIL_TYPES = ("UPI_ID", "EMAIL")
for _key, _types, _fn, _dfn in (("mask_last4", _LAST4_TYPES, masks.mask_last4, duck.mask_last4),
                                ("mask_pan", _PAN_TYPES, masks.mask_pan, duck.mask_pan),
                                ("mask_email", _EMAIL_TYPES, masks.mask_email_like, duck.mask_email)):
    register(_key, with_ctes(
        f"select src, doc_id, data_type, match_idx, {_dfn('value')} as masked_value "
        f"from ({duck.candidates(list(_types))}) c", "corpus"))(_mask_query(_types, _fn))


# ---- C1 + D15 + Q7: type dimension with counts ----------------------------
def type_dimension_df(spark: SparkSession) -> DataFrame:
    rows = [(i, d.name, d.risk, d.label, d.validator is not None)
            for i, d in enumerate(BY_NAME.values())]
    return spark.createDataFrame(
        rows, "ordinal int, data_type string, risk_level string, label string, has_checksum boolean")


@register("classify_risk", with_ctes(
    f"select data_type, {duck.risk()} as risk_level, count(*) as n "
    f"from ({duck.candidates()}) c group by all", "corpus"))
def classify_risk(spark, sf_dir):
    c = candidates(corpus(spark, sf_dir), "text", KEYS)
    risk_map = F.create_map(*[x for d in BY_NAME.values() for x in (F.lit(d.name), F.lit(d.risk))])
    return (c.groupBy("data_type").agg(F.count(F.lit(1)).alias("n"))
            .select("data_type", F.coalesce(risk_map[F.col("data_type")], F.lit("NORMAL")).alias("risk_level"), "n"))


@register("type_dimension", with_ctes(
    "select t.ordinal, t.data_type, t.risk_level, t.label, t.has_checksum, "
    "coalesce(c.n_candidates, 0) as n_candidates, coalesce(f.n_findings, 0) as n_findings "
    "from (select cast(i - 1 as integer) as ordinal, n as data_type, " + duck.risk("n") + " as risk_level, "
    + duck.label("n") + " as label, n in ('CARD_NUMBER', 'AADHAAR_NUMBER') as has_checksum "
    "from (select unnest(" + "[" + ", ".join(duck.q(n) for n in TYPE_NAMES) + "]) as n, "
    "unnest(range(1, " + str(len(TYPE_NAMES) + 1) + ")) as i)) t "
    f"left join (select data_type, count(*) as n_candidates from ({duck.candidates()}) c group by all) c "
    "using (data_type) "
    f"left join (select data_type, count(*) as n_findings from ({duck.findings()}) f group by all) f "
    "using (data_type)", "corpus"))
def type_dimension(spark, sf_dir):
    # one pass: every candidate carries its validity, counted per type
    cand = candidates(corpus(spark, sf_dir), "text", KEYS, with_validity=True)
    counts = cand.groupBy("data_type").agg(F.count(F.lit(1)).alias("n_candidates"),
                                           F.count_if("is_valid").alias("n_findings"))
    # both sides hold at most one row per type: bounded, broadcast-safe
    dim = F.broadcast(type_dimension_df(spark))
    return (dim.join(F.broadcast(counts), "data_type", "left")
            .select("ordinal", "data_type", "risk_level", "label", "has_checksum",
                    F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"),
                    F.coalesce("n_findings", F.lit(0)).alias("n_findings")))


# ---- F1: the flagship scan -------------------------------------------------
FINDING_COLS = [*KEYS, "data_type", "risk_level", "match_idx", "masked_value"]


@register("findings_all", with_ctes(duck.findings(), "corpus"))
def findings_all(spark, sf_dir):
    return scan(corpus(spark, sf_dir), "text", KEYS).select(*FINDING_COLS)


# ---- D13: a chosen set of types ------------------------------------------
ENABLED = ["CARD_NUMBER", "EMAIL", "PAN_NUMBER"]


@register("findings_enabled_types", with_ctes(duck.findings(ENABLED), "corpus"))
def findings_enabled_types(spark, sf_dir):
    return scan(corpus(spark, sf_dir), "text", KEYS, types=ENABLED).select(*FINDING_COLS)


# ---- D14: custom patterns (validator, mask, risk of the type still apply) --
CUSTOM = {"CARD_NUMBER": r"\b\d{16}\b", "EMAIL": r"\b[a-z0-9.]+@[a-z]+\.example\.com\b"}


@register("findings_custom_pattern", with_ctes(
    duck.findings(patterns={k: (v, 0) for k, v in CUSTOM.items()}), "corpus"))
def findings_custom_pattern(spark, sf_dir):
    return scan(corpus(spark, sf_dir), "text", KEYS, custom_patterns=CUSTOM).select(*FINDING_COLS)
