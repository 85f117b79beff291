"""The training-data pipeline: quality, exact copies, near copies, secrets, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a table that is written and read again as the next
stage's ``docs``.  All stages but the last return the columns of ``documents``.

* ``quality``: documents that the host-level rules reject go.
* ``exact``: of documents with equal text, one stays (the smallest id; a row repeated with its id once).
* ``near``: of each near-duplicate group, one stays (the smallest id).
* ``secrets``: every secret found is replaced by ``[SECRET]``; ``n_chars`` follows; no document goes.
* ``packing``: the pieces of all documents with their places in sequences of 1,024 ids.

Nulls, empty texts, ties and repeated rows have the results that the stages' modules define; an empty
table gives an empty result.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from piisift.llm import exact, near, packing, quality, secret_scan  # noqa: E402
from piisift.llm.common import table, written  # noqa: E402
from piisift.session import ship_package  # noqa: E402


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return quality.keep_documents(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return near.drop_near(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return secret_scan.redact(docs, length="n_chars")


#: Units that a worker of the packing stage keeps: it still holds what the stages before have left in its memory.
UNITS_KEPT = 150_000


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers
    ship_package(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), table_size=UNITS_KEPT)


STAGES = [("quality", quality_stage), ("exact", exact_stage), ("near", near_stage),
          ("secrets", secret_stage), ("packing", packing_stage)]

#: Order MinHash with alignment, and ids by a tokenizer, are not expressible in SQL; tests hold the
#: pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
