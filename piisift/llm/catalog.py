"""Registered queries of the training-data operators and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (bpe_duck, dialogue, exact, html_text, lattice_lm, lexical, licences, near, packing, quality, secret_scan,
               substring, token_files)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_order_minhash": near.op2_order_minhash,
    "op3_token_files": token_files.op3_token_files,
    "op4_template_text": html_text.op4_template_text,
    "op5_exact_dedup": exact.op5_exact_dedup,
    "op6_bpe_duckdb": bpe_duck.op6_bpe_duckdb,
    "op7_lattice_lm": lattice_lm.op7_lattice_lm,
    "op8_secret_scan": secret_scan.op8_secret_scan,
    "op9_host_quality": quality.op9_host_quality,
    "op10_licence_scan": licences.op10_licence_scan,
    "op11_substring_dedup": substring.op11_substring_dedup,
    "op12_dialogue_repair": dialogue.op12_dialogue_repair,
    "op13_lexical_search": lexical.op13_lexical_search,
}
ORACLES: dict[str, str] = {
    "op5_exact_dedup": exact.OP5_SQL,
    "op9_host_quality": quality.OP9_SQL,
    "op10_licence_scan": licences.OP10_SQL,
    "op11_substring_dedup": substring.OP11_SQL,
    "op13_lexical_search": lexical.OP13_SQL,
}
