"""Operators over DataFrames: detection, summaries, browsing, history, reports, whole scan runs."""
