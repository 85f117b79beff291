"""piisift: personal-data discovery on Spark.

Main entry points::

    from piisift import scan, candidates, Detector
    findings = scan(df, "text", key_cols=["doc_id"])
"""

from .functions import BUILTIN_DETECTORS, TYPE_NAMES, Detector, luhn_valid, verhoeff_valid
from .operators.detect import candidates, findings_per_row, scan

__all__ = ["scan", "candidates", "findings_per_row", "Detector", "BUILTIN_DETECTORS", "TYPE_NAMES",
           "luhn_valid", "verhoeff_valid"]
