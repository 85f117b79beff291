"""Column functions: type dimension, checksums, masks, display formats."""

from .checks import digits_only, luhn_valid, verhoeff_valid
from .masks import mask_email_like, mask_last4, mask_pan
from .types import (BUILTIN_DETECTORS, BY_NAME, CARD_NOTICE, LABEL_BY_TYPE, RISK_BY_TYPE,
                    RISK_LEVELS, TYPE_NAMES, Detector, ascii_boundaries, resolve_types)

__all__ = [
    "digits_only", "luhn_valid", "verhoeff_valid", "mask_email_like", "mask_last4", "mask_pan",
    "BUILTIN_DETECTORS", "BY_NAME", "CARD_NOTICE", "LABEL_BY_TYPE", "RISK_BY_TYPE",
    "RISK_LEVELS", "TYPE_NAMES", "Detector", "ascii_boundaries", "resolve_types",
]
