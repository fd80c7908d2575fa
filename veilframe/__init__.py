"""Find personal data and secrets in text columns, mask them reversibly, and bring them back, on Spark."""

from veilframe.config import ScanConfig, pii_groups, pii_types
from veilframe.operators.detectors import Rule
from veilframe.operators.mask import Masked, highlight, mask, restore, with_instruction
from veilframe.operators.scan import explode_detections, scan, scan_selection, type_counts

__all__ = [
    "Masked", "Rule", "ScanConfig", "explode_detections", "highlight", "mask", "pii_groups", "pii_types", "restore",
    "scan", "scan_selection", "type_counts", "with_instruction",
]
