"""Column names and types that stages agree on."""

from __future__ import annotations

#: A sequence record: where it stands in its file, its name, its bases and the 1-based place of the first.
RECORD = "record_ix long, seq_id string, seq string, seq_offset long"
#: What the detector returns for a record or chunk.
RAW_HIT = (
    "record_ix long, seq_id string, start long, `end` long, arm_length int, spacer_length int, ga int, ct int, mismatches int, "
    "ga_pct double, ct_pct double, mirror_identity double, is_perfect boolean, full_sequence string"
)
#: The hit table's columns in the order of the tab-separated output, and the score columns.
HIT_COLUMNS = [
    "seq_id", "source", "start", "end", "arm_length", "spacer_length", "total_length", "ga_pct", "ct_pct", "mirror_identity",
    "is_perfect", "left_arm", "spacer", "right_arm", "full_sequence", "stacking_score", "pairing_score", "total_score", "putative_triplex",
]
SCORES = "stacking_score double, pairing_score double, total_score double, putative_triplex string"
#: Fixed values of the output.
SOURCE, NO_SPACER = "findHDNA", "."
