"""Queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from quietsignal.llm.chat import OP8_SQL, op8_prefix_target
from quietsignal.llm.decontaminate import OP4_SQL, op4_fm_index
from quietsignal.llm.jaccard import OP9_SQL, op9_divide_skip
from quietsignal.llm.katz import op5_katz_backoff
from quietsignal.llm.language import op7_compression_language
from quietsignal.llm.licenses import op10_license_scan
from quietsignal.llm.negatives import OP13_SQL, op13_vantage_negatives
from quietsignal.llm.packing import op2_harmonic_packing
from quietsignal.llm.pii import op3_bootstrapped_pii
from quietsignal.llm.quality import op1_bradley_terry
from quietsignal.llm.secretscan import op12_crf_secrets
from quietsignal.llm.spelling import OP11_SQL, op11_wildcard_groups
from quietsignal.llm.winnow import op6_winnowing

QUERIES = {
    "op1_bradley_terry": op1_bradley_terry,
    "op2_harmonic_packing": op2_harmonic_packing,
    "op3_bootstrapped_pii": op3_bootstrapped_pii,
    "op4_fm_index": op4_fm_index,
    "op5_katz_backoff": op5_katz_backoff,
    "op6_winnowing": op6_winnowing,
    "op7_compression_language": op7_compression_language,
    "op8_prefix_target": op8_prefix_target,
    "op9_divide_skip": op9_divide_skip,
    "op10_license_scan": op10_license_scan,
    "op11_wildcard_groups": op11_wildcard_groups,
    "op12_crf_secrets": op12_crf_secrets,
    "op13_vantage_negatives": op13_vantage_negatives,
}
ORACLES = {"op4_fm_index": OP4_SQL, "op8_prefix_target": OP8_SQL, "op9_divide_skip": OP9_SQL, "op11_wildcard_groups": OP11_SQL, "op13_vantage_negatives": OP13_SQL}
