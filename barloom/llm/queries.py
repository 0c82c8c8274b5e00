"""Queries of the training-data operators, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from .codes import OP11_SQL, op11_vector_codes
from .decontaminate import op1_contamination
from .fingerprint import op10_fingerprints
from .importance import OP13_SQL, op13_importance
from .langid import op9_language_id
from .lm import op5_suffix_tree_score
from .mixing import OP6_SQL, op6_source_mix
from .neardup import OP8_SQL, op8_near_duplicates
from .pii import op4_pii
from .quality import OP12_SQL, op12_quality_rules
from .substring import OP2_SQL, op2_substring_dedup
from .suffix import op7_suffix_dedup
from .urls import op3_url_filter

QUERIES = {
    "op1_contamination": op1_contamination,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_url_filter": op3_url_filter,
    "op4_pii": op4_pii,
    "op5_suffix_tree_score": op5_suffix_tree_score,
    "op6_source_mix": op6_source_mix,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_language_id": op9_language_id,
    "op10_fingerprints": op10_fingerprints,
    "op11_vector_codes": op11_vector_codes,
    "op12_quality_rules": op12_quality_rules,
    "op13_importance": op13_importance,
}
ORACLE_SQL: dict[str, str] = {
    "op2_substring_dedup": OP2_SQL,
    "op6_source_mix": OP6_SQL,
    "op8_near_duplicates": OP8_SQL,
    "op11_vector_codes": OP11_SQL,
    "op12_quality_rules": OP12_SQL,
    "op13_importance": OP13_SQL,
}
