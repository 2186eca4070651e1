"""Queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from palimpsest.llm.bytepair import op12_byte_bpe
from palimpsest.llm.decontamination import op2_decontamination
from palimpsest.llm.fim import OP13_SQL, op13_fill_in_middle
from palimpsest.llm.interactions import OP11_SQL, op11_filter_audit
from palimpsest.llm.language import op10_language_id
from palimpsest.llm.near_dedup import OP5_SQL, op5_near_dedup
from palimpsest.llm.pieces import op9_pieces
from palimpsest.llm.pii import op3_pii
from palimpsest.llm.quality import op1_quality
from palimpsest.llm.search import OP8_SQL, op8_topk
from palimpsest.llm.secrets import op6_secrets
from palimpsest.llm.tokencount import op4_token_counts
from palimpsest.llm.toxicity import op7_toxicity

QUERIES = {
    "op1_quality": op1_quality,
    "op2_decontamination": op2_decontamination,
    "op3_pii": op3_pii,
    "op4_token_counts": op4_token_counts,
    "op5_near_dedup": op5_near_dedup,
    "op6_secrets": op6_secrets,
    "op7_toxicity": op7_toxicity,
    "op8_topk": op8_topk,
    "op9_pieces": op9_pieces,
    "op10_language_id": op10_language_id,
    "op11_filter_audit": op11_filter_audit,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_fill_in_middle": op13_fill_in_middle,
}
#: The rest have no SQL form; tests/llm compares them with brute force.
ORACLES: dict[str, str] = {"op5_near_dedup": OP5_SQL, "op8_topk": OP8_SQL, "op11_filter_audit": OP11_SQL, "op13_fill_in_middle": OP13_SQL}
