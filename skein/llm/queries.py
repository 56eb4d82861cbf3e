"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from skein.llm.byte_bpe import op11_byte_bpe
from skein.llm.conversation_repair import op12_conversation_repair
from skein.llm.decontaminate import op5_decontaminate
from skein.llm.dual_tree import op13_dual_tree_lloyd
from skein.llm.embed_dedup import op2_near_vectors
from skein.llm.licenses import op6_licenses
from skein.llm.line_dedup import OP4_SQL, op4_line_dedup
from skein.llm.minhash import op9_near_duplicates
from skein.llm.packing import op10_pack
from skein.llm.suffix_dedup import op3_repeats
from skein.llm.token_store import op1_token_store
from skein.llm.toxicity import op7_toxicity
from skein.llm.warc_audit import op8_fixity_audit

QUERIES = {
    "op1_token_store": op1_token_store,
    "op2_near_vectors": op2_near_vectors,
    "op3_repeats": op3_repeats,
    "op4_line_dedup": op4_line_dedup,
    "op5_decontaminate": op5_decontaminate,
    "op6_licenses": op6_licenses,
    "op7_toxicity": op7_toxicity,
    "op8_fixity_audit": op8_fixity_audit,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_pack": op10_pack,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_dual_tree_lloyd": op13_dual_tree_lloyd,
}
ORACLE_SQL: dict[str, str] = {
    "op4_line_dedup": OP4_SQL,
}
