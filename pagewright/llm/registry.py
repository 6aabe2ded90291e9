"""The queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from .bpe import op5_bpe
from .hnsw_search import op9_hnsw_search
from .html_text import op2_html_text
from .line_dedup import OP3_SQL, op3_line_dedup
from .lm_scoring import op4_lm_scoring
from .minhash_dedup import OP7_SQL, op7_minhash_dedup
from .quality_rules import OP8_SQL, op8_quality_rules
from .source_mixing import OP10_SQL, op10_source_mixing
from .suffix_dedup import op6_suffix_dedup
from .token_files import op1_token_files

QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_html_text": op2_html_text,
    "op3_line_dedup": op3_line_dedup,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_bpe": op5_bpe,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_minhash_dedup": op7_minhash_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_hnsw_search": op9_hnsw_search,
    "op10_source_mixing": op10_source_mixing,
}

ORACLE_SQL = {
    "op3_line_dedup": OP3_SQL,
    "op7_minhash_dedup": OP7_SQL,
    "op8_quality_rules": OP8_SQL,
    "op10_source_mixing": OP10_SQL,
}
