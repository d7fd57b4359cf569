"""The operators' queries, and their SQL for DuckDB where SQL can express them."""

from __future__ import annotations

from .alignment import op11
from .ann import op6
from .embed_dedup import op2
from .lm_score import OP3_SQL, op3
from .mixing import OP9_SQL, op9
from .phrases import OP12_SQL, op12
from .pii import op4
from .quality import op13
from .simhash import op1
from .sp_lattice import op8
from .token_files import op7
from .toxicity import op5
from .url_filter import op10

QUERIES = {
    "op1_simhash": op1,
    "op2_embedding_dedup": op2,
    "op3_lm_score": op3,
    "op4_personal_data": op4,
    "op5_toxicity": op5,
    "op6_nearest": op6,
    "op7_token_files": op7,
    "op8_sentencepiece": op8,
    "op9_mix_sources": op9,
    "op10_url_filter": op10,
    "op11_token_alignment": op11,
    "op12_phrases": op12,
    "op13_line_quality": op13,
}
ORACLE_SQL = {"op3_lm_score": OP3_SQL, "op9_mix_sources": OP9_SQL, "op12_phrases": OP12_SQL}
