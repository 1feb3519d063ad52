"""The queries of the llm operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from spanlight.llm.bpe import op2_bpe
from spanlight.llm.chat import ORACLE_OP7, op7_chat
from spanlight.llm.embedding_join import op3_embeddings
from spanlight.llm.fingerprints import op5_fingerprints
from spanlight.llm.language_id import op4_language
from spanlight.llm.lm_scoring import op8_lm
from spanlight.llm.packing import op1_pack
from spanlight.llm.pii import op6_pii
from spanlight.llm.simhash import op9_simhash
from spanlight.llm.toxicity import op10_toxicity

QUERIES = {
    "op1_pack": op1_pack,
    "op2_bpe": op2_bpe,
    "op3_embeddings": op3_embeddings,
    "op4_language": op4_language,
    "op5_fingerprints": op5_fingerprints,
    "op6_pii": op6_pii,
    "op7_chat": op7_chat,
    "op8_lm": op8_lm,
    "op9_simhash": op9_simhash,
    "op10_toxicity": op10_toxicity,
}

ORACLE: dict[str, str] = {"op7_chat": ORACLE_OP7}
