"""The subpackage's queries and their SQL, added to the entry point if this package is present."""

from __future__ import annotations

from corpus_pipeline import run as pipeline

from .bpe import op4_bpe
from .chat import OP11_SQL, op11_chat_format
from .codes import OP13_SQL, op13_vector_codes
from .embed_dedup import OP2_SQL, op2_embedding_dedup
from .langid import op9_langid
from .lm import op8_lm
from .mixing import OP5_SQL, op5_mixing
from .ngram_join import OP1_SQL, op1_ngram_join
from .quality import op10_quality
from .substring import OP6_SQL, op6_substring_dedup
from .token_counts import op3_token_counts
from .topk import OP7_SQL, op7_topk
from .whitening import op12_whitening

QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_token_counts": op3_token_counts,
    "op4_bpe": op4_bpe,
    "op5_mixing": op5_mixing,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_topk": op7_topk,
    "op8_lm": op8_lm,
    "op9_langid": op9_langid,
    "op10_quality": op10_quality,
    "op11_chat_format": op11_chat_format,
    "op12_whitening": op12_whitening,
    "op13_vector_codes": op13_vector_codes,
    "pipeline": pipeline,
}

ORACLE_SQL = {
    "op1_ngram_join": OP1_SQL,
    "op2_embedding_dedup": OP2_SQL,
    "op5_mixing": OP5_SQL,
    "op6_substring_dedup": OP6_SQL,
    "op7_topk": OP7_SQL,
    "op11_chat_format": OP11_SQL,
    "op13_vector_codes": OP13_SQL,
}
