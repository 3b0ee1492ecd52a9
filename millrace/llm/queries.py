"""The numbered queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from .bpe import op9_bpe
from .centroids import OP11_SQL, op11_centroids
from .chat import op10_chat
from .ctw import op12_ctw
from .exact_dedup import OP8_SQL, op8_exact_dedup
from .importance import OP13_SQL, op13_importance
from .langid import op2_language_id
from .media import op6_media_tiff
from .mixing import op3_mixing
from .quality import op1_quality
from .simhash import op5_simhash
from .suffix_dedup import op4_suffix_dedup
from .token_files import op7_token_files

QUERIES = {
    "op1_quality": op1_quality,
    "op2_language_id": op2_language_id,
    "op3_mixing": op3_mixing,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_simhash": op5_simhash,
    "op6_media_tiff": op6_media_tiff,
    "op7_token_files": op7_token_files,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_bpe": op9_bpe,
    "op10_chat": op10_chat,
    "op11_centroids": op11_centroids,
    "op12_ctw": op12_ctw,
    "op13_importance": op13_importance,
}

ORACLE_SQL = {"op8_exact_dedup": OP8_SQL, "op11_centroids": OP11_SQL, "op13_importance": OP13_SQL}
