"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .best_fit import op13_best_fit
from .embedding_dedup import op2_embedding_dedup
from .hard_negatives import OP11_SQL, op11_hard_negatives
from .minhash import op1_minhash
from .mixing import OP5_SQL, op5_mixing
from .packing import op10_packing
from .search import op7_topk
from .secrets import op8_secrets
from .sharding import op6_sharding
from .substring_dedup import op3_substring_dedup
from .token_files import op4_token_files
from .toxicity import op9_toxicity
from .vector_codes import OP12_SQL, op12_vector_codes

QUERIES = {
    "op1_minhash": op1_minhash,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_token_files": op4_token_files,
    "op5_mixing": op5_mixing,
    "op6_sharding": op6_sharding,
    "op7_topk": op7_topk,
    "op8_secrets": op8_secrets,
    "op9_toxicity": op9_toxicity,
    "op10_packing": op10_packing,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_vector_codes": op12_vector_codes,
    "op13_best_fit": op13_best_fit,
}
ORACLE_SQL = {"op5_mixing": OP5_SQL, "op11_hard_negatives": OP11_SQL, "op12_vector_codes": OP12_SQL}
