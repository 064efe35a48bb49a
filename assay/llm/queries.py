"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from .chat import OP5_SQL, op5_chat
from .decontaminate import OP3_SQL, op3_decontaminate
from .embeddings import op4_embeddings
from .lmscore import op10_lm_score
from .packing import op6_packing
from .sharding import op1_sharding
from .simhash import op7_simhash
from .tokenbin import op8_token_ids
from .toxicity import op2_toxicity
from .urlfilter import OP9_SQL, op9_urls


def queries() -> dict:
    return {
        "op1_sharding": op1_sharding,
        "op2_toxicity": op2_toxicity,
        "op3_decontaminate": op3_decontaminate,
        "op4_embeddings": op4_embeddings,
        "op5_chat": op5_chat,
        "op6_packing": op6_packing,
        "op7_simhash": op7_simhash,
        "op8_token_ids": op8_token_ids,
        "op9_urls": op9_urls,
        "op10_lm_score": op10_lm_score,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_decontaminate": OP3_SQL, "op5_chat": OP5_SQL, "op9_urls": OP9_SQL}
