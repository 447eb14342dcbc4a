"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from .alignment import op11_alignment
from .bpe import op13_bpe_codec
from .chat import OP9_TURNS_SQL, chat_turns, op9_chat_format
from .hard_negatives import OP12_SQL, op12_hard_negatives
from .language_id import op8_language_id
from .minhash_dedup import OP2_SQL, op2_minhash_dedup
from .mixing import op6_mixing
from .packing import op5_packing
from .sharding import OP4_SQL, SMALL_SHARDS_SQL, op4_sharding, small_shards
from .substring_dedup import OP10_SQL, op10_substring_dedup
from .token_files import op7_token_files
from .topk import OP1_SQL, op1_topk_search
from .vector_dedup import op3_vector_dedup

QUERIES = {
    "op1_topk_search": op1_topk_search,
    "op2_minhash_dedup": op2_minhash_dedup,
    "op3_vector_dedup": op3_vector_dedup,
    "op4_sharding": op4_sharding,
    "small_shards": small_shards,
    "op5_packing": op5_packing,
    "op6_mixing": op6_mixing,
    "op7_token_files": op7_token_files,
    "op8_language_id": op8_language_id,
    "op9_chat_format": op9_chat_format,
    "chat_turns": chat_turns,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_alignment": op11_alignment,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_bpe_codec": op13_bpe_codec,
}
ORACLES = {"chat_turns": OP9_TURNS_SQL, "op1_topk_search": OP1_SQL, "op2_minhash_dedup": OP2_SQL, "op4_sharding": OP4_SQL, "small_shards": SMALL_SHARDS_SQL, "op10_substring_dedup": OP10_SQL, "op12_hard_negatives": OP12_SQL}
