"""The registered queries of the data-preparation operators, and their SQL where there is any."""

from __future__ import annotations

from .exact_dedup import OP1_SQL, op1_exact_dedup
from .fingerprints import op3_simhash
from .jaccard_join import OP4_SQL, op4_ngram_jaccard
from .language_model import op10_lm_score
from .licenses import OP6_SQL, op6_license_scan
from .packing import op5_packing
from .quality import op2_quality
from .sharding import op7_sharding
from .tokens import op9_bpe_tokens
from .toxicity import op8_toxicity

QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_quality": op2_quality,
    "op3_simhash": op3_simhash,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_packing": op5_packing,
    "op6_license_scan": op6_license_scan,
    "op7_sharding": op7_sharding,
    "op8_toxicity": op8_toxicity,
    "op9_bpe_tokens": op9_bpe_tokens,
    "op10_lm_score": op10_lm_score,
}

ORACLE_SQL = {
    "op1_exact_dedup": OP1_SQL,
    "op4_ngram_jaccard": OP4_SQL,
    "op6_license_scan": OP6_SQL,
}
