"""The registered queries of this subpackage, and their SQL where there is one."""

from __future__ import annotations

from .decontaminate import op10_decontamination
from .jaccard_join import op7_jaccard_join
from .language import op5_language_id
from .neighbours import op3_adaptive_scan
from .packing import op2_best_fit_packing
from .pii import op8_pii
from .sql import ORACLE_SQL
from .suffix_dedup import op6_suffix_dedup
from .token_counts import op9_token_counts
from .token_output import op4_token_output
from .toxicity import op1_toxicity

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_adaptive_scan": op3_adaptive_scan,
    "op4_token_output": op4_token_output,
    "op5_language_id": op5_language_id,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_pii": op8_pii,
    "op9_token_counts": op9_token_counts,
    "op10_decontamination": op10_decontamination,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
