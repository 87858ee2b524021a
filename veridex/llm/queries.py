"""The subpackage's registered queries and their oracle SQL."""

from __future__ import annotations

from . import collocations, fill_middle, mixing, preferences
from .chroma import op3_chroma_fingerprint
from .collocations import op12_collocations
from .fill_middle import op11_fill_middle
from .fingerprint import op9_order_fingerprint
from .langid import op10_language_id
from .license_scan import op7_license_scan
from .mixing import op2_curriculum_mix
from .near_dup import op8_order_minhash
from .pieces import op5_sentencepiece
from .preferences import op4_preference_format
from .substring_dedup import op6_suffix_dedup
from .toxicity import op1_toxicity
from .vector_dups import op13_vector_dups

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_curriculum_mix": op2_curriculum_mix,
    "op3_chroma_fingerprint": op3_chroma_fingerprint,
    "op4_preference_format": op4_preference_format,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_license_scan": op7_license_scan,
    "op8_order_minhash": op8_order_minhash,
    "op9_order_fingerprint": op9_order_fingerprint,
    "op10_language_id": op10_language_id,
    "op11_fill_middle": op11_fill_middle,
    "op12_collocations": op12_collocations,
    "op13_vector_dups": op13_vector_dups,
}

#: The others have no SQL: tests/llm holds them against brute force, exact round trips or held-out labels.
ORACLE_SQL: dict[str, str] = {"op2_curriculum_mix": mixing.SQL, "op4_preference_format": preferences.SQL, "op11_fill_middle": fill_middle.SQL, "op12_collocations": collocations.SQL}
