"""The registered queries of the text operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import licenses, prefix_trie, turn_repair
from .bpe import op11_bpe
from .decontaminate import op10_decontamination
from .html_text import op3_html_text
from .language_id import op6_language_id
from .licenses import op2_license_scan
from .lm_scoring import op8_lm_scoring
from .ngram_join import op4_ngram_join
from .packing import op9_packing
from .prefix_trie import op13_prefix_trie
from .quality import op7_quality
from .token_store import op5_token_store
from .toxicity import op1_toxicity
from .turn_repair import op12_turn_repair

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_license_scan": op2_license_scan,
    "op3_html_text": op3_html_text,
    "op4_ngram_join": op4_ngram_join,
    "op5_token_store": op5_token_store,
    "op6_language_id": op6_language_id,
    "op7_quality": op7_quality,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_packing": op9_packing,
    "op10_decontamination": op10_decontamination,
    "op11_bpe": op11_bpe,
    "op12_turn_repair": op12_turn_repair,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE_SQL = {"op2_license_scan": licenses.ORACLE, "op12_turn_repair": turn_repair.ORACLE, "op13_prefix_trie": prefix_trie.ORACLE}
