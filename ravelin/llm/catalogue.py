"""Queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from ravelin.llm import filter_audit, oracles, phrases, positional_index, url_cascade
from ravelin.llm.byte_bpe import op5_byte_bpe
from ravelin.llm.chat import op9_chat
from ravelin.llm.chroma import op4_chroma
from ravelin.llm.fertility import op2_fertility
from ravelin.llm.filter_audit import op13_filter_audit
from ravelin.llm.packing import op1_packing
from ravelin.llm.phrases import op11_phrases
from ravelin.llm.pii import op10_pii
from ravelin.llm.positional_index import op12_positional_index
from ravelin.llm.simhash import op3_simhash
from ravelin.llm.suffix_repeats import op7_suffix_repeats
from ravelin.llm.toxicity import op8_toxicity
from ravelin.llm.url_cascade import op6_url_cascade

QUERIES = {
    "op1_packing": op1_packing,
    "op2_fertility": op2_fertility,
    "op3_simhash": op3_simhash,
    "op4_chroma": op4_chroma,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_url_cascade": op6_url_cascade,
    "op7_suffix_repeats": op7_suffix_repeats,
    "op8_toxicity": op8_toxicity,
    "op9_chat": op9_chat,
    "op10_pii": op10_pii,
    "op11_phrases": op11_phrases,
    "op12_positional_index": op12_positional_index,
    "op13_filter_audit": op13_filter_audit,
}

ORACLES = {
    "op3_simhash": oracles.SIMHASH,
    "op6_url_cascade": url_cascade.ORACLE,
    "op7_suffix_repeats": oracles.REPEATS,
    "op9_chat": oracles.CHAT,
    "op11_phrases": phrases.ORACLE,
    "op12_positional_index": positional_index.ORACLE,
    "op13_filter_audit": filter_audit.ORACLE,
}
