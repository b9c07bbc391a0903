"""The queries of this subpackage, by name."""

from __future__ import annotations

from newsflow.llm import prefix_trie, quality_rules
from newsflow.llm.byte_bpe import op9_byte_bpe
from newsflow.llm.quality_rules import op2_quality_rules
from newsflow.llm.chat_formatting import op6_chat_formatting
from newsflow.llm.decontamination import op8_decontamination
from newsflow.llm.prefix_trie import op11_conversation_trie
from newsflow.llm.repeated_bytes import op5_byte_repeats
from newsflow.llm.repeated_words import op1_word_repeats
from newsflow.llm.secret_scans import op7_secret_scans
from newsflow.llm.sentence_pieces import op12_sentence_pieces
from newsflow.llm.simhash import op4_simhash
from newsflow.llm.token_counts import op10_token_counts
from newsflow.llm.toxicity import op3_toxicity
from newsflow.llm.whitening import op13_whitening

QUERIES = {
    "op1_word_repeats": op1_word_repeats,
    "op2_quality_rules": op2_quality_rules,
    "op3_toxicity": op3_toxicity,
    "op4_simhash": op4_simhash,
    "op5_byte_repeats": op5_byte_repeats,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_secret_scans": op7_secret_scans,
    "op8_decontamination": op8_decontamination,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_token_counts": op10_token_counts,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_sentence_pieces": op12_sentence_pieces,
    "op13_whitening": op13_whitening,
}
#: DuckDB twins; what is not listed is tested against brute force in tests/llm.
ORACLE_SQL = {
    "op2_quality_rules": quality_rules.OP2_SQL,
    "op11_conversation_trie": prefix_trie.OP11_SQL,
}
