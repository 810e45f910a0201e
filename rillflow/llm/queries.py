"""The registered query of each training-data operator, and its SQL where SQL expresses it."""

from __future__ import annotations

from rillflow.llm.ann import op1_ann
from rillflow.llm.bpe import op10_byte_bpe
from rillflow.llm.chat import chat_sql, op3_chat_formatting
from rillflow.llm.collisions import near_duplicates_sql, op9_embedding_near_dedup
from rillflow.llm.decontamination import decontamination_sql, op11_decontamination
from rillflow.llm.html import op4_html_extraction
from rillflow.llm.lexical import lexical_sql, op13_lexical_search
from rillflow.llm.mixing import mixing_sql, op5_mixing
from rillflow.llm.simhash import op6_simhash_near_dedup
from rillflow.llm.substring import op7_substring_dedup, substring_sql
from rillflow.llm.tokencounts import op8_token_counts
from rillflow.llm.toxicity import op2_toxicity
from rillflow.llm.whitening import op12_whitening

QUERIES = {
    "op1_ann": op1_ann,
    "op2_toxicity": op2_toxicity,
    "op3_chat_formatting": op3_chat_formatting,
    "op4_html_extraction": op4_html_extraction,
    "op5_mixing": op5_mixing,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op8_token_counts": op8_token_counts,
    "op9_embedding_near_dedup": op9_embedding_near_dedup,
    "op10_byte_bpe": op10_byte_bpe,
    "op7_substring_dedup": op7_substring_dedup,
    "op11_decontamination": op11_decontamination,
    "op12_whitening": op12_whitening,
    "op13_lexical_search": op13_lexical_search,
}

SQL: dict[str, str] = {
    "op3_chat_formatting": chat_sql(),
    "op5_mixing": mixing_sql(),
    "op7_substring_dedup": substring_sql(),
    "op9_embedding_near_dedup": near_duplicates_sql(),
    "op11_decontamination": decontamination_sql(),
    "op13_lexical_search": lexical_sql(),
}
