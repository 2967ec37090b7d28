"""The corpus queries by name, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from spreadwatch.llm.conversation_repair import op12_conversation_repair
from spreadwatch.llm.decontaminate import op4_decontaminate
from spreadwatch.llm.exact_dedup import OP1_SQL, op1_exact_dedup
from spreadwatch.llm.html_extract import op9_html_extract
from spreadwatch.llm.language_id import op6_language_id
from spreadwatch.llm.line_dedup import OP5_SQL, op5_line_dedup
from spreadwatch.llm.lm_scoring import op11_lm_scoring
from spreadwatch.llm.mixing import OP3_SQL, op3_mix_sources
from spreadwatch.llm.ngram_join import OP2_SQL, op2_ngram_jaccard
from spreadwatch.llm.prefix_trie import OP13_SQL, op13_prefix_trie
from spreadwatch.llm.substring_dedup import op7_substring_dedup
from spreadwatch.llm.token_counts import op8_token_counts
from spreadwatch.llm.warc import OP10_SQL, op10_warc_archive

QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_mix_sources": op3_mix_sources,
    "op4_decontaminate": op4_decontaminate,
    "op5_line_dedup": op5_line_dedup,
    "op6_language_id": op6_language_id,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_token_counts": op8_token_counts,
    "op9_html_extract": op9_html_extract,
    "op10_warc_archive": op10_warc_archive,
    "op11_lm_scoring": op11_lm_scoring,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLES = {
    "op1_exact_dedup": OP1_SQL,
    "op2_ngram_jaccard": OP2_SQL,
    "op3_mix_sources": OP3_SQL,
    "op5_line_dedup": OP5_SQL,
    "op10_warc_archive": OP10_SQL,
    "op13_prefix_trie": OP13_SQL,
}
