"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import exact_dedup, html_text, line_dedup, mixing, ngram_join, packing, prefix_trie, quality, shard, suffix_dedup, tokens, vector_codes, vector_dedup

QUERIES = {
    "op1_html_extraction": html_text.op1_html_extraction,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_packing": packing.op3_packing,
    "op4_quality_classifier": quality.op4_quality_classifier,
    "op5_ngram_join": ngram_join.op5_ngram_join,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_vector_dedup": vector_dedup.op7_vector_dedup,
    "op8_token_counts": tokens.op8_token_counts,
    "op9_mixing": mixing.op9_mixing,
    "op10_sharding": shard.op10_sharding,
    "op11_line_dedup": line_dedup.op11_line_dedup,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_vector_codes": vector_codes.op13_vector_codes,
}

ORACLE_SQL = {
    "op5_ngram_join": ngram_join.ORACLE_OP5,
    "op6_exact_dedup": exact_dedup.ORACLE_OP6,
    "op7_vector_dedup": vector_dedup.ORACLE_OP7,
    "op9_mixing": mixing.ORACLE_OP9,
    "op11_line_dedup": line_dedup.ORACLE_OP11,
    "op12_prefix_trie": prefix_trie.ORACLE_OP12,
    "op13_vector_codes": vector_codes.ORACLE_OP13,
}
