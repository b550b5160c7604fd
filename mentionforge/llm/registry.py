"""Queries of the training-data operators and the SQL that says what some of them return."""

from mentionforge.llm import ann_search, chat_format, exact_dedup, lexical_search, minhash_dedup, packing, piece_encoding, prefix_trie, quality_rules, secret_scan, substring_dedup, toxicity, url_filters

QUERIES = {
    "op1_url_filters": url_filters.op1,
    "op2_quality_rules": quality_rules.op2,
    "op3_minhash_dedup": minhash_dedup.op3,
    "op4_packing": packing.op4,
    "op5_toxicity": toxicity.op5,
    "op6_chat_formatting": chat_format.op6,
    "op7_ann_search": ann_search.op7,
    "op8_suffix_array_dedup": substring_dedup.op8,
    "op9_secret_scans": secret_scan.op9,
    "op10_piece_encoding": piece_encoding.op10,
    "op11_exact_dedup": exact_dedup.op11,
    "op12_lexical_search": lexical_search.op12,
    "op13_prefix_trie": prefix_trie.op13,
}
ORACLES = {
    "op2_quality_rules": quality_rules.OP2_SQL,
    "op3_minhash_dedup": minhash_dedup.OP3_SQL,
    "op6_chat_formatting": chat_format.OP6_SQL,
    "op7_ann_search": ann_search.OP7_SQL,
    "op8_suffix_array_dedup": substring_dedup.OP8_SQL,
    "op9_secret_scans": secret_scan.OP9_SQL,
    "op11_exact_dedup": exact_dedup.OP11_SQL,
    "op12_lexical_search": lexical_search.OP12_SQL,
    "op13_prefix_trie": prefix_trie.OP13_SQL,
}
