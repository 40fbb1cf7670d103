"""The training-data queries by name, and DuckDB SQL for those SQL can express."""

from __future__ import annotations

from . import (embedding_dedup, html_extract, license_scan, line_dedup, mixing, ngram_join, packing, prefix_trie, quality_forest, secret_scan,
               spelling, substring_dedup, toxicity)

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_ngram_join": ngram_join.op4_ngram_join,
    "op5_embedding_dedup": embedding_dedup.op5_embedding_dedup,
    "op6_quality_forest": quality_forest.op6_quality_forest,
    "op7_best_fit_packing": packing.op7_best_fit_packing,
    "op8_license_scan": license_scan.op8_license_scan,
    "op9_secret_scan": secret_scan.op9_secret_scan,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_spelling_variants": spelling.op12_spelling_variants,
    "op13_html_extract": html_extract.op13_html_extract,
}

ORACLE = {
    "op1_mix_sources": mixing.OP1_SQL,
    "op9_secret_scan": secret_scan.OP9_SQL,
    "op11_prefix_trie": prefix_trie.OP11_SQL,
    "op12_spelling_variants": spelling.OP12_SQL,
}
