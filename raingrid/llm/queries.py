"""Registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from raingrid.llm import alignment, best_fit, bilinear_lm, binary_packing, fingerprints, language_id, line_quality
from raingrid.llm import line_dedup, near_duplicates, piece_codec, prefix_trie, quality_rules
from raingrid.llm import secret_formats

QUERIES = {
    "op1_bilinear_lm": bilinear_lm.op1_bilinear_lm,
    "op2_piece_codec": piece_codec.op2_piece_codec,
    "op3_fingerprints": fingerprints.op3_fingerprints,
    "op4_near_duplicates": near_duplicates.op4_near_duplicates,
    "op5_language_id": language_id.op5_language_id,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op8_secret_formats": secret_formats.op8_secret_formats,
    "op9_line_quality": line_quality.op9_line_quality,
    "op7_pack_best_fit": best_fit.op7_pack_best_fit,
    "op10_pack_binary": binary_packing.op10_pack_binary,
    "op11_line_dedup": line_dedup.op11_line_dedup,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_alignment": alignment.op13_alignment,
}
SQL: dict[str, str] = {
    "op11_line_dedup": line_dedup.OP11_SQL,
    "op12_prefix_trie": prefix_trie.OP12_SQL,
}
