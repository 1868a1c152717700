"""Queries of this subpackage and the SQL that gives their rows, where SQL can."""

from __future__ import annotations

from folio.llm import language, mixing, mtree, packing, pii, quality, simhash, sketch, token_files, wordpiece

QUERIES = {
    "op1_simhash_groups": simhash.op1_simhash_groups,
    "op2_scaled_sketch": sketch.op2_scaled_sketch,
    "op3_token_files": token_files.op3_token_files,
    "op4_nnls_packing": packing.op4_nnls_packing,
    "op5_longest_match_counts": wordpiece.op5_longest_match_counts,
    "op6_word_backoff_language": language.op6_word_backoff_language,
    "op7_mtree_top_k": mtree.op7_mtree_top_k,
    "op8_sainte_lague_mix": mixing.op8_sainte_lague_mix,
    "op9_weak_supervision_pii": pii.op9_weak_supervision_pii,
    "op10_attention_quality": quality.op10_attention_quality,
}
ORACLES: dict[str, str] = {"op7_mtree_top_k": mtree.SQL, "op8_sainte_lague_mix": mixing.SQL}
