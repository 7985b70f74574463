"""The corpus queries and, where SQL can express them, their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import chat, decontam, lines, lmscore, mixing, neardup, quality, repeats, sharding, spelling, tokencount, toxicity, whitening

QUERIES = {
    "op1_sainte_lague_mix": mixing.op1_mix,
    "op2_hilbert_shards": sharding.op2_shards,
    "op3_adaptive_quality": quality.op3_quality,
    "op4_toxic_segments": toxicity.op4_toxicity,
    "op5_partenum_join": neardup.op5_components,
    "op6_snapshot_collapse": chat.op6_collapse,
    "op7_prefix_decontam": decontam.op7_decontam,
    "op8_cross_entropy_difference": lmscore.op8_lm_score,
    "op9_suffix_repeats": repeats.op9_repeats,
    "op10_viterbi_counts": tokencount.op10_tokens,
    "op11_trie_variants": spelling.op11_spelling,
    "op12_bitsliced_whitening": whitening.op12_whitening,
    "op13_bloom_lines": lines.op13_lines,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL = {
    "op3_adaptive_quality": quality.ORACLE_SQL,
    "op5_partenum_join": neardup.ORACLE_SQL,
    "op6_snapshot_collapse": chat.ORACLE_SQL,
    "op7_prefix_decontam": decontam.ORACLE_SQL,
    "op11_trie_variants": spelling.ORACLE_SQL,
    "op13_bloom_lines": lines.ORACLE_SQL,
}
