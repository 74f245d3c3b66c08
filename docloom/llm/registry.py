"""Queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from docloom.llm import bpe, embedding_dup, language, mixing, near_dup, quality_model, quality_rules, revisits, sharding, suffix_dedup

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_attention_quality": quality_model.op2_attention_quality,
    "op3_superminhash_near_dup": near_dup.op3_superminhash_near_dup,
    "op4_revisit_resolution": revisits.op4_revisit_resolution,
    "op5_water_filling_mix": mixing.op5_water_filling_mix,
    "op6_decision_list": quality_rules.op6_decision_list,
    "op7_viterbi_language": language.op7_viterbi_language,
    "op8_jump_hash_sharding": sharding.op8_jump_hash_sharding,
    "op9_itq_embedding_dup": embedding_dup.op9_itq_embedding_dup,
    "op10_byte_bpe": bpe.op10_byte_bpe,
    "embedding_dup_of_copies": embedding_dup.embedding_dup_of_copies,
    "text_statistics": quality_rules.text_statistics,
    "decoded_texts": bpe.decoded_texts,
}

SQL = {
    "op1_suffix_dedup": suffix_dedup.OP1_SQL,
    "op3_superminhash_near_dup": near_dup.OP3_SQL,
    "op9_itq_embedding_dup": embedding_dup.OP9_SQL,
    "embedding_dup_of_copies": embedding_dup.COPIES_SQL,
    "text_statistics": quality_rules.STATISTICS_SQL,
    "decoded_texts": bpe.DECODED_SQL,
    "op8_jump_hash_sharding": sharding.OP8_SQL,
    "op4_revisit_resolution": revisits.OP4_SQL,
    "op5_water_filling_mix": mixing.OP5_SQL,
}
