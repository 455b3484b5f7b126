"""The operators' queries over the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from . import chat, exact_dedup, langid, mixing, near_dedup, packing, quality_model, quality_rules, sharding, substring_dedup

QUERIES = {
    f.__name__: f
    for f in (
        sharding.op1_feistel_sharding,
        near_dedup.op2_chosen_path_dedup,
        packing.op3_kk_packing,
        exact_dedup.op4_exact_dedup,
        chat.op5_chat_formatting,
        mixing.op6_source_mixing,
        quality_model.op7_pu_quality,
        quality_rules.op8_quality_rules,
        substring_dedup.op9_bwt_substring_dedup,
        langid.op10_language_id,
    )
}

ORACLE_SQL = {
    "op4_exact_dedup": exact_dedup.OP4_SQL,
    "op5_chat_formatting": chat.OP5_SQL,
    "op6_source_mixing": mixing.OP6_SQL,
    "op8_quality_rules": quality_rules.OP8_SQL,
}
