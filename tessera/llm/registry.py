"""The queries of this subpackage and, where SQL can express them, their oracle SQL."""

from __future__ import annotations

from tessera.llm import chat, cobucket, decontaminate, fill_middle, html_text, mixing, passages, quality, repeats, secrets, simhash, token_counts, toxicity

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_html_text": html_text.op2_html_text,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_secret_scan": secrets.op4_secret_scan,
    "op5_simhash_dedup": simhash.op5_simhash_dedup,
    "op6_source_mix": mixing.op6_source_mix,
    "op7_repeated_strings": repeats.op7_repeated_strings,
    "op8_fuzzy_passages": passages.op8_fuzzy_passages,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_quality_rules": quality.op10_quality_rules,
    "op11_bucketed_pair": cobucket.op11_bucketed_pair,
    "op12_chat_formatting": chat.op12_chat_formatting,
    "op13_fill_in_middle": fill_middle.op13_fill_in_middle,
}

ORACLE_SQL: dict[str, str] = {
    "op6_source_mix": mixing.OP6_SQL,
    "op12_chat_formatting": chat.OP12_SQL,
    "op13_fill_in_middle": fill_middle.OP13_SQL,
}
