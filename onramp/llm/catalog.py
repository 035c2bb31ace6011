"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from . import balltree, chat_format, hard_negatives, host_rules, language_id, lexical_search, mixing, quality_net, secrets_cnn, sharding, simhash, url_templates, word_bpe

QUERIES = {
    "op1_shard_tree": sharding.op1_shard_tree,
    "op2_language_id": language_id.op2_language_id,
    "op3_word_bpe": word_bpe.op3_word_bpe,
    "op4_url_templates": url_templates.op4_url_templates,
    "op5_mix": mixing.op5_mix,
    "op6_secrets": secrets_cnn.op6_secrets,
    "op7_simhash": simhash.op7_simhash,
    "op8_top_k": balltree.op8_top_k,
    "op9_host_rules": host_rules.op9_host_rules,
    "op10_quality": quality_net.op10_quality,
    "op11_chat_format": chat_format.op11_chat_format,
    "op12_lexical_search": lexical_search.op12_lexical_search,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}
ORACLE = {
    "op1_shard_tree": sharding.ORACLE,
    "op5_mix": mixing.ORACLE,
    "op8_top_k": balltree.ORACLE,
    "op9_host_rules": host_rules.ORACLE,
    "op11_chat_format": chat_format.ORACLE,
    "op12_lexical_search": lexical_search.ORACLE,
    "op13_hard_negatives": hard_negatives.ORACLE,
}
