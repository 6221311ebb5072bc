"""The registered queries of this subpackage."""

from __future__ import annotations

from . import bpe_replay, cross_tokens, near_dups, nn_descent, packing, phrase_parse, pseudonyms, quality_cnn, quality_rules, secret_scan, sharding, url_filter, whitening


def queries() -> dict:
    return {
        "op1_ownership_scan": secret_scan.op1_ownership_scan,
        "op2_feistel_pseudonyms": pseudonyms.op2_feistel_pseudonyms,
        "op3_prefix_free_parse": phrase_parse.op3_prefix_free_parse,
        "op4_byte_cnn": quality_cnn.op4_byte_cnn,
        "op5_swap_packing": packing.op5_swap_packing,
        "op6_boosted_rules": quality_rules.op6_boosted_rules,
        "op7_bag_min_hash": near_dups.op7_bag_min_hash,
        "op8_nn_descent": nn_descent.op8_nn_descent,
        "op9_merge_replay": bpe_replay.op9_merge_replay,
        "op10_hash_tree_shards": sharding.op10_hash_tree_shards,
        "op11_batch_alignment": cross_tokens.op11_batch_alignment,
        "op12_blocked_bloom_urls": url_filter.op12_blocked_bloom_urls,
        "op13_two_pass_whitening": whitening.op13_two_pass_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {"op12_blocked_bloom_urls": url_filter.SQL}
