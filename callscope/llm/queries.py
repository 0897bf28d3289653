"""The registered queries of this subpackage, and the SQL that states some of them."""

from __future__ import annotations

from callscope.llm import bpe, byte_bpe, collocations, license_scan, line_dedup, mixing, near_duplicates, quality, resampling, secrets, sharding, token_counts, topk_search

QUERIES = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_topk_search": topk_search.op2_topk_search,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_secret_scan": secrets.op4_secret_scan,
    "op5_jaccard_join": near_duplicates.op5_jaccard_join,
    "op6_sharding": sharding.op6_sharding,
    "op7_mixing": mixing.op7_mixing,
    "op8_bpe": bpe.op8_bpe,
    "op9_license_scan": license_scan.op9_license_scan,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_byte_bpe": byte_bpe.op11_byte_bpe,
    "op12_resampling": resampling.op12_resampling,
    "op13_collocations": collocations.op13_collocations,
    # What SQL can state of four others.
    "secret_forms": secrets.secret_forms,
    "shard_quotas": sharding.shard_quotas,
    "mix_targets": mixing.mix_targets,
    "license_phrases": license_scan.license_phrases,
}

SQL = {
    "op1_quality_rules": quality.SQL,
    "op2_topk_search": topk_search.SQL,
    "op10_line_dedup": line_dedup.SQL,
    "op12_resampling": resampling.SQL,
    "op13_collocations": collocations.SQL,
    "secret_forms": secrets.SQL,
    "shard_quotas": sharding.SQL,
    "mix_targets": mixing.SQL,
    "license_phrases": license_scan.SQL,
}
