"""The queries of this subpackage by name, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, langid, licences, media, mixing, neardup, quality, toxicity, trie_tokens, warc

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_bpe_round_trip": bpe.op2_bpe_round_trip,
    "op3_warc_round_trip": warc.op3_warc_round_trip,
    "op4_language_id": langid.op4_language_id,
    "op5_near_duplicates": neardup.op5_near_duplicates,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_media_columns": media.op7_media_columns,
    "op8_licence_scan": licences.op8_licence_scan,
    "op9_token_counts": trie_tokens.op9_token_counts,
    "op10_mix_sources": mixing.op10_mix_sources,
}
ORACLES: dict[str, str] = {
    "op3_warc_round_trip": warc.ORACLE,
    "op5_near_duplicates": neardup.ORACLE,
    "op6_quality_rules": quality.ORACLE,
    "op8_licence_scan": licences.ORACLE,
}
