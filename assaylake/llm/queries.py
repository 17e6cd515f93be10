"""The registered queries of this package and the SQL that says the same where SQL can."""

from __future__ import annotations

from . import html, langid, licences, lines, merkle, pieces, setsketch, shards, simhash, topk, toxicity, turns, winnow

QUERIES = {
    "op1_license_scan": licences.query,
    "op2_sentencepiece": pieces.query,
    "op3_simhash_near_dedup": simhash.query,
    "op4_benchmark_decontamination": winnow.query,
    "op5_language_id": langid.query,
    "op6_html_extraction": html.query,
    "op7_line_dedup": lines.query,
    "op8_toxicity": toxicity.query,
    "op9_exact_top_k": topk.query,
    "op10_sharding": shards.query,
    "op11_merkle_manifest": merkle.query,
    "op12_minhash_near_dedup": setsketch.query,
    "op13_turn_reassembly": turns.query,
}

ORACLE_SQL = {
    "op4_benchmark_decontamination": winnow.ORACLE_SQL,
    "op7_line_dedup": lines.ORACLE_SQL,
    "op9_exact_top_k": topk.ORACLE_SQL,
    "op11_merkle_manifest": merkle.ORACLE_SQL,
    "op12_minhash_near_dedup": setsketch.ORACLE_SQL,
    "op13_turn_reassembly": turns.ORACLE_SQL,
}
