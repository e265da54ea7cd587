"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from tessera.llm import decontaminate, embedding_dedup, html, licenses, linededup, mixing, ngram_join, quality, sharding, suffix_tree

QUERIES = {
    "op1_rule_ensemble_quality": quality.op1_rule_ensemble_quality,
    "op2_dice_license_scan": licenses.op2_dice_license_scan,
    "op3_simhash_decontamination": decontaminate.op3_simhash_decontamination,
    "op4_consensus_html_text": html.op4_consensus_html_text,
    "op5_ngram_jaccard_join": ngram_join.op5_ngram_jaccard_join,
    "op6_hnsw_near_dedup": embedding_dedup.op6_hnsw_near_dedup,
    "op7_cuckoo_line_dedup": linededup.op7_cuckoo_line_dedup,
    "op8_lpt_shards": sharding.op8_lpt_shards,
    "op9_water_filling_mix": mixing.op9_water_filling_mix,
    "op10_suffix_tree_scores": suffix_tree.op10_suffix_tree_scores,
}
SQL = {"op2_dice_license_scan": licenses.SQL, "op7_cuckoo_line_dedup": linededup.SQL, "op9_water_filling_mix": mixing.SQL}
