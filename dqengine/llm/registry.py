"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from dqengine.llm import bpe, fingerprints, html_extract, licenses, matroska, minhash, mixing, prefix_trie, simhash, structure_repair, substring_index, suffix_dedup, toxicity


def queries() -> dict:
    return {"op1_suffix_dedup": suffix_dedup.query, "op2_toxicity": toxicity.query, "op3_license_scan": licenses.query, "op4_html_wrapper": html_extract.query, "op5_piecewise_hash": fingerprints.query, "op6_pareto_mix": mixing.query, "op7_byte_bpe": bpe.query, "op8_matroska": matroska.query, "op9_minhash": minhash.query, "op10_substring_index": substring_index.query, "op11_simhash": simhash.query, "op12_prefix_trie": prefix_trie.query, "op13_structure_repair": structure_repair.query}


def oracle_sql() -> dict[str, str]:
    return {"op1_suffix_dedup": suffix_dedup.SQL, "op9_minhash": minhash.SQL, "op10_substring_index": substring_index.SQL, "op12_prefix_trie": prefix_trie.SQL, "op13_structure_repair": structure_repair.SQL}
