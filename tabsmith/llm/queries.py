"""The registered queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

from tabsmith.llm import decontam, divergence, html_text, katz, language_crf, line_dedup, minhash, mixing, packing, repair, token_scan, vector_graph, warc

QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_decontamination": decontam.op2_decontamination,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_embedding_near_dedup": vector_graph.op4_embedding_near_dedup,
    "op5_minhash_near_dedup": minhash.op5_minhash_near_dedup,
    "op6_warc": warc.op6_warc,
    "op7_html_extraction": html_text.op7_html_extraction,
    "op8_lm_scoring": katz.op8_lm_scoring,
    "op9_language_id": language_crf.op9_language_id,
    "op10_token_counts": token_scan.op10_token_counts,
    "op11_source_mixing": mixing.op11_source_mixing,
    "op12_source_divergence": divergence.op12_source_divergence,
    "op13_conversation_repair": repair.op13_conversation_repair,
}

ORACLE = {
    "op2_decontamination": decontam.ORACLE,
    "op3_line_dedup": line_dedup.ORACLE,
    "op5_minhash_near_dedup": minhash.ORACLE,
    "op6_warc": warc.ORACLE,
    "op12_source_divergence": divergence.ORACLE,
}
