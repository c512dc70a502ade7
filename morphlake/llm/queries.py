"""The queries of the operators and what DuckDB can say about them."""

from __future__ import annotations

from morphlake.llm import decontaminate, html, linededup, mixing_lm, negatives, ngramjoin, quality, spm, substring, topk, toxicity, vectorcodes, warc

QUERIES = {
    "op1_decontaminate": decontaminate.query,
    "op2_warc": warc.query,
    "op3_substring_dedup": substring.query,
    "op4_html_extraction": html.query,
    "op5_sentencepiece": spm.query,
    "op6_toxicity": toxicity.query,
    "op7_context_mixing": mixing_lm.query,
    "op8_exact_top_k": topk.query,
    "op9_line_dedup": linededup.query,
    "op10_ngram_jaccard": ngramjoin.query,
    "op11_hard_negatives": negatives.query,
    "op12_vector_codes": vectorcodes.query,
    "op13_quality_rules": quality.query,
}
ORACLES = {
    "op1_decontaminate": decontaminate.ORACLE,
    "op2_warc": warc.ORACLE,
    "op8_exact_top_k": topk.ORACLE,
    "op9_line_dedup": linededup.ORACLE,
    "op11_hard_negatives": negatives.ORACLE,
    "op12_vector_codes": vectorcodes.ORACLE,
    "op13_quality_rules": quality.ORACLE,
}
