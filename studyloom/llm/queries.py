"""The queries of this subpackage by name, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, collocations, cross_align, html_extract, jaccard_join, line_dedup, mixing, pii, quality, substring_dedup, topk, toxicity, vector_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_topk_search": topk.query,
    "op2_quality_rules": quality.query,
    "op3_html_extraction": html_extract.query,
    "op4_pii": pii.query,
    "op5_line_dedup": line_dedup.query,
    "op6_ngram_jaccard_join": jaccard_join.query,
    "op7_mixing_sources": mixing.query,
    "op8_substring_dedup": substring_dedup.query,
    "op9_toxicity": toxicity.query,
    "op10_bpe_encode_decode": bpe.query,
    "op11_phrase_collocations": collocations.query,
    "op12_cross_tokenizer_alignment": cross_align.query,
    "op13_vector_dedup": vector_dedup.query,
}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_topk_search": topk.ORACLE,
    "op7_mixing_sources": mixing.ORACLE,
    "op11_phrase_collocations": collocations.ORACLE,
    "op13_vector_dedup": vector_dedup.ORACLE,
}
