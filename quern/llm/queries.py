"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from quern.llm import exact_dedup, html_extraction, licenses, media, mixing, near_dedup, packing, pii, token_counts, toxicity
from quern.llm.common import table

QUERIES = {
    "op1_bagminhash": lambda spark, sf: near_dedup.classes(table(spark, sf, "documents")),
    "op2_license_scan": lambda spark, sf: licenses.scan(table(spark, sf, "documents"), licenses.document_path()),
    "op3_retrieval_packing": lambda spark, sf: packing.pack(table(spark, sf, "documents"), token_counts.vocabulary("word_bpe_49k.json")),
    "op4_boosted_toxicity": lambda spark, sf: toxicity.toxicity(table(spark, sf, "documents"), table(spark, sf, "labels")),
    "op5_fst_token_counts": lambda spark, sf: token_counts.count_tokens(table(spark, sf, "documents"), token_counts.vocabulary("byte_bpe_50k.json")),
    "op6_jpeg_columns": lambda spark, sf: media.media_columns(table(spark, sf, "documents")),
    "op7_pareto_mixing": lambda spark, sf: mixing.mix(table(spark, sf, "documents")),
    "op8_pii_candidates": lambda spark, sf: pii.find(table(spark, sf, "documents")),
    "op9_wrapper_induction": lambda spark, sf: html_extraction.extract(table(spark, sf, "pages")),
    "op10_exact_dedup": lambda spark, sf: exact_dedup.exact_groups(table(spark, sf, "documents")),
}

ORACLE = {
    "op2_license_scan": licenses.oracle(),
    "op7_pareto_mixing": mixing.ORACLE,
    "op10_exact_dedup": exact_dedup.ORACLE,
}
