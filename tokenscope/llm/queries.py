"""Queries of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tokenscope.llm import bloomlookup, crosstoken, decontam, divergence, neardup, pieces, quality, styletree, substring, tokencount, toxicity, urls, warc
from tokenscope.llm.common import prepare


def _prepared(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return fn(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {
        "op1_decontamination": decontam.op1_decontamination,
        "op2_quality_rules": quality.op2_quality_rules,
        "op3_token_counts": tokencount.op3_token_counts,
        "op4_substring_dedup": substring.op4_substring_dedup,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_minhash_neardup": neardup.op6_minhash_neardup,
        "op7_sentencepiece": pieces.op7_sentencepiece,
        "op8_warc_derivatives": warc.op8_warc_derivatives,
        "op9_url_filters": urls.op9_url_filters,
        "op10_html_extraction": styletree.op10_html_extraction,
        "op11_document_fingerprints": bloomlookup.op11_document_fingerprints,
        "op12_cross_tokenizer_alignment": crosstoken.op12_cross_tokenizer_alignment,
        "op13_source_divergence": divergence.op13_source_divergence,
    }
    return {k: _prepared(f) for k, f in found.items()}


def oracle_sql() -> dict[str, str]:
    return {"op4_substring_dedup": substring.SQL, "op9_url_filters": urls.SQL, "op13_source_divergence": divergence.SQL}
