"""The operators' queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parcelflow.llm import decontaminate, jaccard, langid, packing, quality, secrets, suffixdedup, tokencount, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        toxicity.op1_toxicity, packing.op2_best_fit_packing, quality.op3_quality_rules, secrets.op4_secret_scans, jaccard.op5_ngram_jaccard_join,
        tokencount.op6_token_counts, langid.op7_language_id, warc.op8_warc, decontaminate.op9_benchmark_decontamination, suffixdedup.op10_suffix_array_dedup,
    )
}

#: What needs no file; sql() has the rest too.
SQL: dict[str, str] = {"op3_quality_rules": quality.SQL, "op5_ngram_jaccard_join": jaccard.SQL, "op7_language_id": langid.SQL, "op8_warc": warc.SQL, "op10_suffix_array_dedup": suffixdedup.SQL}


def sql() -> dict[str, str]:
    """All SQL; that of op6 holds the vocabulary, which is read here."""
    return {**SQL, "op6_token_counts": tokencount.sql()}
