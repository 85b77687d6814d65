"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from medspan.llm import chat_format, fingerprint, line_dedup, media, ngram_join, packing, periodic_runs, sentencepiece_sampling, sharding, spelling_variants, suffix_dedup, toxicity, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_media_columns": media.op1_media_columns,
        "op2_ngram_jaccard_join": ngram_join.op2_ngram_jaccard_join,
        "op3_sharding": sharding.op3_sharding,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_packing": packing.op5_packing,
        "op6_document_fingerprints": fingerprint.op6_document_fingerprints,
        "op7_sentencepiece_sampling": sentencepiece_sampling.op7_sentencepiece_sampling,
        "op8_url_filters": url_filter.op8_url_filters,
        "op9_line_dedup": line_dedup.op9_line_dedup,
        "op10_suffix_array_dedup": suffix_dedup.op10_suffix_array_dedup,
        "op11_spelling_variants": spelling_variants.op11_spelling_variants,
        "op12_chat_format": chat_format.op12_chat_format,
        "op13_periodic_runs": periodic_runs.op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_line_dedup": line_dedup.ORACLE_SQL, "op12_chat_format": chat_format.ORACLE_SQL}
