"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, centroids, decontaminate, divergence, line_dedup, ngram_join, packing, perplexity, pii, quality, suffix_dedup, url_filters


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
        "op2_ngram_join": ngram_join.op2_ngram_join,
        "op3_quality_classifier": quality.op3_quality_classifier,
        "op4_quality_rules": perplexity.op4_quality_rules,
        "op5_line_dedup": line_dedup.op5_line_dedup,
        "op6_nearest_neighbours": ann.op6_nearest_neighbours,
        "op7_pii": pii.op7_pii,
        "op8_packing": packing.op8_packing,
        "op9_url_filters": url_filters.op9_url_filters,
        "op10_bpe": bpe.op10_bpe,
        "op11_source_divergence": divergence.op11_source_divergence,
        "op12_centroid_clusters": centroids.op12_centroid_clusters,
        "op13_decontamination": decontaminate.op13_decontamination,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_line_dedup": line_dedup.OP5_SQL,
        "op9_url_filters": url_filters.OP9_SQL,
        "op11_source_divergence": divergence.OP11_SQL,
        "op12_centroid_clusters": centroids.OP12_SQL,
        "op13_decontamination": decontaminate.OP13_SQL,
    }
