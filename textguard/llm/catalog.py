"""Registered queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textguard.llm import (
    decontaminate,
    html_extract,
    language_id,
    lexical_search,
    license_scan,
    mixing,
    ngram_join,
    packing,
    quality_classifier,
    quality_rules,
    suffix_dedup,
    url_filter,
    whitening,
)
from textguard.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def _over(fn: Callable[..., DataFrame], *names: str) -> Query:
    return lambda spark, sf_dir: fn(*(table(spark, sf_dir, n) for n in names))


def queries() -> dict[str, Query]:
    return {
        "op1_quality_rules": _over(quality_rules.query, "documents"),
        "op2_license_scan": _over(license_scan.query, "documents"),
        "op3_packing": _over(packing.query, "documents"),
        "op4_suffix_dedup": _over(suffix_dedup.query, "documents"),
        "op5_url_filters": _over(url_filter.query, "pages"),
        "op6_quality_classifier": _over(quality_classifier.query, "documents", "labels"),
        "op7_html_extraction": _over(html_extract.query, "pages"),
        "op8_ngram_join": _over(ngram_join.query, "documents"),
        "op9_language_id": _over(language_id.query, "documents"),
        "op10_decontamination": _over(decontaminate.query, "documents", "benchmark"),
        "op11_whitening": _over(whitening.query, "embeddings"),
        "op12_mixing": _over(mixing.query, "documents"),
        "op13_lexical_search": _over(lexical_search.query, "documents", "benchmark"),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": quality_rules.SQL,
        "op2_license_scan": license_scan.SQL,
        "op5_url_filters": url_filter.SQL,
        "op8_ngram_join": ngram_join.SQL,
        "op12_mixing": mixing.SQL,
        "op13_lexical_search": lexical_search.SQL,
    }
