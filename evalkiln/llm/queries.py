"""The registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evalkiln.llm import bpe, brown, decontaminate, dual_tree, fertility, html_text, infill, language, licences, pii, secrets, simhash, token_store

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_secret_scans": secrets.op1_secret_scans,
        "op2_licence_scans": licences.op2_licence_scans,
        "op3_personal_data": pii.op3_personal_data,
        "op4_token_store": token_store.op4_token_store,
        "op5_byte_bpe": bpe.op5_byte_bpe,
        "op6_language_id": language.op6_language_id,
        "op7_html_extraction": html_text.op7_html_extraction,
        "op8_simhash_near_dedup": simhash.op8_simhash_near_dedup,
        "op9_benchmark_decontamination": decontaminate.op9_benchmark_decontamination,
        "op10_quality_rules": fertility.op10_quality_rules,
        "op11_centroid_clustering": dual_tree.op11_centroid_clustering,
        "op12_fill_in_middle": infill.op12_fill_in_middle,
        "op13_language_model": brown.op13_language_model,
    }


def oracle_sql() -> dict[str, str]:
    """Only operators that SQL can express; the others are tested against brute force."""
    return {"op2_licence_scans": licences.op2_sql(), "op11_centroid_clustering": dual_tree.op11_sql(), "op12_fill_in_middle": infill.op12_sql()}
