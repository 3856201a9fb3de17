"""The queries of this subpackage for the driver, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import (
    ann, bytepair, decontam, divergence, langid, licenses, mixing, ngram_lm, simhash, spans, toxicity, turns, webpages,
)


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": spans.op1_substring_dedup,
        "op2_decontamination": decontam.op2_decontamination,
        "op3_lm_scores": ngram_lm.op3_lm_scores,
        "op4_mixing": mixing.op4_mixing,
        "op5_simhash": simhash.op5_simhash,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_license_scan": licenses.op7_license_scan,
        "op8_language_id": langid.op8_language_id,
        "op9_nearest_neighbours": ann.op9_nearest_neighbours,
        "op10_html_extraction": webpages.op10_html_extraction,
        "op11_byte_bpe": bytepair.op11_byte_bpe,
        "op12_turn_repair": turns.op12_turn_repair,
        "op13_divergence": divergence.op13_divergence,
        "pipeline": _pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_mixing": mixing.OP4_SQL,
        "op7_license_scan": licenses.OP7_SQL,
        "op12_turn_repair": turns.OP12_SQL,
        "op13_divergence": divergence.OP13_SQL,
    }
