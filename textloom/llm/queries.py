"""The queries of this subpackage, by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import bpe, decontam, lang_id, ppm, quality, sharding, simhash, sketch, token_tree, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": token_tree.op1_token_counts,
    "op2_bpe": bpe.op2_bpe,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_quality": quality.op4_quality,
    "op5_ppm": ppm.op5_ppm,
    "op6_decontamination": decontam.op6_decontamination,
    "op7_simhash": simhash.op7_simhash,
    "op8_lang_id": lang_id.op8_lang_id,
    "op9_fingerprints": sketch.op9_fingerprints,
    "op10_sharding": sharding.op10_sharding,
}

ORACLE: dict[str, str] = {"op6_decontamination": decontam.ORACLE_SQL}
