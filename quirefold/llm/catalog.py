"""Queries of this subpackage and, where SQL can express them, the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import arcwarc, bpe, classlm, gam, hnsw, langid, nearjoin, packing, rules, tokenbits

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": gam.op1_quality_classifier,
    "op2_ngram_jaccard_join": nearjoin.op2_ngram_jaccard_join,
    "op3_arc_to_warc": arcwarc.op3_arc_to_warc,
    "op4_token_bits": tokenbits.op4_token_bits,
    "op5_packing": packing.op5_packing,
    "op6_bpe": bpe.op6_bpe,
    "op7_hnsw": hnsw.op7_hnsw,
    "op8_class_lm": classlm.op8_class_lm,
    "op9_quality_rules": rules.op9_quality_rules,
    "op10_language_id": langid.op10_language_id,
}
SQL: dict[str, str] = {"op3_arc_to_warc": arcwarc.sql(), "op9_quality_rules": rules.sql(), "op10_language_id": langid.sql()}
