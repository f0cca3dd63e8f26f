"""Queries of this package by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import op01_warc, op04_quality_rules, op06_line_dedup, op08_mixing, op11_filter_audit as op11, op12_jaccard_join as op12, op13_merkle_manifest as op13
from plumbline.llm.op02_fingerprints import op2_fingerprints
from plumbline.llm.op03_token_counts import op3_token_counts
from plumbline.llm.op05_quality_classifier import op5_quality_classifier
from plumbline.llm.op07_substring_dedup import op7_substring_dedup
from plumbline.llm.op09_byte_bpe import op9_byte_bpe
from plumbline.llm.op10_minhash import op10_minhash
from plumbline.llm.op11_filter_audit import op11_filter_audit
from plumbline.llm.op12_jaccard_join import op12_jaccard_join
from plumbline.llm.op13_merkle_manifest import op13_merkle_manifest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op01_warc.op1_warc,
    "op2_fingerprints": op2_fingerprints,
    "op3_token_counts": op3_token_counts,
    "op4_quality_rules": op04_quality_rules.op4_quality_rules,
    "quality_ablations": op04_quality_rules.quality_ablations,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_line_dedup": op06_line_dedup.op6_line_dedup,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_mixing": op08_mixing.op8_mixing,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_minhash": op10_minhash,
    "op11_filter_audit": op11_filter_audit,
    "op12_jaccard_join": op12_jaccard_join,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLES: dict[str, str] = {
    "op1_warc": op01_warc.ORACLE,
    "op4_quality_rules": op04_quality_rules.ORACLE,
    "quality_ablations": op04_quality_rules.ABLATIONS_ORACLE,
    "op6_line_dedup": op06_line_dedup.ORACLE,
    "op8_mixing": op08_mixing.ORACLE,
    "op11_filter_audit": op11.ORACLE,
    "op12_jaccard_join": op12.ORACLE,
    "op13_merkle_manifest": op13.ORACLE,
}
