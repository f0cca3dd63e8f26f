"""Documents to token ids in five stages, each an operator of ``plumbline.llm``.

Every stage takes what the one before kept; ``run`` writes each stage's rows to the
shared folder and reads them again.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import op04_quality_rules, op06_line_dedup, op08_mixing, op09_byte_bpe, op10_minhash
from plumbline.llm.common import table, written

#: No document is repeated: one epoch of each leaf, four fifths of the tokens there are.
MIXTURE = op08_mixing.Mixture(target_percent=80, max_epochs=1)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a bit of the current policy's mask in the ledger."""
    return op04_quality_rules.filter_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that stand on many sources; a text of nothing else is left to the next stage."""
    return op06_line_dedup.without_boilerplate(docs, "source", spare_copies=True, length_col="n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of least id."""
    return op10_minhash.deduplicated(docs, width=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within their leaves' budgets."""
    return op08_mixing.mix(docs, MIXTURE)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, as count and digests."""
    return op09_byte_bpe.encoding_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near duplicates", near_duplicates),
    ("mixing", mixing),
    ("byte-level BPE", byte_bpe),
]

#: Byte-level BPE cannot be expressed in SQL; tests/llm holds ``run`` against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
