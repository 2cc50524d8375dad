"""A training corpus in five stages, each one of the operators of ``chainlens.llm``.

Each stage takes ``(spark, docs, sf_dir)``; its rows are written as Parquet and
read again as the next stage's ``docs``.  All stages but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chainlens.llm import stages
from chainlens.llm.common import documents, staged

STAGES = [
    ("toxicity", stages.toxicity),
    ("line_dedup", stages.line_dedup),
    ("simhash_near_dedup", stages.simhash_near_dedup),
    ("source_mixing", stages.source_mixing),
    ("packing", stages.packing),
]

#: Tokenizing, the classifier and the fingerprints are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces made from all of ``documents``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
