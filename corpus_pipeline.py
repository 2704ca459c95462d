"""The corpus pipeline: stages over documents, each written before the next reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandframe.llm import decontaminate, mixing, neardup, pii, quality
from strandframe.session import materialize, read_table

STAGES = [
    ("quality classifier", quality.stage),
    ("MinHash near-dedup", neardup.stage),
    ("benchmark decontamination", decontaminate.stage),
    ("PII", pii.stage),
    ("mixing sources to target weights", mixing.stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
