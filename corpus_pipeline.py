"""The corpus pipeline: five stages from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; a runner may write it as
Parquet and read it again before the next stage. All but the last return the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from urbanspark.functions.session import checkpointed
from urbanspark.llm import decontaminate, language_id, line_dedup, near_dedup, pieces

STAGES = [
    ("language_id", language_id.stage),
    ("line_dedup", line_dedup.stage),
    ("near_dedup", near_dedup.stage),
    ("decontaminate", decontaminate.stage),
    ("sentencepiece", pieces.stage),
]

#: Language and token stages have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *early, (_, last) = STAGES
    for _, stage in early:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return last(spark, docs, sf_dir)
