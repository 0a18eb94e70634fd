"""From raw documents to encoded ones: the stages of the corpus pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terrahac.llm.common import table
from terrahac.llm.queries import identified, op9_encoded, uncontaminated, without_copies

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("language", identified),
    ("copies", without_copies),
    ("benchmark", uncontaminated),
    ("sentencepiece", op9_encoded),
]

#: Stages 1 and 4 have no form in SQL; tests hold the whole against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
