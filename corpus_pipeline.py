"""The pipeline over documents: each stage's result is written and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import decontamination, language_id, near_duplicates, source_mix, token_output
from graphloom.llm.common import documents, written


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.stage(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: Language ID drops what it rejects, near duplicates keep one of each group, decontamination drops leaks, the mix takes each
#: document as often as its source's target says, and the output returns every written document's place.
STAGES = [
    ("language_id", lambda spark, docs, sf_dir: language_id.stage(spark, docs)),
    ("near_duplicates", lambda spark, docs, sf_dir: near_duplicates.stage(spark, docs)),
    ("decontamination", _decontaminate),
    ("source_mix", lambda spark, docs, sf_dir: source_mix.stage(spark, docs)),
    ("token_output", lambda spark, docs, sf_dir: token_output.stage(spark, docs)),
]

#: The trained stages have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
