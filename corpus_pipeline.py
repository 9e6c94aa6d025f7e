"""A training-data pipeline over ``documents``: each stage is one operator of ``txrisk.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from txrisk.llm.decontamination import stage_decontaminate
from txrisk.llm.jaccard import stage_near_duplicates
from txrisk.llm.mixing import stage_mix
from txrisk.llm.token_orc import stage_tokens
from txrisk.llm.toxicity import stage_toxicity
from txrisk.session import fresh_path

STAGES = [
    ("toxicity", stage_toxicity),
    ("ngram_jaccard_join", stage_near_duplicates),
    ("benchmark_decontamination", stage_decontaminate),
    ("mixing", stage_mix),
    ("token_output", stage_tokens),
]

# toxicity and decontamination are learned from the data: SQL cannot express them
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
