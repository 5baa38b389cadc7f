"""The corpus pipeline: each stage works on what its predecessor kept, written as Parquet and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from webloom.llm import decontamination, language_id, line_dedup, ngram_join, packing
from webloom.llm._common import bound_batches, work_dir


def bounded(stage: Callable) -> Callable:
    """The stage, with Arrow batches of bounded bytes: its result is lazy, so the session keeps the bound."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("language_id", bounded(language_id.keep_identified)),
    ("line_dedup", bounded(line_dedup.keep_lines)),
    ("ngram_jaccard_join", bounded(ngram_join.keep_one)),
    ("decontamination", bounded(decontamination.keep_clean)),
    ("packing", bounded(packing.pack_all)),
]

#: The first stage is a trained model, which SQL can't express; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = work_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
