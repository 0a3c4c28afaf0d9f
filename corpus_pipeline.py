"""The corpus pipeline: language ID, exact dedup, near dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; run() writes each one's result as
Parquet in the shared folder and reads it again. The last stage returns the mix: one row per document that is left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gleanery.llm import common, decontaminate, exact_dedup, langid, mixing, near_dedup

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_copies(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("decontamination", benchmark_free),
    ("mixing", mixed),
]

#: SQL can't express the language model or the drawn mix; tests/llm holds them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        at = common.stage_path(spark, f"stage-{name}")
        with common.scratch(spark):  # what the stage wrote on its way goes once its result is written
            kept = stage(spark, docs, sf_dir)
            kept.write.parquet(at)
        docs = spark.read.schema(kept.schema).parquet(at)
    return STAGES[-1][1](spark, docs, sf_dir)
