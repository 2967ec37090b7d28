"""The corpus pipeline: its stages in order, each on all that its predecessor kept.

Every stage but the last returns the columns of ``documents``; the last adds what mixing decided.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadwatch.llm.common import scratch
from spreadwatch.llm.decontaminate import decontaminate
from spreadwatch.llm.language_id import best_score, learn
from spreadwatch.llm.line_dedup import apply_line_dedup
from spreadwatch.llm.mixing import TARGETS, mix, source_domain
from spreadwatch.llm.ngram_join import keep_one_per_component

#: A document goes when no language fits it, or none fits much better than the others.
MIN_LANGUAGE_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognised language."""
    return docs.where(best_score(docs, *learn(docs))(F.col("text")) >= MIN_LANGUAGE_SCORE)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated lines out of the texts; n_chars follows."""
    out = apply_line_dedup(docs).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by five-word shingles at a similarity of 0.8 or more."""
    return keep_one_per_component(docs, words=5, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of the benchmark."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Selects documents towards the target weights of domains, languages and sources."""
    return mix(docs, source_domain(F.col("source")), TARGETS)


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_copies", near_copies),
    ("benchmark", benchmark),
    ("mixture", mixture),
]

#: SQL can't express language ID and edit matching; tests/llm compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each result written before the next stage reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
