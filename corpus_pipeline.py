"""The corpus pipeline: documents through quality classifier, near-copy removal, decontamination, mixing and token output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gneiss.llm.decontaminate import drop_leaked
from gneiss.llm.mixing import mixed
from gneiss.llm.quality_classifier import THRESHOLD, fit, with_scores
from gneiss.llm.queries import tokenizer_path
from gneiss.llm.session import free_name, table, written
from gneiss.llm.simhash import drop_near_copies
from gneiss.llm.token_store import tokenize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on labels, doesn't reject."""
    score = free_name(docs, "score")
    return with_scores(docs, fit(docs, table(spark, sf_dir, "labels")), score).where(F.col(score) >= THRESHOLD).drop(score)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return drop_near_copies(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_leaked(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it."""
    return mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in range-coded files; what they hold of each document."""
    return tokenize(docs, tokenizer_path())


STAGES = [("quality_classifier", quality), ("simhash_near_dedup", near_copies), ("decontamination", benchmark), ("mixing", mix), ("token_output", tokens)]

#: The classifier, the seeded draws and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
