"""The corpus pipeline: documents to a mixed training set, in five stages over all that the one before kept.

Every stage but the last returns the columns of its input. Rows with equal ids stay rows of their own until
near-duplicate removal, which keeps one row of each group. An empty table passes through as an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import decontaminate, jaccard, langid, mixing, quality_classifier
from loomgraph.llm.common import drop, materialise, read_table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised by a margin; what has no letter (nulls, empties) or ties goes. Without labels, all go."""
    return langid.accepted(docs, langid.learn(docs, F.col("text"), F.col("lang"), F.col("doc_id")))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the hierarchical classifier keeps; null sources and languages are sites and paths of their own."""
    return quality_classifier.keep(docs, read_table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates; texts without words are in no group and stay."""
    return jaccard.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; nulls and empties hold none."""
    return decontaminate.clean(docs, decontaminate.models(docs, read_table(spark, sf_dir, "benchmark")))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, with its text, sources evened out as far as two passes allow; a null source is one."""
    return mixing.mix(docs, target_entropy=1.0, max_repeat=2.0, budget="cover", carry=("text",))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("mixture", mixture),
]

#: Compression, iterated models and components have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
        if before is not None:
            drop(before)  # the next stage reads only what this one kept
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
