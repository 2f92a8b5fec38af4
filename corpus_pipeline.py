"""A corpus pipeline: quality, near-duplicates, repeated passages, mixing, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written and read again as the next one's ``docs``. All but the last return the
columns of documents; the last returns a row a packed piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomrank.llm import best_fit_packing, quality_classifier, simhash_dedup, source_mixing, substring_dedup
from fathomrank.llm.queries import tokenizer_path
from fathomrank.shared import write_table


def likelihood(docs: DataFrame) -> Column:
    """The weight of a document in the mixture, 0.1 to 1: the score of a classifier fitted on ``docs``, in steps that no rounding moves."""
    score = quality_classifier.scorer(quality_classifier.fit(docs))
    return F.lit(0.1) + F.lit(0.9) * F.round(score(F.col("text")), 4)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly labelled scorer keeps."""
    return quality_classifier.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash_dedup.near_deduplicated(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the paragraphs that an earlier one has."""
    return substring_dedup.deduplicated(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies of documents that bring each source to its target, good ones likelier."""
    return source_mixing.mixed_documents(docs, quality=likelihood(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 1024 ids."""
    return best_fit_packing.pack_documents(docs, tokenizer_path())


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("mixture", mixture), ("packing", packing)]

#: Trained scores, component search, MinHash and tokenizers have no SQL form; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of ``sf_dir``; each result is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
