"""The only ordering code: score descending, NaN last, document ascending."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomrank.schema import STREAM


def ranking(score: str = "score", doc: str = "doc") -> list[Column]:
    return [F.isnan(score), F.desc(score), F.asc(doc)]


def top_k(candidates: DataFrame, k: int) -> DataFrame:
    """(qid, rank, doc, score): the k best of each query; no rows for k <= 0.

    Spark limits each partition's groups before the shuffle, so a query's whole candidate list is
    never in one task.
    """
    if k <= 0:
        return candidates.sparkSession.createDataFrame([], STREAM)
    order = Window.partitionBy("qid").orderBy(*ranking())
    return candidates.select("qid", "doc", "score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", "rank", "doc", "score")
