"""Reciprocal-rank fusion: reads ranks alone, never scores, names or how many signals there are."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomrank.operators.topk import top_k
from fathomrank.schema import RRF_CONSTANT

Fuser = Callable[[list[DataFrame], int], DataFrame]


def scaled(weights: list[float]) -> tuple[list[float], float]:
    """Weights divided by a power of two so that none exceeds 1; what a missing weight becomes."""
    most = max([w for w in weights if w > 0 and not math.isinf(w)], default=0.0)
    if most <= 1:
        return weights, 1.0
    exponent = math.frexp(most)[1]
    return [w if math.isnan(w) or math.isinf(w) else math.ldexp(w, -exponent) for w in weights], math.ldexp(1.0, -exponent)


def fused(streams: list[DataFrame], k: int, weights: list[float], constant: float = RRF_CONSTANT) -> DataFrame:
    """Sum of weight / (constant + rank) in the order of rank, then weight: equal votes give equal bits."""
    union = None
    for weight, stream in zip(weights, streams):
        if math.isnan(weight) or math.isinf(weight) or weight <= 0:
            continue
        votes = stream.select("qid", "doc", "rank", F.lit(weight).alias("weight"))
        union = votes if union is None else union.unionByName(votes)
    if union is None:
        return top_k(streams[0].limit(0), k)
    vote = F.col("weight") * (F.lit(1.0) / (F.lit(constant) + F.col("rank")))
    votes = union.withColumn("vote", vote).where("vote <> 0")
    in_order = F.array_sort(F.collect_list(F.struct("rank", "weight", "vote")))  # one vote a stream
    return top_k(votes.groupBy("qid", "doc").agg(F.aggregate(in_order, F.lit(0.0), lambda s, x: s + x["vote"]).alias("score")), k)


def fuse(streams: list[DataFrame], k: int) -> DataFrame:
    return fused(streams, k, [1.0] * len(streams))


def fuse_weighted(*weights: float) -> Fuser:
    """Weights by position; a missing one is 1, surplus ones are ignored, also by scaling."""

    def run(streams: list[DataFrame], k: int) -> DataFrame:
        active, other = scaled(list(weights[: len(streams)]))
        return fused(streams, k, active + [other] * (len(streams) - len(active)))

    return run


def rrf(constant: float) -> Fuser:
    """Equal weights with another rank constant, which must be finite and not negative."""
    if not math.isfinite(constant) or constant < 0:
        raise ValueError(f"rank constant {constant}")
    return lambda streams, k: fused(streams, k, [1.0] * len(streams), constant)
