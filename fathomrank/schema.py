"""Schemas, constants and errors of the ranking engine."""

from __future__ import annotations

from pyspark.sql import types as T

K1, B = 1.2, 0.75
RRF_CONSTANT = 60.0
MAX_HOPS, SEED_COUNT = 3, 5
HALF_LIFE_SECONDS = 30 * 24 * 3600
IVF_GATE, IVF_PROBES, IVF_MOST_LISTS, IVF_SAMPLE, IVF_ROUNDS = 4 * 64 * 64, 64, 1024, 20_000, 5

DOCUMENT = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("vector", T.ArrayType(T.FloatType())),
        T.StructField("links", T.ArrayType(T.StringType())),
        T.StructField("time", T.TimestampType()),
    ]
)
QUERY = "qid string, text string, vector array<float>, seeds array<string>"
STREAM = "qid string, rank int, doc long, score double"


class RankingError(ValueError):
    """Base of everything that this engine refuses."""


class EmptyKey(RankingError):
    pass


class DuplicateKey(RankingError):
    pass


class NonFiniteVector(RankingError):
    pass


class WidthMismatch(RankingError):
    pass


class TooManyDocuments(RankingError):
    pass


class NoFuser(RankingError):
    pass


class NilScorer(RankingError):
    pass


class CorruptStore(RankingError):
    pass


class BadVersion(RankingError):
    pass


class NoScorers(RankingError):
    pass


class OverfetchRange(RankingError):
    pass


class NoQueries(RankingError):
    pass


class BadQueryId(RankingError):
    pass


class DuplicateQuery(RankingError):
    pass


class ForeignDocument(RankingError):
    pass


class DuplicateRanked(RankingError):
    pass


class Unpaired(RankingError):
    pass


class NoIterations(RankingError):
    pass


class EmptyDataset(RankingError):
    pass


class BadRecord(RankingError):
    pass


class MissingId(RankingError):
    pass


class DuplicateDocument(RankingError):
    pass


class NoJoinColumn(RankingError):
    pass


class UnknownQuery(RankingError):
    pass


class UnmatchedVectors(RankingError):
    pass


class StaleWriter(RankingError):
    pass


class Unpinned(RankingError):
    pass
