"""Search: run scorers, fuse their streams; explanations by the rank in each stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomrank.operators.fusion import Fuser
from fathomrank.operators.scorers import GraphScorer, Scorer
from fathomrank.schema import SEED_COUNT, NilScorer, NoFuser
from fathomrank.shared import write_table


class Streams:
    """The streams of a query set, each scorer run once: at its greatest depth, if that is asked for first."""

    def __init__(self, queries: DataFrame):
        self.queries, self._made = queries, {}

    def of(self, scorer: Scorer, k: int) -> DataFrame:
        depth, stream = self._made.get(id(scorer), (0, None))
        if depth < k:
            seed = scorer.seed if isinstance(scorer, GraphScorer) else None
            stream = scorer.stream(self.queries, k, self.of(seed, SEED_COUNT)) if seed is not None else scorer.stream(self.queries, k)
            stream = write_table(stream, f"stream-{scorer.name}")
            self._made[id(scorer)] = (k, stream)
        return stream.where(F.col("rank") <= k)


def streams_of(queries: DataFrame, k: int, scorers: tuple[Scorer, ...]) -> list[DataFrame]:
    made = Streams(queries)
    for s in scorers:  # a seed scorer that is a signal too is deep enough for both
        if k >= SEED_COUNT and any(isinstance(other, GraphScorer) and other.seed is s for other in scorers):
            made.of(s, k)
    return [made.of(s, k) for s in scorers]


def search(queries: DataFrame, k: int, fuser: Fuser | None, *scorers: Scorer) -> DataFrame:
    """(qid, rank, doc, score) of every query at once; misuse is refused before k is looked at."""
    if fuser is None:
        raise NoFuser("no fuser")
    if any(s is None for s in scorers):
        raise NilScorer("a scorer is None")
    if k <= 0 or not scorers:
        return queries.sparkSession.createDataFrame([], "qid string, rank int, doc long, score double")
    return fuser(streams_of(queries, k, scorers), k)


def explain(queries: DataFrame, k: int, fuser: Fuser, *scorers: Scorer) -> DataFrame:
    """The search result with the rank that each scorer gave, null where it had none."""
    streams = streams_of(queries, k, scorers)
    out = fuser(streams, k)
    for s, stream in zip(scorers, streams):
        out = out.join(stream.select("qid", "doc", F.col("rank").alias(f"{s.name}_rank")), ["qid", "doc"], "left")
    return out


def parse_query(line: str) -> tuple[str, list[float]]:
    """``TEXT @ v1,v2``: text and an optional vector, split at the first @."""
    text, _, vector = line.partition("@")
    return text.strip(), [float(x) for x in vector.split(",") if x.strip()]


def parse_queries(lines: DataFrame) -> DataFrame:
    """``parse_query`` of the column line of many rows: adds text and vector; a part that is no number makes its component null."""
    vector = F.when(F.col("line").contains("@"), F.split(F.expr("substr(line, instr(line, '@') + 1)"), ",")).otherwise(F.array())
    numbers = F.transform(F.filter(F.transform(vector, lambda x: F.trim(x)), lambda x: x != ""), lambda x: x.try_cast("float"))
    return lines.withColumn("text", F.trim(F.substring_index("line", "@", 1))).withColumn("vector", numbers)
