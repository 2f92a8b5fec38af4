"""Inverted-file index for cosine search: few centroids, each vector in its nearest one's list.

Training is without randomness: a strided sample, strided first centroids, a fixed number of
spherical k-means rounds on at most ``IVF_SAMPLE`` vectors. Lists number at most
``IVF_MOST_LISTS``, which bounds what is broadcast; every vector is assigned.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomrank.functions.columns import has_direction
from fathomrank.operators.corpus import Corpus
from fathomrank.operators.scorers import _HITS, VectorScorer, _emit, _none, cosine_block
from fathomrank.operators.topk import top_k
from fathomrank.schema import IVF_GATE, IVF_MOST_LISTS, IVF_PROBES, IVF_ROUNDS, IVF_SAMPLE, WidthMismatch
from fathomrank.shared import shared_dir

_LISTS = "doc long, vector array<float>, list int"


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(1, keepdims=True))
    return np.where(n > 0, x / np.where(n > 0, n, 1), x)


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def train(sample: np.ndarray, lists: int, rounds: int = IVF_ROUNDS) -> np.ndarray:
    """Unit centroids from unit vectors; a list left empty keeps its centroid."""
    c = sample[(np.arange(lists) * len(sample)) // lists].copy()
    for _ in range(rounds):
        a = (sample @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, a, sample)
        filled = np.bincount(a, minlength=lists) > 0
        c[filled] = _unit(total[filled])
    return c


@dataclass
class InvertedFile:
    centroids: np.ndarray
    lists: DataFrame | None  # doc, vector, list: files by list
    sizes: dict[int, int]
    covered: int  # documents below this number are in the lists

    @staticmethod
    def none() -> InvertedFile:
        """An index of nothing: every document is a candidate."""
        return InvertedFile(np.zeros((0, 0)), None, {}, 0)

    @staticmethod
    def stored(spark: SparkSession, path: str, centroids: list, sizes: dict[int, int], covered: int) -> InvertedFile:
        return InvertedFile(np.array(centroids), spark.read.schema(_LISTS).parquet(path), sizes, covered)

    @staticmethod
    def build(corpus: Corpus, gate: int = IVF_GATE, path: str | None = None) -> InvertedFile | None:
        """None below the gate or without vectors: the exact scan is the index then. ``path`` is where the lists are kept."""
        rows = corpus.docs.where(has_direction(F.col("vector"))).select("doc", "vector")
        n, most = rows.agg(F.count("*"), F.max("doc")).first()
        if n == 0 or n < gate:
            return None
        stride = 1 + (most // IVF_SAMPLE)
        got = rows.where(F.col("doc") % stride == 0).toArrow()  # at most IVF_SAMPLE rows
        if got.num_rows == 0:
            got = rows.orderBy("doc").limit(IVF_SAMPLE).toArrow()
        order = np.argsort(got.column("doc").to_numpy())
        sample = _unit(_rows(got.column("vector").combine_chunks())[order])
        lists = min(int(np.ceil(np.sqrt(n))), IVF_MOST_LISTS, len(sample))
        centroids = train(sample, lists)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = _unit(_rows(b.column(1))) if b.num_rows else np.zeros((0, centroids.shape[1]))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array((x @ centroids.T).argmax(axis=1).astype(np.int32))], names=["doc", "vector", "list"])

        spark = corpus.docs.sparkSession
        path = path or f"{shared_dir(spark)}/ivf-lists-{uuid.uuid4().hex[:12]}"
        # a list is a folder, so a probe reads its own lists' files alone
        rows.mapInArrow(run, _LISTS).hint("rebalance", "list").sortWithinPartitions("list", "doc").write.partitionBy("list").parquet(path)
        assigned = spark.read.schema(_LISTS).parquet(path)
        sizes = {r[0]: r[1] for r in assigned.groupBy("list").count().collect()}  # at most IVF_MOST_LISTS
        return InvertedFile(centroids, assigned, sizes, corpus.docs.agg(F.max("doc")).first()[0] + 1)

    def candidates(self, corpus: Corpus, vector: list[float], k: int) -> DataFrame:
        """doc of the probed lists' members and of all later documents with a vector, ascending; all of them for another width."""
        v = np.array(vector, dtype=np.float64)
        every = corpus.docs.where(F.size("vector") > 0).select("doc")
        if self.lists is None or len(v) != self.centroids.shape[1] or not v.any():
            return every.orderBy("doc")
        later = every.where(F.col("doc") >= self.covered)
        return self.lists.where(F.col("list").isin(self.probe(v / np.sqrt((v * v).sum()), k))).select("doc").unionByName(later).distinct().orderBy("doc")

    def probe(self, v: np.ndarray, k: int, probes: int = IVF_PROBES) -> list[int]:
        """Lists by inner product, ties to the lower one, until ``probes`` filled ones and k members are met."""
        out, members = [], 0
        for i in np.argsort(-(self.centroids @ v), kind="stable"):
            if len(out) >= probes and members >= k:
                break
            if n := self.sizes.get(int(i), 0):
                out.append(int(i))
                members += n
        return out


class IvfVectorScorer(VectorScorer):
    """Cosine over the probed lists; exact where the corpus has no index."""

    def __init__(self, corpus: Corpus, index: InvertedFile | None, probes: int = IVF_PROBES):
        super().__init__(corpus)
        self.index, self.probes = index, probes

    def stream(self, queries: DataFrame, k: int) -> DataFrame:
        if self.index is None or k <= 0:
            return super().stream(queries, k)
        readers: dict[int, list[tuple[str, np.ndarray]]] = {}
        for q, v in self.queries(queries):
            if len(v) != self.index.centroids.shape[1]:
                raise WidthMismatch(f"query {q} has width {len(v)}, the index {self.index.centroids.shape[1]}")
            for i in self.index.probe(v / np.sqrt((v * v).sum()), k, self.probes):
                readers.setdefault(i, []).append((q, v))
        if not readers:
            return _none(queries)
        rows = self.index.lists.where(F.col("list").isin(sorted(readers)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                lists = b.column(2).to_numpy(zero_copy_only=False)
                for i in np.unique(lists):
                    part = b.take(pa.array(np.flatnonzero(lists == i)))
                    yield from cosine_block(readers[int(i)], k)(iter([part.select([0, 1])]))
                if b.num_rows == 0:
                    yield _emit([])

        out = rows.select("doc", "vector", "list").mapInArrow(run, _HITS)
        later = self.corpus.docs.where((F.col("doc") >= self.index.covered) & (F.size("vector") > 0))
        if not later.isEmpty():  # what was added since the lists were built is compared as a whole
            out = out.unionByName(VectorScorer(Corpus(later)).stream(queries, k).select("qid", "doc", "score"))
        return top_k(out, k)
