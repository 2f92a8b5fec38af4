"""The stored inverted index: postings and document frequencies, in files by term.

A term lies in the partition ``crc32(term) mod BUCKETS`` and files are sorted by term, so a read for a
query's terms skips the other partitions and most row groups of its own.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomrank.operators.corpus import Corpus

BUCKETS = 16
POSTINGS = "term string, doc long, tf int, length int, bucket int"


@dataclass
class TermIndex:
    """``postings`` has term, doc, tf, length and bucket; n_docs and total_length count all documents, also empty ones."""

    postings: DataFrame
    n_docs: int
    total_length: int

    @staticmethod
    def write(corpus: Corpus, path: str) -> None:
        rows = corpus.postings().select("term", "doc", F.col("tf").cast("int"), F.col("length").cast("int"), F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(BUCKETS)).cast("int").alias("bucket"))
        # rebalanced: a partition of any size is cut among tasks
        rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "doc").write.partitionBy("bucket").parquet(path)

    @staticmethod
    def read(spark: SparkSession, paths: list[str], n_docs: int, total_length: int) -> TermIndex:
        parts = [spark.read.schema(POSTINGS).parquet(p) for p in paths]
        out = spark.createDataFrame([], POSTINGS)
        for p in parts:
            out = out.unionByName(p)
        return TermIndex(out, n_docs, total_length)

    @property
    def avgdl(self) -> float:
        return self.total_length / self.n_docs if self.n_docs else 0.0

    def of(self, terms: list[str]) -> DataFrame:
        """The postings of some terms, by partition and row group."""
        buckets = sorted({zlib.crc32(t.encode()) % BUCKETS for t in terms})
        return self.postings.where(F.col("bucket").isin(buckets) & F.col("term").isin(terms)).drop("bucket")

    def frequencies(self, terms: list[str]) -> dict[str, int]:
        return {r[0]: r[1] for r in self.of(terms).groupBy("term").count().collect()}  # a row a query term
