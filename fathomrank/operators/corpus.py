"""Corpus tables derived from documents: ids, terms, statistics, links."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomrank.functions.columns import tokens
from fathomrank.schema import DOCUMENT, DuplicateKey, EmptyKey, NonFiniteVector, TooManyDocuments, WidthMismatch
from fathomrank.shared import global_index, small_batches, write_table

MOST_DOCUMENTS = 2**32 - 1
#: Tokens that a Python step works on at once.
TOKENS_A_PIECE = 1 << 18
#: A timestamp that means "absent" where the data came from a source without nulls.
ZERO_TIME_MICROS = -62_135_596_800_000_000


def _bad_component(x):
    return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))


def violations(docs: DataFrame) -> DataFrame:
    """One row of what ingest would refuse: empty_keys, repeated_keys, bad_vectors and how many widths there are."""
    size = F.when(F.coalesce(F.size("vector"), F.lit(-1)) > 0, F.size("vector"))
    empty = F.col("key").isNull() | (F.col("key") == "")
    row = docs.agg(F.count_if(empty).alias("empty_keys"), F.count_if(F.coalesce(F.exists("vector", _bad_component), F.lit(False))).alias("bad_vectors"), F.count_distinct(size).alias("widths"))
    twice = docs.where(~empty).groupBy("key").count().where("count > 1").agg(F.count("*").alias("repeated_keys"))
    return row.withColumn("_", F.lit(0)).join(F.broadcast(twice.withColumn("_", F.lit(0))), "_").select("empty_keys", "repeated_keys", "bad_vectors", "widths")


def validate(docs: DataFrame, committed: DataFrame | None = None, already: int = 0, width: int | None = None) -> None:
    """Raise for what ingest refuses, by one pass of counts and one grouped pass over keys."""
    size = F.when(F.coalesce(F.size("vector"), F.lit(-1)) > 0, F.size("vector"))
    n, empty, infinite, low, high = docs.agg(
        F.count("*"), F.count_if(F.col("key").isNull() | (F.col("key") == "")), F.count_if(F.coalesce(F.exists("vector", _bad_component), F.lit(False))), F.min(size), F.max(size)
    ).first()
    if empty:
        raise EmptyKey(f"{empty} documents have no key")
    if infinite:
        raise NonFiniteVector(f"{infinite} vectors hold components that aren't finite")
    if not docs.groupBy("key").count().where("count > 1").isEmpty():
        raise DuplicateKey("a key occurs twice")
    if committed is not None and not docs.join(committed.select("key"), "key", "left_semi").isEmpty():
        raise DuplicateKey("a key is committed already")
    if already + n > MOST_DOCUMENTS:
        raise TooManyDocuments(f"{already + n} documents")
    if low is not None and (low != high or width not in (None, low)):
        raise WidthMismatch(f"vectors have widths {low} to {high}" + (f", the corpus has {width}" if width else ""))


def pieces(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch (doc, tokens) in parts of about ``TOKENS_A_PIECE`` tokens; a document is never cut."""
    ends = b.column(1).offsets.to_numpy()[1:].astype(np.int64)
    i = 0
    while i < b.num_rows:
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else int(b.column(1).offsets[0].as_py())) + TOKENS_A_PIECE, side="right")))
        yield b.slice(i, j - i)
        i = j


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in pieces(batch):
            lists = b.column(1)
            length = np.diff(lists.offsets.to_numpy())
            words = lists.flatten().dictionary_encode()
            n = max(len(words.dictionary), 1)
            key, tf = np.unique(np.repeat(np.arange(b.num_rows), length) * n + words.indices.to_numpy(), return_counts=True)
            row = key // n
            yield pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(key % n)), b.column(0).take(pa.array(row)), pa.array(tf), pa.array(length[row].astype(np.int32))], names=["term", "doc", "tf", "length"])


@dataclass
class Corpus:
    """``docs`` has doc, key, text, vector, links, time; doc is dense in ingest order and breaks ties."""

    docs: DataFrame

    @staticmethod
    def empty(spark: SparkSession) -> Corpus:
        return Corpus(spark.createDataFrame([], DOCUMENT).select(F.lit(0).cast("long").alias("doc"), "*"))

    @staticmethod
    def ingest(docs: DataFrame, order: list[str], base: int = 0, committed: DataFrame | None = None, width: int | None = None) -> Corpus:
        """Validate and number documents (columns of ``DOCUMENT``), in the order of the columns ``order``."""
        validate(docs, committed, base, width)
        time = F.when(F.unix_micros("time") != ZERO_TIME_MICROS, F.col("time"))
        numbered = global_index(docs.withColumn("time", time), [F.col(c) for c in order], "doc", "ingest")
        return Corpus(numbered.select((F.col("doc") + base).alias("doc"), *DOCUMENT.names))

    def tokenized(self) -> DataFrame:
        return self.docs.select("doc", tokens(F.col("text")).alias("tokens"))

    def postings(self) -> DataFrame:
        """(term, doc, tf, length). A document's tokens are counted where it lies: nothing is shuffled, and a task holds a piece of a batch."""
        small_batches(self.docs.sparkSession)
        return self.tokenized().select(F.col("doc").cast("long").alias("doc"), "tokens").mapInArrow(_counted, "term string, doc long, tf long, length int")

    def document_frequency(self) -> DataFrame:
        """(term, df); repeats within a document are dropped before the shuffle."""
        return self.tokenized().select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))

    def stats(self) -> DataFrame:
        """One row: n_docs, total_length, avgdl (0 when empty)."""
        size = F.size("tokens").cast("long")
        row = self.tokenized().agg(F.count("*").alias("n_docs"), F.coalesce(F.sum(size), F.lit(0)).alias("total_length"))
        mean = F.when(F.col("n_docs") > 0, F.col("total_length") / F.when(F.col("n_docs") > 0, F.col("n_docs"))).otherwise(F.lit(0.0))
        return row.withColumn("avgdl", mean.cast("double"))

    def keys(self) -> DataFrame:
        return self.docs.select("key", "doc")

    def resolve(self, keys: DataFrame) -> DataFrame:
        """Add doc to rows with a key; unknown keys are dropped."""
        return keys.join(self.keys(), "key")

    def links(self) -> DataFrame:
        """(src, key) of every link, known or not."""
        return self.docs.select(F.col("doc").alias("src"), F.explode("links").alias("key"))

    def edges(self) -> DataFrame:
        """(src, dst) of the links that resolve, directed, once each."""
        return self.resolve(self.links()).select("src", F.col("doc").alias("dst")).distinct()

    def dangling(self) -> DataFrame:
        return self.links().join(self.keys(), "key", "left_anti").select("src", "key")

    def get(self, doc: int) -> DataFrame:
        """The row of one document, or none."""
        return self.docs.where(F.col("doc") == doc)

    def vector(self, doc: int) -> DataFrame:
        """Its vector alone: the scan reads two columns."""
        return self.docs.select("doc", "vector").where((F.col("doc") == doc) & F.col("vector").isNotNull())

    def materialized(self) -> Corpus:
        return Corpus(write_table(self.docs, "corpus"))
