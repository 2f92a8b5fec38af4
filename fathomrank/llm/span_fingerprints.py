"""Document fingerprints from prefix polynomial hashes.

A document's prefix arrays hold, modulo two primes near 2**31, the sum of ``(code + 1) * B**i``
over its code points. They answer whether any two spans are equal in constant time, locate the
longest common extension of two places by binary search, and give the hash of a concatenation
without visiting it. The fingerprint is the length and both whole-text hashes. The likeness of
two fingerprints is the share of the longer text that their longest common prefix and suffix cover.

Defined results: a null text is empty; two empty texts have likeness 1; equal rows follow each
other; a single document is its own next; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomrank.shared import write_table

PRIMES = (2147483647, 2147483629)
BASES = (911382323, 972663749)
_powers: list[np.ndarray] = [np.ones(1, np.int64), np.ones(1, np.int64)]


def powers(n: int) -> list[np.ndarray]:
    """B**i modulo each prime for i <= n, grown by doubling and kept per worker."""
    while len(_powers[0]) <= n:
        for k, (p, b) in enumerate(zip(PRIMES, BASES)):
            old = _powers[k]
            _powers[k] = np.concatenate([old, old * pow(b, len(old), p) % p])
    return _powers


class PrefixHash:
    """Prefix arrays of one text."""

    def __init__(self, text: str):
        self.text = text
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64) + 1
        self.n = n = len(codes)
        pw = powers(n)
        self.at = []
        for k, p in enumerate(PRIMES):
            a = np.zeros(n + 1, np.int64)
            np.cumsum(codes * pw[k][:n] % p, out=a[1:])
            self.at.append(a % p)

    def fingerprint(self) -> str:
        return show(self.n, [int(a[-1]) for a in self.at])


def show(n: int, hashes: list[int]) -> str:
    return f"{hashes[0]:08x}{hashes[1]:08x}{n:08x}"


def equal(a: PrefixHash, i: int, b: PrefixHash, j: int, n: int) -> bool:
    """Whether a[i:i+n] and b[j:j+n] are equal."""
    for k, p in enumerate(PRIMES):
        x = int(a.at[k][i + n]) - int(a.at[k][i])
        y = int(b.at[k][j + n]) - int(b.at[k][j])
        if (x * int(_powers[k][j]) - y * int(_powers[k][i])) % p:
            return False
    return True


def extension(a: PrefixHash, i: int, b: PrefixHash, j: int, most: int) -> int:
    """Length of the longest common extension to the right of a[i:] and b[j:], ``most`` at most."""
    if most <= 0 or a.text[i] != b.text[j]:
        return 0
    lo, hi = 1, most
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if equal(a, i, b, j, mid) else (lo, mid - 1)
    return lo


def extension_left(a: PrefixHash, i: int, b: PrefixHash, j: int, most: int) -> int:
    """The same to the left of a[:i] and b[:j]."""
    if most <= 0 or a.text[i - 1] != b.text[j - 1]:
        return 0
    lo, hi = 1, most
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if equal(a, i - mid, b, j - mid, mid) else (lo, mid - 1)
    return lo


def compare(a: PrefixHash, b: PrefixHash) -> tuple[int, str, str, str, float, float]:
    """n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of a, followed by b."""
    half = a.n // 2
    kept, m = a.n - half, min(half, b.n)
    powers(max(a.n, b.n))
    edited_n = kept + m
    joined = [(int(a.at[k][kept]) + int(_powers[k][kept]) * int(b.at[k][m])) % p for k, p in enumerate(PRIMES)]
    sha = hashlib.sha256((a.text[:kept] + b.text[:m]).encode("utf-8", "surrogatepass")).hexdigest()
    # the edited text is a[:kept] + b[:m]: its prefix arrays are a's and b's
    head = kept + extension(a, kept, b, 0, min(half, m))
    tail = extension_left(a, a.n, b, m, min(half, m, a.n - head, edited_n - head))
    near_edited = 1.0 if not max(a.n, edited_n) else (head + tail) / max(a.n, edited_n)
    head = extension(a, 0, b, 0, min(a.n, b.n))
    tail = extension_left(a, a.n, b, b.n, min(a.n, b.n) - head)
    near_next = 1.0 if not max(a.n, b.n) else (head + tail) / max(a.n, b.n)
    return a.n, sha, a.fingerprint(), show(edited_n, joined), near_edited, near_next


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_types = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
_edges = _types.append(pa.field("part", pa.int32())).append(pa.field("edge", pa.string())).append(pa.field("text", pa.string()))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(schema), schema.types)], schema=schema)


def _along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of neighbours of a sorted partition; its first and last text are given out to be paired later."""
    part = TaskContext.get().partitionId()
    last = None
    for b in batches:
        rows = []
        for d, text in zip(b.column(0).to_pylist(), b.column(1)):
            now = PrefixHash(text.as_py() or "")
            if last is None:
                rows.append((d, *[None] * 6, part, "first", now.text))
            else:
                rows.append((last[0], *compare(last[1], now), part, None, None))
            last = d, now
        yield _batch(rows, _edges)
    if last is not None:
        yield _batch([(last[0], *[None] * 6, part, "last", last[1].text)], _edges)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(d, *compare(PrefixHash(x), PrefixHash(y))) for d, x, y in zip(*(b.column(i).to_pylist() for i in range(3)))]
        yield _batch(rows, _types)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document and of its edited text; see the module for the columns.

    One range-partitioned sort brings every document next to its follower. Each partition pairs
    its own rows; the row at its end is paired with the next partition's first by a join on
    partition numbers, of which alone the driver keeps a list.
    """
    spark = docs.sparkSession
    order = [F.col("doc_id").desc_nulls_last(), F.col("h")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text").select("doc_id", "text")
    done = write_table(ranged.mapInArrow(_along, RESULT + ", part int, edge string, text string"), "fingerprints")
    names = [x.split()[0] for x in RESULT.split(", ")]
    parts = sorted(r[0] for r in done.where("edge = 'first'").select("part").collect())  # one int a partition
    follow = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, following int")
    first = done.where("edge = 'first'").select(F.col("part").alias("following"), F.col("text").alias("next_text"))
    ends = done.where("edge = 'last'").select("doc_id", "text", "part").join(F.broadcast(follow), "part").join(first, "following")
    return done.where("edge is null").select(*names).unionByName(ends.select("doc_id", "text", "next_text").mapInArrow(_pairs, RESULT))
