"""Best-fit packing by exact-complement hashing.

Documents become token ids; one longer than a sequence is cut into full pieces after a first
piece that holds the remainder. Packing needs only how many pieces have each length, at most
``capacity`` numbers, so the plan is made from that histogram: for the longest length left, single,
pair and triple sums of available lengths that fill its gap exactly are looked up and consumed
under their counts; what remains is placed best-fit. The plan says which ranks of a length go to
which sequences, and pieces meet it by the rank that a distributed count gives them.

Defined results: a null or empty text is the end id alone; repeated rows are packed as separate
documents; a null doc_id stays null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
import contextlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomrank.shared import write_table

CAPACITY, END_ID = 1024, 2
PIECES_A_BUCKET = 20_000
#: Texts beyond this go to the slower encoder, whose time a long run without spaces doesn't square.
_encoders: dict[str, tuple] = {}


def encoders(path: str):
    """(exact encoder of the vocabulary file, fast encoder of the same vocabulary), kept per worker."""
    if path not in _encoders:
        import json

        import tiktoken
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(path)
        model = json.load(open(path, encoding="utf-8"))
        own = {x["content"]: x["id"] for x in model.get("added_tokens", [])}
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        to_byte = {chr(b): b for b in printable}
        to_byte.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))})
        ranks = {bytes(to_byte[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in own}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        fast = tiktoken.Encoding("same", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        _encoders[path] = slow, fast, tuple(own)
    return _encoders[path]


def encode(text: str, path: str) -> np.ndarray:
    """The ids of the vocabulary file; both encoders give the same."""
    slow, fast, own = encoders(path)
    if not any(x in text for x in own):
        with contextlib.suppress(ValueError):  # its pattern search gives up on very long runs of one kind
            return fast.encode_to_numpy(text)
    return np.array(slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: the remainder first, then full pieces."""
    head = n % capacity
    full = [(i, capacity) for i in range(head, n, capacity)]
    return [(0, head), *full] if head else full


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for d, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.append(encode(text.as_py() or "", path), end_id).astype("<u4")
                for k, (s, n) in enumerate(cut(len(ids), capacity)):
                    for c, v in zip(out, (d, k, s, n, zlib.crc32(ids[s : s + n].tobytes()))):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECE)


def exact_combination(left: np.ndarray, gap: int) -> tuple[int, ...] | None:
    """Available lengths, at most three, that sum to ``gap`` exactly under their counts."""
    if gap <= 0:
        return None
    if gap < len(left) and left[gap]:
        return (gap,)
    have = np.flatnonzero(left)
    have = have[have < gap]

    def pair(g: int, upto: int, used: int = 0) -> tuple[int, int] | None:
        a = have[(have <= upto) & (2 * have >= g) & (have < g)]
        b = g - a
        need = 1 + (a == b) + (a == used)
        ok = (left[a] >= need) & (left[b] >= 1 + (a == b) + (b == used))
        return (int(a[ok][-1]), int(g - a[ok][-1])) if ok.any() else None

    if two := pair(gap, gap):
        return two
    for a in have[::-1]:
        if 3 * a < gap:
            break
        if two := pair(gap - int(a), int(a), int(a)):
            return (int(a), *two)
    return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Where the ranks of each length go: (length, first rank, end rank, first sequence, offset, a sequence takes).

    Piece of rank r in [first rank, end rank) lies in sequence first + (r - first rank) // m at
    offset + length * ((r - first rank) % m). The rows number at most a few for each length.
    """
    left = np.zeros(capacity + 1, dtype=np.int64)
    for n, c in counts.items():
        left[n] += c
    bins: list[tuple[tuple[int, ...], int]] = []  # (lengths, how many such sequences)
    for n in range(capacity, 0, -1):
        while left[n]:
            if n == capacity:
                combination: tuple[int, ...] | None = ()
            else:
                left[n] -= 1
                combination = exact_combination(left, capacity - n)
                left[n] += 1
            if combination is None:
                break
            want = defaultdict(int)
            for x in (n, *combination):
                want[x] += 1
            many = min(int(left[x]) // c for x, c in want.items())
            for x, c in want.items():
                left[x] -= many * c
            bins.append(((n, *combination), many))
    open_: dict[int, list[list]] = defaultdict(list)  # gap -> [lengths, how many]
    for n in range(capacity, 0, -1):
        while left[n]:
            gap = min((g for g, b in open_.items() if g >= n and b), default=None)
            if gap is None:
                fits = min(capacity // n, int(left[n]))
                many = int(left[n]) // fits
                open_[capacity - fits * n].append([(n,) * fits, many])
                left[n] -= many * fits
                continue
            lengths, many = open_[gap].pop()
            fits = min(gap // n, int(left[n]))
            now = min(many, int(left[n]) // fits)
            if now < many:
                open_[gap].append([lengths, many - now])
            open_[gap - fits * n].append([(*lengths, *(n,) * fits), now])
            left[n] -= now * fits
    bins += [(lengths, many) for b in open_.values() for lengths, many in b]
    rank: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for lengths, many in bins:
        offset = 0
        for n in dict.fromkeys(lengths):
            m = lengths.count(n)
            rows.append((n, rank[n], rank[n] + m * many, sequence, offset, m))
            rank[n] += m * many
            offset += n * m
        sequence += many
    return rows


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to ``pieces`` (columns of ``PIECE``)."""
    spark = pieces.sparkSession
    cut_up = write_table(pieces, "pack-pieces")
    n = cut_up.count()
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(max(1, n // PIECES_A_BUCKET))).alias("_bucket")
    cut_up = cut_up.select("*", bucket)
    counts = write_table(cut_up.groupBy("length", "_bucket").agg(F.count("*").alias("_n")), "pack-counts")
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("_n")).collect()}  # at most `capacity` rows
    where = spark.createDataFrame(plan(histogram, capacity), "length long, _lo long, _hi long, _seq long, _off long, _m long")
    earlier = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut_up.withColumn("_in", F.row_number().over(inside)).join(offsets, ["length", "_bucket"]).withColumn("_rank", F.col("_before") + F.col("_in") - 1)
    placed = ranked.join(F.broadcast(where), (ranked.length == where.length) & (F.col("_rank") >= where._lo) & (F.col("_rank") < where._hi))
    at = F.col("_rank") - F.col("_lo")
    sequence = F.col("_seq") + F.expr("(_rank - _lo) div _m")
    offset = F.col("_off") + ranked.length * (at % F.col("_m"))
    return placed.select("doc_id", "piece", "start", ranked.length, "ids_crc32", sequence.cast("long").alias("sequence_id"), offset.cast("long").alias("offset"))


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    return pack(pieces(docs, path, capacity, end_id), capacity)
