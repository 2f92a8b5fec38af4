"""Session helpers: durable scratch tables, global ordering, skew-safe joins, components.

Every intermediate that must be evaluated once is written below the folder that the
session names in ``spark.checkpoint.dir``; it survives the loss of any executor.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

_own: dict[str, str] = {}
#: Bits of the largest filter of ``sieve`` (16 MB); one of Spark's bitmap groups has 32,768.
MOST_BITS, GROUP_BITS = 1 << 27, 1 << 15


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share. A private one is made only for a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if named:
        base = f"{named.rstrip('/')}/fathomrank-{app}"
    elif app in _own:
        base = _own[app]
    elif spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        base = "file://" + tempfile.mkdtemp(prefix="fathomrank-")
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if app not in _own:
        _own[app] = base
        atexit.register(drop_scratch, spark, base)
    return base


def drop_scratch(spark: SparkSession, base: str | None = None) -> None:
    """Delete the scratch tables of this application."""
    base = base or _own.get(spark.sparkContext.applicationId)
    if base is None:
        return
    with contextlib.suppress(Exception):  # the context may be stopped already
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(base)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Rows of whole texts go to Python by the thousand where the session has Spark's default of 10,000, which may be large in bytes."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, "1000")


def write_table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a scratch Parquet table and return a read of it: lineage ends here."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete scratch tables that nothing reads any more, and the shuffle files of finished jobs.

    Spark removes the latter only once the driver has collected its garbage, which it may not do for long.
    """
    jvm, conf = tables[0].sparkSession.sparkContext._jvm, tables[0].sparkSession.sparkContext._jsc.hadoopConfiguration()
    for t in tables:
        path = jvm.org.apache.hadoop.fs.Path(t._scratch)
        path.getFileSystem(conf).delete(path, True)
    jvm.System.gc()


def spread(df: DataFrame) -> DataFrame:
    """Deal rows to all cores where the input has fewer splits than there are cores; otherwise as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def global_index(df: DataFrame, order: list[Column], name: str, label: str) -> DataFrame:
    """Dense positions from 0 in a global order, without a single-task sort.

    Rows are range-partitioned, sorted there and written once with the number of their range and their place in it;
    only the count of each range (one row a partition) is summed in one place.
    """
    at = F.col("_at")  # the partition's number in the upper bits, the place in the lower 33
    ranged = write_table(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.shiftright(at, 33)).withColumn("_inside", at.bitwiseAND(F.lit((1 << 33) - 1))).drop("_at"), label
    )
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("_range")
        .agg(F.count("*").alias("_n"))
        .select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    return (
        ranged.join(F.broadcast(offsets), "_range")
        .withColumn(name, (F.col("_before") + F.col("_inside")).cast("long"))
        .drop("_range", "_inside", "_before")
    )


def join_by_class(rows: DataFrame, classes: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of ``rows`` to one ``classes`` row a key, safe when a key owns a third of all.

    A key is hot if it owns more than a thousandth of ``total`` rows, so there are at most
    1,000 hot keys by arithmetic: they are broadcast. The others meet in a shuffled join.
    """
    hot_from = max(1000, total // 1000)
    if classes.where(F.col(size) > hot_from).isEmpty():  # no need to read the rows twice
        return rows.join(classes, key)
    hot = F.broadcast(classes.where(F.col(size) > hot_from))
    cold = classes.where(F.col(size) <= hot_from)
    rest = rows.join(hot.select(key), key, "left_anti")
    return rows.join(hot, key).unionByName(rest.join(cold, key))


#: Records of a task that go into one set of blocks.
FLUSH = 1 << 18


def parts_of(spark: SparkSession, records: int) -> int:
    """Parts of a quarter of a million records each."""
    return max(spark.sparkContext.defaultParallelism, -(-records // FLUSH))


def deal(df: DataFrame, records, parts: int, width: int) -> DataFrame:
    """Shuffle records as blocks: ``records(batches)`` yields a list of ``width`` numpy columns, the first an 8-byte key.

    All records of a key come to one task, in which ``gathered`` gives the columns back. Spark moves a block for each
    part in place of a row for each record; their sorting is left to numpy.
    """

    def blocks(columns: list[np.ndarray]) -> pa.RecordBatch:
        part = columns[0].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        part = ((part >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(parts + 1))
        used = np.flatnonzero(np.diff(cuts))
        out = [pa.array(used.astype(np.int32))]
        for c in columns:
            offs = (np.append(cuts[used], len(part)) * c.itemsize).astype(np.int32)
            out.append(pa.Array.from_buffers(pa.binary(), len(used), [None, pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(c[order]))]))
        return pa.RecordBatch.from_arrays(out, names=["part", *[f"c{i}" for i in range(width)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for columns in records(batches):
            held.append(columns)
            n += len(columns[0])
            if n >= FLUSH:
                yield blocks([np.concatenate(c) for c in zip(*held)])
                held, n = [], 0
        if n:
            yield blocks([np.concatenate(c) for c in zip(*held)])

    return df.mapInArrow(run, ", ".join(["part int", *[f"c{i} binary" for i in range(width)]])).repartitionById(parts, F.col("part"))


def gathered(batches: Iterator[pa.RecordBatch], *kinds) -> list[np.ndarray]:
    """The columns of all records that ``deal`` brought to a task, of the given kinds."""
    out: list[list[np.ndarray]] = [[np.zeros(0, kind)] for kind in kinds]
    for b in batches:
        for one, c, kind in zip(out, b.columns[1:], kinds):
            _, offs, data = c.buffers()
            at = np.frombuffer(offs, np.int64 if pa.types.is_large_binary(c.type) else np.int32)[c.offset : c.offset + len(c) + 1] if len(c) else [0, 0]
            if at[-1] > at[0]:
                one.append(np.frombuffer(data, np.uint8)[at[0] : at[-1]].copy().view(kind))
    return [np.concatenate(x) for x in out]


def _probes(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = (h.view(np.uint64) ^ (h.view(np.uint64) >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h >> np.uint64(64 - bits), (h << np.uint64(31)) >> np.uint64(64 - bits)


def sieve(keys: DataFrame, column: str):
    """A test ``f(Column) -> Column`` of longs that is true for every key and for few others.

    A Bloom filter with two probes and 16 bits a key, at most ``MOST_BITS``: what is gathered and sent is
    bounded by that. It only thins what an exact join then gets: beyond the bound it lets more through, and
    the result stays the same.
    """
    n = keys.count()
    bits = min(MOST_BITS.bit_length() - 1, max(GROUP_BITS.bit_length() - 1, (16 * n).bit_length()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.concatenate(_probes(b.column(0).to_numpy(zero_copy_only=False), bits)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at + 1)], names=["at"])  # Spark's groups begin at 1

    at = keys.select(column).mapInArrow(places, "at long")
    groups = at.groupBy(F.bitmap_bucket_number("at").alias("g")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("b")).collect()  # at most MOST_BITS in all
    packed = np.zeros((1 << bits) // 8, np.uint8)
    for g, b in groups:
        packed[(g - 1) * GROUP_BITS // 8 :][: len(b)] = np.frombuffer(b, np.uint8)
    mask = keys.sparkSession.sparkContext.broadcast(packed)

    def passes(h: np.ndarray) -> np.ndarray:
        table, out = mask.value, np.ones(len(h), bool)
        for at in _probes(h, bits):
            out &= (table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return out

    @F.arrow_udf("boolean")
    def maybe(h: pa.Array) -> pa.Array:
        return pa.array(passes(h.to_numpy(zero_copy_only=False)))

    maybe.passes = passes
    return maybe


#: Edges of a graph that one task takes at once: 16 MB, and a few times that while it works.
WHOLE_GRAPH = 1 << 20


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of the graph of all edges u, v; larger roots are hung on smaller ones until no edge leaves its tree."""
    ends = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
    for b in batches:
        for one, c in zip(ends, b.columns):
            one.append(c.to_numpy(zero_copy_only=False))
    u, v = (np.concatenate(x) for x in ends)
    node, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v, root = at[: len(u)], at[len(u) :], np.arange(len(node))
    while len(u):
        np.minimum.at(root, np.maximum(root[u], root[v]), np.minimum(root[u], root[v]))
        while (root[root] != root).any():
            root = root[root]
        open_ = root[u] != root[v]
        u, v = u[open_], v[open_]
    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(node[root])], names=["node", "root"])


def connected_components(edges: DataFrame, label: str) -> DataFrame:
    """Components of an undirected graph as a scratch table (node, root); root is the smallest node.

    ``edges`` has columns a, b of one orderable type. Up to ``WHOLE_GRAPH`` edges of longs go to one task. Others take
    alternating large-star and small-star steps, each a grouped minimum and an equality join, written to the shared
    folder: no neighbour list is ever collected, and the number of rounds is logarithmic in practice. Each round is
    about nine jobs, whose plans, threads and broadcasts the driver holds, however small the graph.
    """
    now = write_table(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), label)
    if now.schema["u"].dataType == LongType() and now.count() <= WHOLE_GRAPH:
        roots = write_table(now.coalesce(1).mapInArrow(_roots, "node long, root long"), label)
        release(now)
        return roots
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        before, now = now, write_table(small.where("u <> v").distinct(), label)
        release(before)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out = write_table(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()), label)
    release(now)
    return out
