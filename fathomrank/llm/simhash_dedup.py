"""SimHash near-duplicates found through deletion-variant signatures.

Fingerprint: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, XXH64 (seed 42) of every space-joined
3-word shingle; a bit is set where over half the hashes have it. Two fingerprints that differ in
at most 2 of 64 bits agree, up to one bit, in at least one of two 32-bit segments. So each
segment is indexed under its 32 one-wildcard variants (one bit deleted), equal variants are
joined, and a pair is verified by its Hamming distance. A pair met under several variants is kept
under the first one only, so no pass to remove repeats is needed.

Copies collapse before the join: only distinct fingerprints are indexed and paired. Results are
one row a document with its fingerprint class, number of links and component.

Defined results: null, empty and blank texts have fingerprint 0 and link like any other; repeated
rows count as separate documents; ties choose the smallest doc_id; a class without any doc_id has
a null component unless it is linked to one that has; an empty table gives no rows; other columns
are ignored (``near_deduplicated`` keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomrank.shared import connected_components, join_by_class, release, sieve, write_table

#: For each byte value, its 8 bits spread over 8 byte lanes of one word.
LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
BLOCK = 255  # a lane counts that far
GROUP = 64  # documents whose hashes are held at once


def shingle_hashes(text: str, k: int = 3, seed: int = 42) -> np.ndarray:
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    h = xxhash.xxh64_intdigest
    if len(words) <= k:
        return np.array([h(line, seed)], dtype=np.uint64)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends)]
    return np.array([h(line[s:e], seed) for s, e in zip(starts, ends[k - 1 :])], dtype=np.uint64)


def simhash(hashes: list[np.ndarray]) -> np.ndarray:
    """Majority fingerprints of many documents' hashes at once."""
    n = np.array([len(h) for h in hashes], dtype=np.int64)
    out = np.zeros(len(n), dtype=np.uint64)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    rows = np.concatenate([hashes[i] for i in full]).view(np.uint8).reshape(-1, 8)
    first = np.concatenate([[0], np.cumsum(n[full])[:-1]])
    blocks = -(-n[full] // BLOCK)
    begin = np.concatenate([np.arange(f, f + c, BLOCK) for f, c in zip(first, n[full])])
    lanes = np.add.reduceat(LANES[rows], begin, axis=0).view(np.uint8).reshape(-1, 64)
    at = np.concatenate([[0], np.cumsum(blocks)[:-1]])
    counts = np.add.reduceat(lanes, at, axis=0, dtype=np.int64)
    bits = (counts * 2 > n[full][:, None]).astype(np.uint8)
    out[full] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, k: int = 3, seed: int = 42, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in ``keep`` and fp, the fingerprint as a signed long."""
    wanted = docs.select(*keep, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.num_columns - 1)
            parts = [simhash([shingle_hashes(t.as_py() or "", k, seed) for t in texts.slice(i, GROUP)]) for i in range(0, len(texts), GROUP)]
            fp = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp.view(np.int64))], names=[*b.schema.names[:-1], "fp"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema.fields[:-1])
    return wanted.mapInArrow(run, f"{kept}, fp long")


def near_pairs(prints: DataFrame) -> DataFrame:
    """Pairs a < b of distinct fingerprints (column fp) at 1 or 2 differing bits."""
    variants = []
    for s in range(2):
        part = F.shiftrightunsigned("fp", 32 * s).bitwiseAND(F.lit(0xFFFFFFFF))
        for j in range(32):
            variants.append(F.lit((s * 32 + j) << 32).bitwiseOR(part.bitwiseAND(F.lit(0xFFFFFFFF ^ (1 << j)))))
    index = prints.select("fp", F.explode(F.array(*variants)).alias("variant"))
    # 64 rows a fingerprint: never broadcast, whatever the size before the explosion suggests
    other = index.select(F.col("fp").alias("b"), "variant").hint("merge")
    pairs = index.withColumnRenamed("fp", "a").join(other, "variant").where("a < b")
    differ = F.col("a").bitwiseXOR(F.col("b"))
    low, high = differ.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(differ, 32)
    # the first variant under which the pair meets: low segment first, its differing bit or bit 0
    seg = F.when(F.bit_count(low) <= 1, low).otherwise(high)
    bit = F.when(seg == 0, F.lit(0)).otherwise(F.bit_count(seg - 1))
    first = F.when(F.bit_count(low) <= 1, F.lit(0)).otherwise(F.lit(32)) + bit
    return pairs.where((F.bit_count(differ) <= 2) & (F.shiftright("variant", 32) == first)).select("a", "b")


def classes(prints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row a distinct fingerprint: fp, n, n_near, component_id, root, which names the component; the links a, b between them)."""
    groups = write_table(prints.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")), "simhash-classes")
    links = write_table(near_pairs(groups.select("fp")), "simhash-links")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(groups.select(F.col("fp").alias("b"), "n"), "b").groupBy(F.col("a").alias("fp")).agg(F.sum("n").alias("others"))
    roots = connected_components(links, "simhash-components").withColumnRenamed("node", "fp")
    linked = groups.join(near, "fp", "left").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    out = linked.join(least, "root").select("fp", "n", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_near"), "component_id", "root")
    return write_table(out, "simhash-near"), links


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), n_near, component_id of every document."""
    prints = write_table(fingerprints(docs), "simhash")
    near, _ = classes(prints)
    joined = join_by_class(prints, near, "fp", "n", prints.count())
    return joined.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "n_near", "component_id")


def near_deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each component, the one with the smallest doc_id (then text), with its own columns."""
    # the caller's columns travel in a struct: their names can't clash with these
    packed = docs.select(F.struct("*").alias("row"), "doc_id", "text", F.xxhash64("text").alias("h"))
    prints = write_table(fingerprints(packed, keep=("doc_id", "h")), "simhash")
    near, links = classes(prints)
    joined = join_by_class(prints, near, "fp", "n", prints.count())
    # the keeper of a component: a grouped minimum, combined before the shuffle; ids may repeat, so the text's hash is part of it
    keeper = joined.groupBy("root").agg(F.count("*").alias("rows"), F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "h")).alias("k")).where("rows > 1")
    keeper = write_table(keeper.select("root", F.col("k.doc_id").alias("doc_id"), F.col("k.h").alias("h")), "simhash-keepers")
    # a document alone in its component stays as it is; only the others meet the keepers
    groups = write_table(near.join(keeper.select("root"), "root").select("fp", "n"), "simhash-groups")
    members = join_by_class(prints.where(sieve(groups, "fp")(F.col("fp"))), groups, "fp", "n", prints.count())
    members = write_table(members.select("doc_id", "h").distinct(), "simhash-members")
    release(prints, near, links, groups)
    maybe = sieve(members, "h")(F.col("h"))
    some = packed.where(maybe)
    same = lambda t: some["doc_id"].eqNullSafe(t["doc_id"]) & (some["h"] == t["h"])
    one = Window.partitionBy("doc_id", "h").orderBy("text")
    kept = some.join(keeper, same(keeper), "left_semi").withColumn("i", F.row_number().over(one)).where("i = 1")
    alone = packed.where(~maybe).unionByName(some.join(members, same(members), "left_anti"))
    return alone.select("row").unionByName(kept.select("row")).select("row.*")
