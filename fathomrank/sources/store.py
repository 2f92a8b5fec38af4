"""The persistent corpus: immutable Parquet generations named by a manifest that is replaced at once.

A generation is a folder with its documents and their postings by term. A reader sees the manifest it
opened; a writer adds a generation, then renames the manifest into place. Of two writers that began at one
manifest the second is refused: the first to create the marker of the next generation owns it. Merging
rewrites the oldest adjacent generations as one; document numbers are data, so they never change. What a merge
replaced is deleted by the next merge, so a corpus opened before still reads. Centroids and vectors by
list lie in the folder of the index. All goes through Hadoop's file system, so any store Spark can write will do.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomrank.functions.columns import has_direction, tokens
from fathomrank.operators.corpus import Corpus
from fathomrank.operators.ivf import InvertedFile
from fathomrank.operators.terms import TermIndex
from fathomrank.schema import DOCUMENT, IVF_GATE, BadVersion, CorruptStore, StaleWriter, Unpinned

VERSION, MOST_GENERATIONS, MANIFEST, ATTEMPTS = 2, 8, "MANIFEST.json", 3
_SCHEMA = "doc long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in DOCUMENT.fields)


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._id = spark, path.rstrip("/"), None
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._path(f"{self.path}/{name}")

    def manifest(self) -> dict:
        """{version, store, generation, width, tokens, segments: [{name, base, count, tokens}], retired, lists}; segments tile the documents without gaps."""
        if not self._fs.exists(self._at(MANIFEST)):
            if self._fs.exists(self._path(self.path)) and len(self._fs.listStatus(self._path(self.path))):
                raise CorruptStore(f"{self.path} isn't empty and has no manifest")
            return {"version": VERSION, "store": uuid.uuid4().hex, "generation": 0, "width": None, "segments": [], "retired": [], "lists": None}
        try:
            m = json.loads(self._text(MANIFEST))
            version, at = m["version"], 0
            for s in m["segments"]:
                if s["base"] != at or s["count"] < 0:
                    raise CorruptStore("segments don't tile the documents")
                at += s["count"]
        except (ValueError, KeyError, TypeError, Py4JJavaError) as e:
            raise e if isinstance(e, CorruptStore) else CorruptStore(f"unreadable manifest: {e}") from e
        if version != VERSION:
            raise BadVersion(f"version {version}")
        if self._id not in (None, m["store"]):
            raise CorruptStore(f"{self.path} now holds another store")
        self._id = m["store"]
        return m

    def _text(self, name: str) -> str:
        """A small file, read on the driver."""
        jvm = self.spark.sparkContext._jvm
        source = self._fs.open(self._at(name))
        try:
            return jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
        finally:
            source.close()

    def _publish(self, m: dict) -> None:
        """Make ``m`` the manifest, unless another writer owns its generation."""
        try:
            self._fs.create(self._at(f"owner-{m['generation']:06d}"), False).close()
        except Exception as e:
            raise StaleWriter(f"generation {m['generation']} has another writer") from e
        name = f".{MANIFEST}.{uuid.uuid4().hex}"
        out = self._fs.create(self._at(name), True)
        out.write(bytearray(json.dumps(m).encode()))
        out.close()
        context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.path).toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        rename = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context.rename(self._at(name), self._at(MANIFEST), options)
        self._id = m["store"]

    def _read(self, segments: list[dict]) -> DataFrame:
        if not segments:
            return Corpus.empty(self.spark).docs
        return self.spark.read.schema(_SCHEMA).parquet(*[f"{self.path}/{s['name']}/docs" for s in segments])

    def open(self) -> Corpus:
        """The committed corpus; its row count must be the manifest's. A merge that removed files meanwhile is met by another attempt."""
        for attempt in range(ATTEMPTS):
            m = self.manifest()
            try:
                docs = self._read(m["segments"])
                n = docs.count()
                break
            except Exception as e:
                if attempt == ATTEMPTS - 1 or not any(x in str(e) for x in ("FILE_NOT_EXIST", "PATH_NOT_FOUND", "does not exist")):
                    raise CorruptStore(f"a generation can't be read: {str(e)[:200]}") from e
        if n != sum(s["count"] for s in m["segments"]):
            raise CorruptStore("row counts differ from the manifest")
        return Corpus(docs)

    def terms(self) -> TermIndex:
        """The stored postings."""
        m = self.manifest()
        return TermIndex.read(self.spark, [f"{self.path}/{s['name']}/terms" for s in m["segments"]], sum(s["count"] for s in m["segments"]), sum(s["tokens"] for s in m["segments"]))

    def _segment(self, docs: DataFrame, generation: int, base: int) -> dict:
        """Write documents and their postings as one generation."""
        name = f"gen={generation:06d}-{uuid.uuid4().hex[:8]}"
        docs.write.parquet(f"{self.path}/{name}/docs")
        written = self.spark.read.schema(_SCHEMA).parquet(f"{self.path}/{name}/docs")
        TermIndex.write(Corpus(written), f"{self.path}/{name}/terms")
        stored = TermIndex.read(self.spark, [f"{self.path}/{name}/terms"], 0, 0).postings
        total = stored.agg(F.coalesce(F.sum("tf"), F.lit(0))).first()[0]  # each token is in one posting
        return {"name": name, "base": base, "count": written.count(), "tokens": total}

    def commit(self, docs: DataFrame, order: list[str]) -> int:
        """Validate, number and append documents; the generation now current. Nothing new, nothing written."""
        m = self.manifest()
        total = sum(s["count"] for s in m["segments"])
        if m["generation"] and docs.isEmpty():
            return m["generation"]
        committed = self._read(m["segments"]) if total else None
        new = Corpus.ingest(docs, order, total, committed, m["width"])
        segment = self._segment(new.docs, m["generation"] + 1, total)
        width = self._read([segment]).agg(F.max(F.when(F.size("vector") > 0, F.size("vector")))).first()[0]
        self._publish({**m, "generation": m["generation"] + 1, "width": m["width"] or width, "segments": [*m["segments"], segment]})
        return m["generation"] + 1

    def merge(self) -> bool:
        """Rewrite the oldest adjacent generations so that at most ``MOST_GENERATIONS`` remain."""
        m = self.manifest()
        extra = len(m["segments"]) - MOST_GENERATIONS
        if extra <= 0:
            return False
        old, rest = m["segments"][: extra + 1], m["segments"][extra + 1 :]
        segment = self._segment(self._read(old), m["generation"] + 1, old[0]["base"])
        if segment["count"] != sum(s["count"] for s in old):
            raise CorruptStore("a merged generation lost rows")
        self._publish({**m, "generation": m["generation"] + 1, "segments": [segment, *rest], "retired": [s["name"] for s in old]})
        self.prune()
        return True

    def prune(self) -> None:
        """Delete generations that the manifest doesn't name, neither as current nor as replaced by the last merge."""
        m = self.manifest()
        named = {s["name"] for s in m["segments"]} | set(m["retired"])
        for status in self._fs.listStatus(self._path(self.path)):
            name = status.getPath().getName()
            if name.startswith("gen=") and name not in named and int(name[4:10]) <= m["generation"]:
                self._fs.delete(status.getPath(), True)

    def build_lists(self, gate: int = IVF_GATE) -> InvertedFile | None:
        """Train and store the inverted lists of the committed vectors; None below the gate."""
        m = self.manifest()
        name = f"lists-{m['generation'] + 1:06d}"
        index = InvertedFile.build(self.open(), gate, f"{self.path}/{name}")
        if index is not None:
            kept = {"name": name, "count": sum(s["count"] for s in m["segments"]), "sizes": sorted(index.sizes.items()), "centroids": index.centroids.tolist()}
            self._publish({**m, "generation": m["generation"] + 1, "lists": kept})
        return index

    def lists(self) -> InvertedFile | None:
        """The stored lists; documents committed after they were built are in none, so ``nearest`` adds them."""
        kept = self.manifest()["lists"]
        return InvertedFile.stored(self.spark, f"{self.path}/{kept['name']}", kept["centroids"], dict(map(tuple, kept["sizes"])), kept["count"]) if kept else None

    def scrub(self) -> DataFrame:
        """``scrub`` of the stored corpus with its stored postings and lists."""
        m = self.manifest()
        return scrub(Corpus(self._read(m["segments"])), self.terms().postings, self.lists(), sum(s["count"] for s in m["segments"]))


class Index:
    """A store and documents that aren't committed yet; both are searched."""

    def __init__(self, store: Store):
        self.store, self._pending, self._open = store, None, None

    def add(self, docs: DataFrame, order: list[str]) -> None:
        """Take documents in; ``corpus`` has them at once, the store after ``commit``."""
        known = self.corpus()
        base = known.docs.count()
        new = Corpus.ingest(docs, order, base, known.docs if base else None, self.store.manifest()["width"]).materialized()
        self._pending = new.docs if self._pending is None else self._pending.unionByName(new.docs)

    def corpus(self) -> Corpus:
        """Committed and pending documents; numbers of the pending ones go on from the committed."""
        self._open = self._open or self.store.open()
        return Corpus(self._open.docs if self._pending is None else self._open.docs.unionByName(self._pending))

    def nearest(self, vector: list[float], k: int) -> DataFrame:
        """doc of the candidates for the k nearest: the probed lists' members and what is in no list, ascending."""
        lists, corpus = self.store.lists(), self.corpus()
        return corpus.docs.where(F.lit(False)).select("doc") if k <= 0 else (lists or InvertedFile.none()).candidates(corpus, vector, k)

    def commit(self) -> int:
        generation = self.store.manifest()["generation"]
        if self._pending is not None:
            generation = self.store.commit(self._pending, ["doc"])
        self._pending = self._open = None
        return generation

    def close(self) -> None:
        """Forget what is open and pending; the next use opens the store anew."""
        self._pending = self._open = None


def pins(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, bytes, sha256) of input files, to be kept beside results that were made from them."""
    return spark.read.format("binaryFile").load(list(paths)).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def check_pins(spark: SparkSession, kept: DataFrame) -> None:
    """Refuse inputs that aren't what they were when they were pinned."""
    paths = [r[0] for r in kept.select("path").collect()]  # the stated inputs
    if not kept.select("path", "bytes", "sha256").exceptAll(pins(spark, *paths)).isEmpty():
        raise Unpinned("an input has changed")


def scrub(corpus: Corpus, postings: DataFrame | None = None, lists: InvertedFile | None = None, named: int | None = None) -> DataFrame:
    """One row of violations of what a corpus promises, all zero when it is sound.

    Stored ``postings`` must have each document's tokens, stored ``lists`` each vector of the documents that they
    were built from in one list, and ``named`` is how many documents the manifest counts.
    """
    docs = corpus.docs
    row = docs.agg(
        F.count("*").alias("documents"),
        (F.count("*") - F.count_distinct("key")).alias("repeated_keys"),
        (F.coalesce(F.max("doc"), F.lit(-1)) + 1 - F.count_distinct("doc")).alias("missing_ids"),
        F.greatest(F.count_distinct(F.when(F.size("vector") > 0, F.size("vector"))) - 1, F.lit(0)).alias("extra_widths"),
    ).withColumn("miscounted", F.abs(F.col("documents") - F.lit(named)) if named is not None else F.lit(0).cast("long"))
    length = docs.select("doc", F.size(tokens(F.col("text"))).cast("long").alias("want"))
    summed = (corpus.postings() if postings is None else postings).groupBy("doc").agg(F.sum("tf").alias("got"))
    lost = length.join(summed, "doc", "full").agg(F.coalesce(F.sum(F.abs(F.coalesce("want", F.lit(0)) - F.coalesce("got", F.lit(0)))), F.lit(0)).alias("lost_postings"))
    if lists is None:
        unlisted = docs.agg(F.lit(0).cast("long").alias("mislisted"))
    else:
        here = docs.where((F.col("doc") < lists.covered) & has_direction(F.col("vector"))).select("doc", F.lit(1).alias("want"))
        unlisted = lists.lists.groupBy("doc").agg(F.count("*").alias("got")).join(here, "doc", "full").agg(F.count_if(~F.col("want").eqNullSafe(F.col("got"))).alias("mislisted"))
    one = lambda d: F.broadcast(d.withColumn("_", F.lit(0)))
    return row.withColumn("_", F.lit(0)).join(one(lost), "_").join(one(unlisted), "_").drop("_")
