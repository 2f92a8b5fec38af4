"""Evaluation datasets: corpora, queries, judgments, query vectors, metadata, cached records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomrank.schema import BadRecord, DuplicateDocument, EmptyDataset, MissingId, NoJoinColumn


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines are skipped and a malformed one is refused."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    rows = lines.select("value", F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    if rows.isEmpty():
        raise EmptyDataset(path)
    if not rows.where("r is null or r._bad is not null").isEmpty():
        raise BadRecord(path)
    return rows.select("r.*").drop("_bad")


def _unique(rows: DataFrame, key: str) -> DataFrame:
    if not rows.where(F.col(key).isNull() | (F.col(key) == "")).isEmpty():
        raise MissingId(f"a record has no {key}")
    if not rows.groupBy(key).count().where("count > 1").isEmpty():
        raise DuplicateDocument(f"{key} occurs twice")
    return rows


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(key, text) of a corpus in JSON lines ``_id, title, text``; the text is title, space, text."""
    rows = _unique(_json(spark, path, "_id string, title string, text string"), "_id")
    return rows.select(F.col("_id").alias("key"), F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))).alias("text"))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(qid, text)."""
    return _unique(_json(spark, path, "_id string, text string"), "_id").select(F.col("_id").alias("qid"), "text")


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(qid, key, grade) of a tab-separated file whose header names query-id, corpus-id and score in any order."""
    rows = spark.read.csv(path, sep="\t", header=True)
    names = {"query-id", "corpus-id", "score"}
    if not names <= set(rows.columns):
        raise NoJoinColumn(f"{path} lacks {sorted(names - set(rows.columns))}")
    grade = F.expr("try_cast(score as int)")
    rows = rows.select(F.col("query-id").alias("qid"), F.col("corpus-id").alias("key"), grade.alias("grade"))
    if not rows.where("qid is null or key is null or grade is null").isEmpty():
        raise BadRecord(path)
    if rows.isEmpty():
        raise EmptyDataset(path)
    if not rows.groupBy("qid", "key").agg(F.count_distinct("grade").alias("n")).where("n > 1").isEmpty():
        raise BadRecord("conflicting grades")
    return rows.dropDuplicates(["qid", "key"])


def read_query_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(qid, text, vector, model); empty texts, empty or zero vectors and values out of range are refused."""
    rows = _unique(_json(spark, path, "id string, text string, vec array<double>, model string"), "id")
    most = 3.4028234663852886e38
    wrong = F.col("text").isNull() | (F.col("text") == "") | F.col("vec").isNull() | (F.size("vec") == 0) | ~F.exists("vec", lambda x: x != 0)
    wrong = wrong | F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > most))
    if not rows.where(wrong).isEmpty():
        raise BadRecord(path)
    return rows.select(F.col("id").alias("qid"), "text", F.col("vec").cast("array<float>").alias("vector"), "model")


#: Columns that name a paper elsewhere, best first, with the prefix that the other side expects.
JOIN_COLUMNS = (("s2_id", "CorpusId:"), ("doi", "DOI:"), ("pmcid", "PMCID:"), ("pubmed_id", "PMID:"))


def read_metadata_ids(spark: SparkSession, path: str, want: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((key, ref) of the wanted keys, (source, n) tally) from a metadata CSV.

    A row's reference is the first usable column, of several values the first; of several rows of a key,
    the first usable in file order.
    """
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    have = [(c, p) for c, p in JOIN_COLUMNS if c in rows.columns]
    if "cord_uid" not in rows.columns or not have:
        raise NoJoinColumn(path)
    value = {c: F.trim(F.substring_index(c, ";", 1)) for c, _ in have}
    usable = [(F.when(value[c].isNotNull() & (value[c] != ""), F.struct(F.lit(c).alias("source"), F.concat(F.lit(p), value[c]).alias("ref")))) for c, p in have]
    rows = rows.withColumn("line", F.monotonically_increasing_id()).select(F.col("cord_uid").alias("key"), "line", F.coalesce(*usable).alias("u"))
    rows = rows.where("u is not null").join(want.select("key").distinct(), "key", "left_semi")
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("line"))).where("n = 1")
    return first.select("key", "u.ref"), first.groupBy(F.col("u.source").alias("source")).agg(F.count("*").alias("n"))


def read_cached_records(spark: SparkSession, path: str) -> DataFrame:
    """(key, corpus_id, refs, vec, model) of a cache that may end in one cut-off record; other damage is refused."""
    schema = "key string, corpus_id string, refs array<string>, vec array<float>, model string, _bad string"
    lines = spark.read.text(path, wholetext=False).withColumn("line", F.monotonically_increasing_id()).where(F.trim("value") != "")
    rows = lines.select("line", F.from_json("value", schema, {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    last = rows.agg(F.max("line")).first()[0]
    bad = F.col("r").isNull() | F.col("r._bad").isNotNull()
    if not rows.where(bad & (F.col("line") != F.lit(last))).isEmpty():
        raise BadRecord(f"{path} is damaged before its end")
    return _unique(rows.where(~bad).select("r.*").drop("_bad"), "key")


def remaining(want: DataFrame, cached: DataFrame) -> DataFrame:
    """The keys that a resumed join still has to fetch."""
    return want.select("key").join(cached.select("key"), "key", "left_anti")


def least_key(records: DataFrame) -> DataFrame:
    """(corpus_id, key): of several keys of one id, the least."""
    return records.where("corpus_id is not null").groupBy("corpus_id").agg(F.min("key").alias("key"))


def dominant_width(records: DataFrame, vector: str = "vec") -> DataFrame:
    """One row: the commonest vector width, ties to the smaller, and how many have it."""
    sized = records.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).groupBy(F.size(vector).alias("width")).agg(F.count("*").alias("n"))
    return sized.orderBy(F.desc("n"), "width").limit(1)


def join_records(corpus: DataFrame, records: DataFrame, width: int) -> DataFrame:
    """Documents (key, text, vector, links): vectors of ``width`` and citations inside the corpus, each once, none to itself."""
    ids = least_key(records)
    cited = records.select("key", F.explode("refs").alias("corpus_id")).join(ids.withColumnRenamed("key", "dst"), "corpus_id").where("key <> dst").select("key", "dst").distinct()
    links = cited.groupBy("key").agg(F.array_sort(F.collect_set("dst")).alias("links"))
    vectors = records.select("key", F.when(F.size("vec") == width, F.col("vec")).alias("vector"))
    return corpus.join(vectors, "key", "left").join(links, "key", "left")


def tally(records: DataFrame, column: str) -> DataFrame:
    """(value, n): how many records each value of a column has, as of the model that made a vector."""
    return records.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
