"""Steps that must not shuffle, hold or gather more as tables grow."""

import glob

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from fathomrank.operators import corpus as co
from fathomrank.operators.corpus import Corpus
from fathomrank.operators.scorers import TextScorer, _Best
from fathomrank.operators.terms import TermIndex
from fathomrank.plans import catalogue
from fathomrank.shared import global_index, shared_dir

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_postings_are_counted_where_the_document_lies(spark):
    texts = ["b a b", "", None, "A a c b", "straße ÉTÉ été"]
    c = Corpus(spark.createDataFrame(list(enumerate(texts)), "doc long, text string").repartition(3))
    got = {(r.term, r.doc, r.tf, r.length) for r in c.postings().collect()}
    assert got == {("b", 0, 2, 3), ("a", 0, 1, 3), ("a", 3, 2, 4), ("c", 3, 1, 4), ("b", 3, 1, 4), ("straße", 4, 1, 3), ("été", 4, 2, 3)}
    assert "Exchange" not in plan(Corpus(spark.range(5).select(F.col("id").alias("doc"), F.lit("a b").alias("text"))).postings())


def test_a_piece_of_a_batch_is_bounded(monkeypatch):
    monkeypatch.setattr(co, "TOKENS_A_PIECE", 6)
    lists = pa.array([["x"] * n for n in (99, 3, 3, 0, 1, 20, 2, 6, 0)], pa.list_(pa.string()))
    b = pa.RecordBatch.from_arrays([pa.array(range(9)), lists], names=["doc", "tokens"]).slice(1)
    parts = list(co.pieces(b))
    assert [p.column(0).to_pylist() for p in parts] == [[1, 2, 3], [4], [5], [6], [7, 8]]
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([b]))
    assert sum(r.num_rows for r in co._counted(iter([b]))) == 6


def test_a_task_keeps_the_best_of_all_its_pieces():
    r = np.random.default_rng(0)
    best, every = _Best(["p", "q"], 3), []
    for i in range(0, 120_000, 3):
        scores = r.integers(0, 50, (2, 3)).astype(float)
        every += [(q, -s, i + j) for q, row in zip("pq", scores) for j, s in enumerate(row) if s > 0]
        best.take(np.arange(i, i + 3), iter(zip("pq", scores)))
        assert best.held <= 2 * 3 * 2 + (1 << 16)
    got = list(zip(*best.cut().to_pydict().values()))
    assert got == [(q, d, -s) for q in "pq" for _, s, d in sorted(e for e in every if e[0] == q)[:3]]


def test_a_group_of_stored_postings_is_bounded(spark, monkeypatch, tmp_path):
    c = catalogue.corpus(spark, SF).materialized()
    TermIndex.write(c, f"{tmp_path}/terms")
    total = c.stats().first()
    index = TermIndex.read(spark, [f"{tmp_path}/terms"], total.n_docs, total.total_length)
    q = catalogue.benchmark(spark, SF)
    want = sorted(map(tuple, TextScorer(c).stream(q, 5).collect()))
    monkeypatch.setattr(TextScorer, "POSTINGS_A_GROUP", 500)
    stream = TextScorer(c, index).stream(q, 5)
    assert sorted(map(tuple, stream.collect())) == want
    assert "FLOOR" in plan(stream).upper()


def test_matching_documents_are_scored_without_a_join(spark):
    assert "Join" not in plan(catalogue.bm25_postings_plan(spark, SF))


def test_numbering_sorts_once(spark):
    df = spark.range(5000).select(F.pmod(F.xxhash64("id"), F.lit(1000)).alias("x"), "id").repartition(7)
    out = global_index(df, [F.col("x"), F.col("id")], "i", "t")
    assert "row_number" not in plan(out)
    rows = sorted((r.x, r.id, r.i) for r in out.collect())
    assert [i for *_, i in rows] == list(range(5000))


def test_a_stream_takes_batches_of_many_files(spark):
    before = set(glob.glob(shared_dir(spark).removeprefix("file://") + "/stream-*"))
    assert catalogue.stream_commit(spark, SF).first().documents == 200
    (path,) = set(glob.glob(shared_dir(spark).removeprefix("file://") + "/stream-*")) - before
    assert len(glob.glob(f"{path}/in/*.parquet")) > 3
    assert len(glob.glob(f"{path}/store/gen=*")) == 3
