"""Signals, fusion and search on small corpora with known answers."""

import inspect
import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fathomrank.functions.columns import tokens
from fathomrank.operators import fusion
from fathomrank.operators.corpus import Corpus
from fathomrank.operators.fusion import fuse, fuse_weighted, rrf, scaled
from fathomrank.operators.ivf import InvertedFile, IvfVectorScorer
from fathomrank.operators.scorers import GraphScorer, RecencyScorer, TableScorer, TextScorer, VectorScorer
from fathomrank.operators.search import explain, parse_query, search
from fathomrank.operators.topk import top_k
from fathomrank.schema import QUERY, DuplicateKey, EmptyKey, NilScorer, NoFuser, NonFiniteVector, WidthMismatch

DOC = "key string, text string, vector array<float>, links array<string>, time timestamp, n int"
NOW = datetime(2026, 8, 11)


def make(spark, rows):
    full = [(k, *([*r] + [None] * (4 - len(r))), i) for i, (k, *r) in enumerate(rows)]
    return Corpus.ingest(spark.createDataFrame(full, DOC), ["n"])


def asked(spark, *queries):
    return spark.createDataFrame([(str(i), *([*q] + [None] * (3 - len(q)))) for i, q in enumerate(queries)], QUERY)


def got(stream):
    return {(r.qid, r.doc): r.score for r in stream.collect()}


GOLD = ["alpha beta gamma", "alpha alpha alpha beta", "beta gamma delta epsilon zeta", "alpha", "beta delta", "gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi beta", "epsilon zeta eta", "omicron pi rho"]
GOLD_SCORES = {
    "lambda": {5: 0.9725951255316294},
    "beta": {0: 0.5598364906582827, 1: 0.5046197408947259, 2: 0.45931722051514967, 4: 0.6286218615241468, 5: 0.26732395562637884},
    "alpha beta": {0: 1.633479778519919, 1: 2.007720343901017, 2: 0.45931722051514967, 3: 1.3744305124765697, 4: 0.6286218615241468, 5: 0.26732395562637884},
    "alpha alpha beta": {0: 2.7071230663815555, 1: 3.5108209469073084, 2: 0.45931722051514967, 3: 2.7488610249531393, 4: 0.6286218615241468, 5: 0.26732395562637884},
    "alpha sigma": {0: 1.0736432878616364, 1: 1.5031006030062912, 3: 1.3744305124765697},
    "gamma delta epsilon zeta eta": {0: 1.0736432878616364, 2: 3.5234777227578897, 4: 1.2055585041176737, 5: 2.745985232262302, 6: 3.6034241386497534},
    "Alpha, BETA!  gamma?": {0: 2.7071230663815555, 1: 2.007720343901017, 2: 1.340186651204622, 3: 1.3744305124765697, 4: 0.6286218615241468, 5: 0.7799925212381038},
}


def test_tokens(spark):
    cases = {"": [], "Go BM25": ["go", "bm25"], "fusion,scorer;graph": ["fusion", "scorer", "graph"], "  a   --  b  ": ["a", "b"], "--- ,,, ...": [], "top 10 results": ["top", "10", "results"], None: []}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string").select("i", tokens(F.col("t")).alias("x"))
    assert {r.i: r.x for r in df.collect()} == dict(enumerate(cases.values()))


def test_bm25_golden(spark):
    c = make(spark, [(f"d{i}", t) for i, t in enumerate(GOLD)])
    scores = got(TextScorer(c).stream(asked(spark, *[(q,) for q in GOLD_SCORES]), 100))
    want = {(str(i), d): s for i, v in enumerate(GOLD_SCORES.values()) for d, s in v.items()}
    assert scores.keys() == want.keys()
    assert all(abs(scores[k] - want[k]) < 1e-12 for k in want)


def test_bm25_ties_and_layouts(spark):
    c = make(spark, [(f"k{i}", "same words here" if i % 2 else "other text") for i in range(40)])
    first = TextScorer(c).stream(asked(spark, ("words same",)), 5).collect()
    assert [r.doc for r in first] == [1, 3, 5, 7, 9]
    again = TextScorer(Corpus(c.docs.repartition(7))).stream(asked(spark, ("words same",)), 5).collect()
    assert first == again
    assert TextScorer(c).stream(asked(spark, ("words",)), 0).count() == 0
    assert TextScorer(c).stream(asked(spark, ("absent",), ("",), (None,)), 5).count() == 0
    assert TextScorer(Corpus.empty(spark)).stream(asked(spark, ("words",)), 5).count() == 0


def test_cosine(spark):
    c = make(spark, [("a", "", [1.0, 0.0]), ("b", "", [0.0, 1.0]), ("c", "", [-1.0, 0.0]), ("d", "", [5.0, 0.0]), ("e", "", [0.0, 0.0]), ("f", "")])
    rows = VectorScorer(c).stream(asked(spark, (None, [1.0, 0.0]), (None, [0.0, 0.0]), (None,)), 10).orderBy("rank").collect()
    assert [(r.qid, r.doc, r.score) for r in rows] == [("0", 0, 1.0), ("0", 3, 1.0), ("0", 1, 0.0), ("0", 2, -1.0)]
    with pytest.raises(NonFiniteVector):
        VectorScorer(c).stream(asked(spark, (None, [math.nan, 0.0])), 3)
    with pytest.raises(Exception, match="WidthMismatch"):
        VectorScorer(c).stream(asked(spark, (None, [1.0])), 3).collect()


@pytest.fixture(scope="module")
def chain(spark):
    return make(spark, [("a", "start", None, ["b", "nowhere", "a"]), ("b", "", None, ["c", "c"]), ("c", "", None, ["d", "a"]), ("d", "", None, ["e"]), ("e", "")])


def test_graph(spark, chain):
    seeds = asked(spark, (None, None, ["a"]), (None, None, ["a", "a", "b"]), (None, None, ["unknown"]), ("start", None, None))
    text = TextScorer(chain)
    scores = got(GraphScorer(chain, text).stream(seeds, 10))
    assert scores == {("0", 1): 1 / 2, ("0", 2): 1 / 3, ("0", 3): 1 / 4, ("1", 2): 1 / 2 + 1 / 3, ("1", 3): 1 / 3 + 1 / 4, ("1", 4): 1 / 4, ("3", 1): 1 / 2, ("3", 2): 1 / 3, ("3", 3): 1 / 4}
    kept = got(GraphScorer(chain, text, include_seeds=True).stream(seeds, 10))
    assert kept[("0", 0)] == 1.0 and kept[("1", 1)] == 1.0 + 1 / 2 and ("2", 0) not in kept


def test_links(spark, chain):
    assert {tuple(r) for r in chain.edges().collect()} == {(0, 1), (0, 0), (1, 2), (2, 3), (2, 0), (3, 4)}
    assert [tuple(r) for r in chain.dangling().collect()] == [(0, "nowhere")]
    assert chain.get(1).count() == 1 and chain.get(99).count() == 0 and chain.vector(1).count() == 0


def test_recency(spark):
    half = timedelta(days=30)
    c = make(spark, [("now", "", None, None, NOW), ("one", "", None, None, NOW - half), ("two", "", None, None, NOW - 2 * half), ("future", "", None, None, NOW + half), ("never", ""), ("zero", "", None, None, datetime(1, 1, 1))])
    rows = RecencyScorer(c, F.lit(NOW)).stream(asked(spark, ("x",), ("y",)), 10)
    want = {0: 1.0, 1: 0.5, 2: 1 / 3, 3: 1.0}
    assert got(rows) == {(q, d): s for q in "01" for d, s in want.items()}


def stream(spark, *docs, qid="0", score=0.0):
    return spark.createDataFrame([(qid, i + 1, d, score) for i, d in enumerate(docs)], "qid string, rank int, doc long, score double")


def test_fusion_reads_ranks_alone(spark):
    a, b = stream(spark, 1, 2, 3, score=9.0), stream(spark, 3, 1, score=-5.0)
    out = [(r.doc, r.score) for r in fuse([a, b], 10).orderBy("rank").collect()]
    assert [d for d, _ in out] == [1, 3, 2]
    assert dict(out) == {1: 1 / 61 + 1 / 62, 3: 1 / 61 + 1 / 63, 2: 1 / 62}
    flipped = [(r.doc, r.score) for r in fuse([b.withColumn("score", F.lit(math.nan)), a], 10).orderBy("rank").collect()]
    assert flipped == out
    assert rrf(60)([a, b], 10).orderBy("rank").collect() == fuse([a, b], 10).orderBy("rank").collect()
    for bad in (-1.0, math.nan, math.inf):
        with pytest.raises(ValueError):
            rrf(bad)
    source = inspect.getsource(fusion)
    assert not any(word in source for word in ("TextScorer", "VectorScorer", "scorers", '"score"]'))


def test_weights(spark):
    a, b = stream(spark, 1, 2), stream(spark, 3, 4)

    def docs(*w):
        return {r.doc: r.score for r in fuse_weighted(*w)([a, b], 10).collect()}

    for off in (0.0, -1.0, math.nan, math.inf, 5e-324):
        assert docs(1.0, off).keys() == {1, 2}
    assert docs(1.0).keys() == {1, 2, 3, 4} and docs(1.0, 1.0, 1e9) == docs(1.0, 1.0) == docs()
    assert {k: v * 4 for k, v in docs(3.0, 2.0).items()} == pytest.approx({1: 3 / 61, 2: 3 / 62, 3: 2 / 61, 4: 2 / 62})
    assert list(docs(4.0, 2.0)) and [r.doc for r in fuse_weighted(4.0, 2.0)([a, b], 10).orderBy("rank").collect()] == [1, 2, 3, 4]
    assert docs(0.0, 0.0) == {}
    assert scaled([3.0, math.inf, 1.0]) == ([0.75, math.inf, 0.25], 0.25) and scaled([0.5]) == ([0.5], 1.0)


def test_a_document_repeated_in_a_stream_votes_twice(spark):
    assert fuse([stream(spark, 7, 7)], 5).first().score == 1 / 61 + 1 / 62


def test_equal_votes_tie_to_the_smaller_document(spark):
    parts = [stream(spark, 9, 2, 5), stream(spark, 2, 9, 4), stream(spark, 6, 5, 9), stream(spark, 5, 6, 2)]
    rows = fuse(parts, 10).orderBy("rank").collect()
    by = {r.doc: r.score for r in rows}
    assert by[2] == by[9] and [r.doc for r in rows if r.doc in (2, 9)] == [2, 9]


def test_ordering_puts_nan_last(spark):
    rows = spark.createDataFrame([("0", 1, math.nan), ("0", 2, -1.0), ("0", 3, 2.0), ("0", 0, 2.0)], "qid string, doc long, score double")
    assert [r.doc for r in top_k(rows, 10).orderBy("rank").collect()] == [0, 3, 2, 1]


def architecture(spark):
    return make(spark, [
        ("a", "scorer fusion architecture", [1.0, 0.0, 0.0], ["b"], NOW - timedelta(hours=1)), ("b", "fusion operator ranking", [0.9, 0.1, 0.0], ["c"], NOW - timedelta(days=100)),
        ("c", "graph proximity scorer", [0.0, 1.0, 0.0], [], NOW - timedelta(hours=2)), ("d", "entirely unrelated prose", [0.0, 0.0, 1.0], [], NOW - timedelta(days=500)), ("lonely", "zzz", None, [], NOW - timedelta(minutes=10)),
    ])


def test_search_takes_any_signals(spark):
    c = architecture(spark)
    q = asked(spark, ("fusion scorer", [1.0, 0.0, 0.0]))
    text, vector = TextScorer(c), VectorScorer(c)
    graph, recent = GraphScorer(c, text), RecencyScorer(c, F.lit(NOW))
    popularity = TableScorer(c, spark.createDataFrame([("lonely", 5.0), ("ghost", 9.0)], "key string, score double"), "popularity")
    keys = lambda rows: {r.key for r in rows.join(c.keys(), "doc").collect()}
    assert "lonely" not in keys(search(q, 5, fuse, text, vector, graph))
    assert "lonely" in keys(search(q, 5, fuse, text, vector, graph, recent))
    assert "lonely" in keys(search(q, 5, fuse, text, popularity))
    shown = explain(q, 5, fuse_weighted(1, 1, 0.1, 1), text, vector, graph, recent).where("rank = 1").first()
    assert shown.text_rank == 1 and shown.vector_rank == 1
    assert search(q, 0, fuse, text).count() == 0
    with pytest.raises(NoFuser):
        search(q, 0, None, text)
    with pytest.raises(NilScorer):
        search(q, 0, fuse, text, None)
    assert parse_query("rank fusion @ 1, 0.5") == ("rank fusion", [1.0, 0.5]) and parse_query("plain") == ("plain", [])


def test_ingest_refuses(spark):
    for rows, error in (([("", "x")], EmptyKey), ([("a", "x"), ("a", "y")], DuplicateKey), ([("a", "", [math.inf])], NonFiniteVector), ([("a", "", [1.0]), ("b", "", [1.0, 2.0])], WidthMismatch)):
        with pytest.raises(error):
            make(spark, rows)


def test_index_of_lists(spark):
    import random

    r = random.Random(1)
    rows = [(f"k{i}", "", [float(j == i % 8) + 0.1 * r.random() for j in range(8)]) for i in range(400)]
    c = make(spark, rows).materialized()
    assert InvertedFile.build(c) is None
    index = InvertedFile.build(c, gate=100)
    assert sum(index.sizes.values()) == 400 and len(index.centroids) == 20
    q = asked(spark, *[(None, rows[i][2]) for i in range(8)])
    exact, near = (got(s.stream(q, 10)) for s in (VectorScorer(c), IvfVectorScorer(c, index, probes=6)))
    assert len(exact.keys() & near.keys()) / len(exact) > 0.9
    assert got(IvfVectorScorer(c, index, probes=20).stream(q, 10)) == exact
    assert (InvertedFile.build(c, gate=100).centroids == index.centroids).all()
