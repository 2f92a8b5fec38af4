"""Evaluation, load figures, datasets, store and streaming."""

import json

import pytest
from pyspark.sql import functions as F

from fathomrank import loadgen
from fathomrank.operators import evaluation as ev
from fathomrank.operators.fusion import fuse
from fathomrank.operators.scorers import TextScorer
from fathomrank.operators import corpus as corpora
from fathomrank.operators.ivf import IvfVectorScorer
from fathomrank.operators.search import Streams, streams_of
from fathomrank.operators.scorers import GraphScorer
from fathomrank.schema import (
    BadQueryId, BadRecord, BadVersion, CorruptStore, DuplicateDocument, DuplicateKey, DuplicateQuery, DuplicateRanked, EmptyDataset, ForeignDocument, MissingId, NoIterations, NoJoinColumn, NoQueries, NoScorers, OverfetchRange,
    StaleWriter, TooManyDocuments, UnknownQuery, UnmatchedVectors, Unpaired, Unpinned, WidthMismatch,
)
from fathomrank.sources import datasets
from fathomrank.sources.store import Index, Store, check_pins, pins, scrub
from fathomrank.streaming.ingest import commit_stream
from tests.test_ranking import DOC, asked, make

CASES = {  # grades by document, ranking, value
    "perfect": ({1: 2, 2: 1, 3: 0}, [1, 2, 3], 1.0),
    "swapped": ({1: 2, 2: 1}, [2, 1], 0.8597186998521972),
    "unjudged first": ({1: 2, 2: 1}, [9, 1, 2], 0.66967181649423),
    "nothing relevant": ({1: 0}, [1], 0.0),
    "all unjudged": ({1: 1}, [7, 8, 9], 0.0),
    "short": ({1: 1, 2: 1, 3: 1}, [1], 0.46927872602275644),
    "tenth": ({1: 1}, [*range(11, 20), 1], 0.2890648263178879),
    "eleventh": ({1: 1}, [*range(11, 21), 1], 0.0),
    "graded": ({1: 2, 2: 0, 3: 1, 4: 2, 5: 0, 6: 1}, [2, 1, 99, 6, 5, 4], 0.5736266550895543),
    "negative": ({1: 2, 5: -1, 2: 1}, [5, 1, 2], 0.66967181649423),
    "retrieved nothing": ({1: 1}, [], 0.0),
}


def test_ndcg_golden(spark):
    q = spark.createDataFrame([(n,) for n in CASES], "qid string")
    qrels = spark.createDataFrame([(n, d, g) for n, (gs, _, _) in CASES.items() for d, g in gs.items()], "qid string, doc long, grade int")
    ranked = spark.createDataFrame([(n, i + 1, d, 0.0) for n, (_, r, _) in CASES.items() for i, d in enumerate(r)], "qid string, rank int, doc long, score double")
    got = {r.qid: r.ndcg for r in ev.ndcg(q, ranked, qrels, 10).collect()}
    assert got == pytest.approx({n: v for n, (_, _, v) in CASES.items()}, abs=1e-12)
    shared = ev.ndcg(q.limit(1), ranked, spark.createDataFrame([(1, 2), (2, 1)], "doc long, grade int"), 10)
    assert shared.count() == 1


def test_bootstrap(spark):
    d = spark.createDataFrame([(f"q{i}", i / 10 - 0.3) for i in range(12)], "qid string, delta double")
    row = ev.bootstrap(d, 400).first()
    assert row == ev.bootstrap(d.repartition(5), 400).first()
    assert row.lo < row.mean_delta < row.hi and row.mean_delta == pytest.approx(0.25) and row.queries == 12
    with pytest.raises(NoIterations):
        ev.bootstrap(d, 0)
    runs = spark.createDataFrame([("a", "1", 0.5), ("b", "2", 0.5)], "arm string, qid string, ndcg double")
    with pytest.raises(Unpaired):
        ev.paired(runs, "a", "b")


def test_arms_and_guards(spark):
    c = make(spark, [("a", "x y"), ("b", "y z"), ("c", "z")])
    q = asked(spark, ("y",), ("z",))
    qrels = spark.createDataFrame([(0, 1), (2, 1)], "doc long, grade int")
    arm = ev.Arm("text", (TextScorer(c),), fuse, overfetch=3)
    assert {r.mean_ndcg for r in ev.summary(ev.evaluate([arm], q, qrels, 2)).collect()}.pop() > 0
    with pytest.raises(NoScorers):
        ev.evaluate([ev.Arm("none", (), fuse)], q, qrels, 2)
    with pytest.raises(OverfetchRange):
        ev.evaluate([ev.Arm("x", arm.scorers, fuse, 0)], q, qrels, 2)
    with pytest.raises(ValueError):
        ev.evaluate([arm], q, qrels, 0)


def test_ties_recall_and_signs(spark):
    rows = [("0", d, s) for d, s in enumerate((5.0, 4.0, 3.0, 3.0, 3.0, 1.0))]
    t = ev.tie_diagnostics(spark.createDataFrame(rows, "qid string, doc long, score double"), 3).first()
    assert (t.n, t.distinct_scores, t.tied, t.slots, t.excluded) == (6, 4, 3, 1, 2)
    s = lambda *docs: spark.createDataFrame([("0", d) for d in docs], "qid string, doc long")
    assert ev.recall(s(1, 2, 3, 4), s(1, 2, 9)).first().recall == 0.5
    grid = spark.createDataFrame([(1.0, 1, 0), (1.0, 2, 1), (2.0, 1, -1), (2.0, 2, 1)], "constant double, overfetch int, delta_sign int")
    assert ev.sign_flips(grid) == 1


def test_load_figures(spark):
    samples = spark.createDataFrame([(float(i),) for i in range(1, 2001)], "value double")
    row = loadgen.quantiles(samples, "value").first()
    assert (row.p50, row.p95, row.p99) == (1000.0, 1900.0, None)
    assert loadgen.quantile_allowed(10000, 0.99) and not loadgen.quantile_allowed(9000, 0.99)
    rungs = [(1.0, 10.0), (2.0, 12.0), (4.0, 25.0), (8.0, 90.0)]
    assert loadgen.saturation(rungs, 10.0) == 4.0 and loadgen.headline(rungs, 4.0) == 2.0
    run = loadgen.drive(lambda i: None, 500, 20, 4)
    assert len(run.latencies) + run.shed == 20


def write(path, lines):
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))
    return str(path)


def test_datasets(spark, tmp_path):
    c = datasets.read_corpus(spark, write(tmp_path / "c.jsonl", [{"_id": "a", "title": "T", "text": "x"}, "", {"_id": "b", "title": None, "text": "y"}]))
    assert {tuple(r) for r in c.collect()} == {("a", "T x"), ("b", " y")}
    with pytest.raises(BadRecord):
        datasets.read_corpus(spark, write(tmp_path / "bad.jsonl", [{"_id": "a"}, "{oops"])).collect()
    with pytest.raises(DuplicateDocument):
        datasets.read_queries(spark, write(tmp_path / "dup.jsonl", [{"_id": "a", "text": "1"}, {"_id": "a", "text": "2"}]))
    with pytest.raises(EmptyDataset):
        datasets.read_queries(spark, write(tmp_path / "none.jsonl", [""]))
    q = datasets.read_qrels(spark, write(tmp_path / "q.tsv", ["score\tcorpus-id\tquery-id", "1\td\tq", "1\td\tq", "-1\te\tq"]))
    assert {tuple(r) for r in q.collect()} == {("q", "d", 1), ("q", "e", -1)}
    with pytest.raises(BadRecord):
        datasets.read_qrels(spark, write(tmp_path / "q2.tsv", ["query-id\tcorpus-id\tscore", "q\td\t1", "q\td\t2"]))
    with pytest.raises(NoJoinColumn):
        datasets.read_qrels(spark, write(tmp_path / "q3.tsv", ["a\tb\tc", "q\td\t1"]))
    v = datasets.read_query_vectors(spark, write(tmp_path / "v.jsonl", [{"id": "q", "text": "t", "vec": [1.0, 2.0], "model": "m"}]))
    assert v.first().vector == [1.0, 2.0]
    with pytest.raises(BadRecord):
        datasets.read_query_vectors(spark, write(tmp_path / "v2.jsonl", [{"id": "q", "text": "t", "vec": [0.0, 0.0]}]))
    want = spark.createDataFrame([("u1",), ("u2",), ("u3",)], "key string")
    ids, tally = datasets.read_metadata_ids(spark, write(tmp_path / "m.csv", ["cord_uid,s2_id,doi,pmcid,pubmed_id", "u1,,10.1/x; 10.2/y,,", "u1,5,,,", "u2,,,,", "u2,,,PMC1,", "u9,1,,,"]), want)
    assert {tuple(r) for r in ids.collect()} == {("u1", "DOI:10.1/x"), ("u2", "PMCID:PMC1")} and {tuple(r) for r in tally.collect()} == {("doi", 1), ("pmcid", 1)}
    record = {"key": "k1", "corpus_id": "1", "refs": ["2", "1", "2", "77"], "vec": [1.0, 0.0], "model": "m"}
    other = {"key": "k2", "corpus_id": "2", "refs": [], "vec": [1.0], "model": "m"}
    cache = datasets.read_cached_records(spark, write(tmp_path / "s.jsonl", [record, other, '{"key": "k3", "corp']))
    assert cache.count() == 2
    with pytest.raises(BadRecord):
        datasets.read_cached_records(spark, write(tmp_path / "s2.jsonl", [record, '{"key":', other]))
    assert [r.key for r in datasets.remaining(spark.createDataFrame([("k1",), ("k3",)], "key string"), cache).collect()] == ["k3"]
    assert datasets.dominant_width(cache).first().width == 1
    rows = {r.key: r for r in datasets.join_records(spark.createDataFrame([("k1", "t"), ("k2", "u"), ("k3", "w")], "key string, text string"), cache, 2).collect()}
    assert rows["k1"].links == ["k2"] and rows["k1"].vector == [1.0, 0.0] and rows["k2"].vector is None and rows["k3"].links is None


def documents(spark, keys, vector=None):
    return spark.createDataFrame([(k, f"text {k} shared", vector, ["k0"], None, i) for i, k in enumerate(keys)], DOC)


def test_store_keeps_rankings(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    for g in range(10):
        assert store.commit(documents(spark, [f"k{g}", f"m{g}"], [1.0, 0.0]), ["n"]) == g + 1
    before = TextScorer(store.open()).stream(asked(spark, ("shared k3",)), 50).collect()
    assert len(store.manifest()["segments"]) == 10 and store.merge() and len(store.manifest()["segments"]) == 8 and not store.merge()
    corpus = store.open()
    assert TextScorer(corpus).stream(asked(spark, ("shared k3",)), 50).collect() == before
    assert sorted(r.doc for r in corpus.docs.collect()) == list(range(20)) and before[0].doc == 6
    assert store.commit(documents(spark, []), ["n"]) == 11
    with pytest.raises(DuplicateKey):
        store.commit(documents(spark, ["k3"]), ["n"])
    with pytest.raises(WidthMismatch):
        store.commit(documents(spark, ["new"], [1.0]), ["n"])
    report = scrub(corpus).first().asDict()
    assert report.pop("documents") == 20 and not any(report.values())
    assert not (tmp_path / "store").joinpath("gen=000001").exists()


def test_store_refuses_damage(spark, tmp_path):
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "file").write_text("x")
    with pytest.raises(CorruptStore):
        Store(spark, str(tmp_path / "other")).open()
    for text, error in (("{", CorruptStore), ('{"version": 9, "segments": []}', BadVersion), ('{"version": 1, "segments": [{"name": "g", "base": 3, "count": 1}]}', CorruptStore)):
        d = tmp_path / f"d{len(text)}"
        d.mkdir()
        (d / "MANIFEST.json").write_text(text)
        with pytest.raises(error):
            Store(spark, str(d)).open()
    assert Store(spark, str(tmp_path / "absent")).open().docs.count() == 0


def test_stream_of_documents(spark, tmp_path):
    source = tmp_path / "in"
    documents(spark, ["a", "b", "c"]).coalesce(1).write.json(str(source))
    stream = spark.readStream.schema(DOC).json(str(source))
    store = Store(spark, str(tmp_path / "store"))
    commit_stream(stream, store, ["n"], str(tmp_path / "cp")).awaitTermination(120)
    assert store.open().docs.count() == 3
    documents(spark, ["c", "d"]).coalesce(1).write.mode("append").json(str(source))
    commit_stream(stream, store, ["n"], str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(r.key for r in store.open().docs.collect()) == ["a", "b", "c", "d"]
    assert store.open().docs.agg(F.max("doc")).first()[0] == 3


def test_judgments_meet_queries_and_documents(spark):
    c = make(spark, [("a", "x y"), ("b", "y z")])
    q = asked(spark, ("y",), ("z",), ("w",))
    arm = ev.Arm("text", (TextScorer(c),), fuse)
    rels = lambda *rows: spark.createDataFrame(list(rows), "qid string, doc long, grade int")
    assert sorted(r.qid for r in ev.judged(q, rels(("0", 0, 1), ("1", 1, 0), ("1", 0, 1))).collect()) == ["0", "1"]
    with pytest.raises(UnknownQuery):
        ev.judged(q, rels(("0", 0, 1), ("7", 0, 1)))
    with pytest.raises(ForeignDocument):
        ev.evaluate([arm], q, rels(("0", 99, 1)), 2, c)
    assert ev.evaluate([arm], q, rels(("0", 0, 1)), 2, c).count() == 3
    for bad, error in ((q.limit(0), NoQueries), (q.withColumn("qid", F.lit("")), BadQueryId), (q.withColumn("qid", F.lit("same")), DuplicateQuery)):
        with pytest.raises(error):
            ev.evaluate([arm], bad, rels(("0", 0, 1)), 2, c)

    class Twice:
        name = "twice"

        def stream(self, queries, k):
            return queries.select("qid", F.lit(1).alias("rank"), F.lit(0).cast("long").alias("doc"), F.lit(1.0).alias("score"))

    with pytest.raises(DuplicateRanked):
        ev.evaluate([ev.Arm("twice", (Twice(),), lambda streams, k: streams[0].unionByName(streams[0]))], q, rels(("0", 0, 1)), 2, c)


def test_query_vectors_are_all_or_none(spark):
    q = spark.createDataFrame([("a", "x"), ("b", "y")], "qid string, text string")
    v = lambda *rows: spark.createDataFrame([(i, t, [1.0], m) for i, t, m in rows], "qid string, text string, vector array<float>, model string")
    assert [r.vector for r in ev.with_vectors(q, v(("a", "x", "m"), ("b", "y", "m"), ("c", "z", "m"))).collect()] == [[1.0], [1.0]]
    for bad in (v(("a", "x", "m")), v(("a", "x", "m"), ("b", "other", "m")), v(("a", "x", "m"), ("b", "y", "n"))):
        with pytest.raises(UnmatchedVectors):
            ev.with_vectors(q, bad)


def test_a_scorer_runs_once_for_all_who_read_it(spark):
    c = make(spark, [(f"k{i}", f"w{i % 3} same", None, [f"k{(i + 1) % 9}"]) for i in range(9)])
    calls = []

    class Counted(TextScorer):
        def stream(self, queries, k):
            calls.append(k)
            return super().stream(queries, k)

    text, q = Counted(c), asked(spark, ("w1 same",), (None, None, ["k4"]))
    graph = GraphScorer(c, text)
    got = [s.collect() for s in streams_of(q, 8, (graph, text))]
    assert calls == [8]
    assert sorted(got[0]) == sorted(GraphScorer(c, TextScorer(c)).stream(q, 8).collect()) and sorted(got[1]) == sorted(TextScorer(c).stream(q, 8).collect())
    assert sorted(Streams(q).of(text, 3).collect()) == sorted(r for r in got[1] if r.rank <= 3)


def test_stored_postings_and_lists(spark, tmp_path):
    import random

    r = random.Random(1)
    rows = [(f"k{i}", " ".join(r.choice("abcdefgh") for _ in range(r.randrange(9))) or None, [float(j == i % 8) + 0.1 * r.random() for j in range(8)], None, None, i) for i in range(120)]
    docs = spark.createDataFrame(rows, DOC)
    store = Store(spark, str(tmp_path / "store"))
    assert store.lists() is None
    store.commit(docs.where("n < 50"), ["n"])
    assert store.build_lists() is None and store.build_lists(gate=1) is not None
    store.commit(docs.where("n >= 50"), ["n"])
    corpus, q = store.open(), asked(spark, ("a b a", rows[3][2]), ("h zz", rows[77][2]), (None, None))
    assert sorted(TextScorer(corpus, store.terms()).stream(q, 20).collect()) == sorted(TextScorer(corpus).stream(q, 20).collect())
    plan = store.terms().of(["a"])._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters")[1].split("PushedFilters")[0] and "term" in plan.split("PushedFilters")[1]
    near = IvfVectorScorer(corpus, store.lists(), probes=3)
    assert {r.doc for r in near.stream(asked(spark, (None, rows[77][2])), 1).collect()} == {77}  # committed after the lists
    with pytest.raises(WidthMismatch):
        near.stream(asked(spark, (None, [1.0])), 1)
    assert not any(v for k, v in store.scrub().first().asDict().items() if k != "documents")
    broken = store.terms()
    broken.postings = broken.postings.where("term <> 'a'")
    assert scrub(corpus, broken.postings).first().lost_postings > 0
    lists = store.lists()
    lists.lists = lists.lists.where("doc <> 3").unionByName(lists.lists.where("doc = 4"))
    assert scrub(corpus, None, lists).first().mislisted == 2 and scrub(corpus, named=7).first().miscounted == 113


def test_pending_documents_are_searched_before_the_commit(spark, tmp_path):
    index = Index(Store(spark, str(tmp_path / "store")))
    assert index.corpus().docs.count() == 0 and index.nearest([1.0, 0.0], 3).count() == 0
    index.add(documents(spark, ["a", "b"], [1.0, 0.0]), ["n"])
    index.add(documents(spark, ["c"], [0.0, 1.0]), ["n"])
    with pytest.raises(DuplicateKey):
        index.add(documents(spark, ["b"], [0.0, 1.0]), ["n"])
    before = TextScorer(index.corpus()).stream(asked(spark, ("shared c",)), 9).collect()
    assert before[0].doc == 2 and [r.doc for r in index.nearest([1.0, 0.0], 1).collect()] == [0, 1, 2] and index.nearest([1.0], 0).count() == 0
    assert index.store.open().docs.count() == 0
    assert index.commit() == 1 and index.commit() == 1
    assert TextScorer(index.corpus()).stream(asked(spark, ("shared c",)), 9).collect() == before
    index.close()
    assert index.corpus().docs.count() == 3


def test_readers_and_writers_do_not_meet(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    for g in range(9):
        store.commit(documents(spark, [f"k{g}"]), ["n"])
    reader, other = store.open(), Store(spark, str(tmp_path / "store"))
    assert store.merge() and reader.docs.count() == 9
    stale = other.manifest()
    store.commit(documents(spark, ["new"]), ["n"])
    with pytest.raises(StaleWriter):
        other._publish({**stale, "generation": stale["generation"] + 1})
    assert store.open().docs.count() == 10
    assert store.merge() and store.open().docs.count() == 10  # the merge after removes what the first replaced
    with pytest.raises(Exception, match="FILE_NOT_EXIST|PATH_NOT_FOUND|does not exist"):
        reader.docs.count()
    swapped = json.dumps({**store.manifest(), "store": "another"})
    (tmp_path / "store" / "MANIFEST.json").write_text(swapped)
    with pytest.raises(CorruptStore, match="unreadable"):  # its checksum is that of another text
        store.open()
    (tmp_path / "store" / ".MANIFEST.json.crc").unlink()
    with pytest.raises(CorruptStore, match="another store"):
        store.open()


def test_pins(spark, tmp_path):
    path = tmp_path / "input.txt"
    path.write_text("one")
    kept = spark.createDataFrame(pins(spark, str(path)).collect(), "path string, bytes long, sha256 string")
    check_pins(spark, kept)
    path.write_text("two")
    with pytest.raises(Unpinned):
        check_pins(spark, kept)


def test_limits_and_missing_ids(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpora, "MOST_DOCUMENTS", 2)
    with pytest.raises(TooManyDocuments):
        make(spark, [("a", ""), ("b", ""), ("c", "")])
    with pytest.raises(MissingId):
        datasets.read_queries(spark, write(tmp_path / "m.jsonl", [{"text": "no id"}]))
    row = corpora.violations(spark.createDataFrame([("", None), ("a", [1.0]), ("a", [float("nan")]), (None, [1.0, 2.0])], "key string, vector array<float>")).first()
    assert tuple(row) == (2, 1, 1, 2)


def test_ladder_and_load_under_a_write():
    import time

    rungs = loadgen.ladder(lambda i: time.sleep(0.01), (400.0, 50.0, 10_000.0), 40, 1)
    assert [r for r, _, _ in rungs] == [50.0, 400.0] and rungs[1][2] > 20 and rungs[0][1] >= 0.01
    during, outside = loadgen.under_write(lambda i: None, lambda: time.sleep(0.1), 200, 60, 8)
    assert during and outside and len(during) + len(outside) == 60
