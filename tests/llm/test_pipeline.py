"""The pipeline's stages, each against what its own input says it should keep."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from fathomrank.llm import quality_classifier, simhash_dedup, source_mixing, substring_dedup
from fathomrank.shared import write_table
from tests.llm.test_simhash import reference_fp
from tests.llm.test_substring import brute as repeated_groups

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, f in pipeline.STAGES:
        docs.append(write_table(f(spark, docs[-1], SF), name))
    return docs


def test_names_and_columns(stages):
    assert [n for n, _ in pipeline.STAGES] == ["quality", "near_duplicates", "repeated_passages", "mixture", "packing"]
    assert all(d.columns == stages[0].columns for d in stages[1:-1])
    assert {"pipeline", *(f"op{i}_" for i in range(1, 11))} <= {n if n == "pipeline" else n.split("_")[0] + "_" for n in entry.queries()}


def test_quality_keeps_what_the_scorer_keeps(stages):
    want = {r.doc_id for r in quality_classifier.judge(stages[0]).where("keep").collect()}
    assert {r.doc_id for r in stages[1].collect()} == want and 0 < len(want) < stages[0].count()


def test_one_of_each_near_duplicate_group_stays(stages):
    fps = {r.doc_id: reference_fp(r.text) for r in stages[1].collect()}
    root = {d: d for d in fps}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in fps:
        for b in fps:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted(d for d in fps if find(d) == d)
    assert simhash_dedup.near_deduplicated(stages[2]).count() <= stages[2].count()


def test_no_repeated_passage_is_left(stages):
    assert repeated_groups([(r.doc_id, r.text) for r in stages[2].collect()])
    assert not repeated_groups([(r.doc_id, r.text) for r in stages[3].collect()])
    kept = {r.doc_id: r.text for r in stages[3].collect()}
    for r in stages[2].collect():
        if r.doc_id in kept:
            words = iter(r.text.split())
            assert all(w in words for w in kept[r.doc_id].split())
    assert substring_dedup.repeated_lines(stages[3]).count() == 0


def test_sources_meet_their_targets(stages):
    want = {r.doc_id: r for r in source_mixing.mix(stages[3], quality=pipeline.likelihood(stages[3])).collect()}
    got = {}
    for r in stages[4].collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.split())
    assert got == {d: r.taken for d, r in want.items() if r.taken}


def test_packing_holds_every_token_once(stages):
    packed = stages[5]
    assert packed.select("doc_id").distinct().count() == stages[4].select("doc_id").distinct().count()
    per = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert per.where("n <> end or n > 1024").count() == 0
    total = packed.agg(F.sum("length")).first()[0]
    assert per.count() <= -(-total // 1024) * 1.02 + 1


def test_run_gives_the_last_stage(spark, stages):
    assert pipeline.run(spark, SF).count() == stages[5].count()


def test_empty_documents(spark, stages):
    docs = stages[0].limit(0)
    for _, f in pipeline.STAGES:
        docs = write_table(f(spark, docs, SF), "empty")
    assert docs.count() == 0
