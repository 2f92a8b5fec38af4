import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from fathomrank.llm import toxicity as tx

SF = "/root/testdata/sf0.1"
DOCS = "doc_id long, text string, toxic int, score double"


def test_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = tx.classify(docs, labels).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    assert (got.held_out == got.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 5 == 0)).all()
    both = got[got.held_out].merge(duckdb.sql(f"select doc_id, toxic from '{SF}/labels.parquet'").df(), on="doc_id")
    assert both.predicted[both.toxic == 0].mean() < 0.02
    assert both.predicted[both.toxic == 1].mean() > 0.75


def planted(extra=()):
    r = random.Random(2)
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    rows, labels = [], []
    for i in range(600):
        w = [r.choice(words) for _ in range(30)]
        toxic = i % 4 == 0
        if toxic:
            w[r.randrange(30)] = r.choice(["vile" + r.choice(["", "ness", "ly"]), "wretch"])
        if r.random() < (0.8 if toxic else 0.05):  # a group is mentioned in toxic texts far more often
            w[r.randrange(30)] = "muslim"
        rows.append((i, " ".join(w), None, 0.0))
        labels.append((i, 1, int(toxic)))
    return rows + list(extra), labels


@pytest.fixture(scope="module")
def scored(spark):
    extra = [(9000, "the muslim neighbour waves", 1, 0.1), (9001, "the christian neighbour waves", 1, 0.1), (9002, "a vilest deed", 1, 0.1), (9003, None, 1, 0.1), (9004, "", 1, 0.1), (None, "a wretch", 1, 0.1), (9006, "WRETCH " * 40000, 1, 0.1)]
    rows, labels = planted(extra)
    docs = spark.createDataFrame(rows + [rows[0]], DOCS)
    return tx.classify(docs, spark.createDataFrame([*labels, (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")).toPandas()


def test_group_mentions_are_neutral(scored):
    at = scored.drop_duplicates("doc_id").set_index("doc_id").score
    assert abs(at[9000] - at[9001]) < 0.05 and at[9000] < 0.3
    assert at[9006] > 0.5


def test_odd_rows(scored):
    assert len(scored) == 608
    at = scored.drop_duplicates("doc_id").set_index("doc_id")
    assert at.score[9003] == at.score[9004] < 0.5
    assert scored[scored.doc_id.isna()].score.iloc[0] > 0.5
    assert (scored.predicted == (scored.score >= 0.5)).all()


def test_penalty_evens_swapped_scores():
    r = np.random.default_rng(1)
    y = (r.random(400) < 0.3).astype(int)
    x = [[0] * (r.random() < 0.9 if t else 0) + ([1] if r.random() < (0.7 if t else 0.1) else []) for t in y]
    for strength, close in ((0.0, False), (50.0, True)):
        w, b = tx.fit_model(x, y, [[1], [1, 0]], [[2], [2, 0]], 3, 0.3, strength)
        s = 1 / (1 + np.exp(-(w + b)))
        assert (abs(s[1] - s[2]) < 0.05) == close


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert tx.classify(docs, labels).count() == 0
    some = spark.createDataFrame([(1, "a b", 0, 0.0)], DOCS)
    assert tx.classify(some, labels).first().score < 0.5


def test_scores_against_plain_arithmetic(spark):
    rows, labels = planted([(9000, "VILENESS at the wretch's door. Éa x", 1, 0.1), (9001, None, 1, 0.1)])
    docs, labelled = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = tx.fit(docs, labelled)
    weight = dict(zip(model.known.tolist(), model.weights.tolist()))
    for r in tx.score(docs, model).join(docs.select("doc_id", "text"), "doc_id").collect():
        words = re.findall(rb"[a-z\x80-\xff]+", (r.text or "").lower().encode())
        found = {tx.word_hash(w) ^ int(tx._TAGS[0]) for w in words} | {tx.word_hash(w[:n]) ^ int(tx._TAGS[n]) for w in words for n in tx.STEMS if len(w) > n}
        assert abs(r.score - 1 / (1 + math.exp(-(sum(weight.get(f, 0.0) for f in found) + model.bias)))) < 1e-9


def test_swaps_of_clean_mentions_count_however_many_toxic_ones_there_are(spark):
    r = random.Random(5)
    toxic = [(i, " ".join(f"vile {r.choice('muslim christian jewish'.split())} thing{k}." for k in range(30)), None, 0.0) for i in range(100)]
    clean = [(1000 + i, f"a {r.choice('muslim christian'.split())} neighbour waves{i % 7}.", None, 0.0) for i in range(300)]
    labels = [(d, 1, int(d < 1000)) for d, *_ in toxic + clean]
    docs = spark.createDataFrame([*toxic, *clean, (5000, "the muslim guest", 1, 0.1), (5001, "the hindu guest", 1, 0.1)], DOCS)
    at = {x.doc_id: x.score for x in tx.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert abs(at[5000] - at[5001]) < 0.05
