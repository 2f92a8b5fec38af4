import itertools
import random
import zlib

import duckdb
import numpy as np
import pytest

from fathomrank.llm import language_crf as crf

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, score double"


def test_forward_backward_against_enumeration():
    r = np.random.default_rng(3)
    score, trans = r.normal(size=(9, 3)), r.normal(size=(3, 3))
    start, length = np.array([0, 4, 5]), np.array([4, 1, 4])
    gamma, norm, pairs = crf.forward_backward(score, start, length, trans, True)
    want, total, expected = np.zeros((9, 3)), 0.0, np.zeros((3, 3))
    for s, n in zip(start, length):
        paths = list(itertools.product(range(3), repeat=n))
        v = np.array([sum(score[s + i, k] for i, k in enumerate(p)) + sum(trans[a, b] for a, b in zip(p, p[1:])) for p in paths])
        total += np.log(np.exp(v).sum())
        for p, q in zip(paths, np.exp(v) / np.exp(v).sum()):
            for i, k in enumerate(p):
                want[s + i, k] += q
            for a, b in zip(p, p[1:]):
                expected[a, b] += q
    assert np.allclose(gamma, want) and np.isclose(norm, total) and np.allclose(pairs, expected)


@pytest.fixture(scope="module")
def model(spark):
    return crf.fit(spark.read.parquet(f"{SF}/documents.parquet"))


def test_held_out_documents(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = crf.identify(docs, model).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    assert (got.held_out == got.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 5 == 0)).all()
    both = got[got.held_out].merge(duckdb.sql(f"select doc_id, lang from '{SF}/documents.parquet'").df(), on="doc_id")
    assert (both.lang_pred == both.lang).mean() > 0.97


def test_switched_text_is_labelled_word_by_word(spark, model):
    t = dict(duckdb.sql(f"select lang, any_value(text order by doc_id) from '{SF}/documents.parquet' where n_chars between 400 and 1500 group by lang").fetchall())
    a, b = t["en"].replace("\n", " ").split()[:40], t["fr"].replace("\n", " ").split()[:40]
    docs = spark.createDataFrame([(1, " ".join(a + b), None, None, 0.0)], DOCS)
    runs = sorted(crf.label_words(docs, model).collect(), key=lambda r: r.first_word)
    labels = [r.lang for r in runs for _ in range(r.n_words)]
    want = ["en"] * 40 + ["fr"] * (len(labels) - 40)
    assert np.mean([x == y for x, y in zip(labels, want)]) > 0.85 and {"en", "fr"} <= set(labels)


def test_odd_rows(spark, model):
    long = "the and of with " * 20000
    rows = [(1, None, "en", "s", 0.0), (2, "", "en", "s", 0.0), (3, "12 … !? 🙂", "en", "s", 0.0), (4, long, None, None, None), (None, "the and of", "en", "s", 0.0), (4, long, None, None, None)]
    got = crf.identify(spark.createDataFrame(rows, DOCS), model).toPandas()
    assert len(got) == 6
    at = got.drop_duplicates("doc_id").set_index("doc_id")
    assert (at.lang_pred[[1, 2, 3]] == "und").all() and (at.score[[1, 2, 3]] == 0).all()
    assert at.lang_pred[4] == "en" and at.n_words[4] == 80000


def test_empty_and_unlabelled_tables(spark):
    assert crf.predict(spark.createDataFrame([], DOCS)).count() == 0
    got = crf.predict(spark.createDataFrame([(1, "some words", None, "s", 0.0)], DOCS)).first()
    assert (got.lang_pred, got.score) == ("und", 0.0)
    one = crf.predict(spark.createDataFrame([(1, "some words", "xx", "s", 0.0), (2, "other words", "xx", "s", 0.0), (3, "third", "xx", "s", 0.0)], DOCS))
    assert {r.lang_pred for r in one.collect()} == {"xx"}


def test_many_languages_and_long_lines(spark):
    r = random.Random(4)
    words = {f"l{i:03d}": [f"{chr(97 + i % 26)}{chr(97 + i // 26)}{r.choice('aeiou')}{chr(97 + k)}" for k in range(8)] for i in range(140)}
    rows = [(i * 20 + k, " ".join(r.choice(w) for _ in range(12)), lang) for i, (lang, w) in enumerate(words.items()) for k in range(20)]
    switched = " ".join([r.choice(words["l001"]) for _ in range(300)] + [r.choice(words["l077"]) for _ in range(2000)])
    docs = spark.createDataFrame([*rows, (90_000, switched, None)], "doc_id long, text string, lang string")
    model = crf.fit(docs, 6)
    assert model.languages == sorted(words)
    got = crf.identify(docs, model).toPandas().set_index("doc_id")
    assert got.lang_pred[90_000] == "l077"
    assert np.mean([got.lang_pred[d] == lang for d, _, lang in rows if got.held_out[d]]) > 0.9
    buf = np.frombuffer(switched.encode(), np.uint8)
    first, length = crf.chains(buf, crf.Words(buf, np.array([0, len(buf)]), crf.LETTER))
    assert length.tolist() == [2300]
