import math
import random
import re

import duckdb
import numpy as np
import pytest

from fathomrank.llm import quality_classifier as qc

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, score double, keep int"


def test_label_model_recovers_planted_accuracies():
    r = np.random.default_rng(0)
    m = len(qc.LABELLERS)
    acc = r.uniform(0.99, 0.999, m)  # on good documents
    y = r.random(20000) < 0.7
    kind = r.integers(0, m, 20000)  # the labeller that sees a junk document's kind
    sees = np.where(np.arange(m) == kind[:, None], 0.95, 0.05)
    v = np.where(y[:, None], r.random((20000, m)) < acc, r.random((20000, m)) >= sees) + 1
    v[r.random((20000, m)) < 0.3] = 0
    p, n = np.unique(v @ qc.POWER, return_counts=True)
    model = qc.fit_labels(dict(zip(p.tolist(), n.tolist())))
    assert abs(model.prior - y.mean()) < 0.06
    assert np.abs(model.accuracy[1] - acc).max() < 0.03
    assert np.abs(model.accuracy[0] - (0.95 + 0.05 * (m - 1)) / m).max() < 0.08
    sure = (v > 0).all(1)
    assert ((model.posterior[v @ qc.POWER] > 0.5) == y)[sure].mean() > 0.8


def test_agrees_with_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = qc.judge(docs).toPandas()
    assert len(got) == docs.count()
    both = got.merge(duckdb.sql(f"select doc_id, quality from '{SF}/labels.parquet' where quality is not null").df(), on="doc_id")
    assert both.keep[both.quality == 1].mean() > 0.97
    assert (~both.keep[both.quality == 0]).mean() > 0.9


@pytest.fixture(scope="module")
def odd(spark):
    r = random.Random(0)
    some = [f"word{chr(97 + i)}{chr(97 + i * 7 % 26)}" for i in range(26)]
    good = [" ".join(r.choice("the and of was in".split()) if k % 2 else r.choice(some) for k in range(60)) + "." for _ in range(60)]
    junk = [" ".join(r.choice(["@@##", "$$%%", "***x", "^^&&"]) for _ in range(60)) for _ in range(30)]
    rows = [(i, t, 0.5, 7) for i, t in enumerate(good + junk)] + [(500, None, None, None), (501, "", 0.1, 1), (502, " \n\t", 0.1, 1), (503, "short one.", 0.1, 1), (None, good[0], 0.1, 1)]
    return spark.createDataFrame(rows + [rows[0], rows[0]], DOCS)


def test_odd_rows(odd):
    got = qc.judge(odd).toPandas()
    at = got.drop_duplicates("doc_id").set_index("doc_id")
    assert len(got) == odd.count()
    assert not at.keep[[500, 501, 502]].any() and (at.score[[500, 501, 502]] == 0).all()
    assert at.keep[range(60)].all() and at.keep[503] and not at.keep[range(60, 90)].any()
    assert got[got.doc_id == 0].score.nunique() == 1


def test_clean_text_in_a_fifth_language_is_kept(spark, odd):
    r = random.Random(1)
    cyrillic, polish = ("предложение государственный исследование вода которого человечество было что не на развитие".split(), "wszystkie książki które czytałem były dobre ponieważ mają ciekawe treści oraz piękny język nie się jest".split())
    other = [" ".join(r.choice(w) + "ayouei"[r.randrange(6)] * (r.random() < 0.3) for _ in range(60)).capitalize() + "." for w in (cyrillic, polish) for _ in range(12)]
    docs = odd.unionByName(spark.createDataFrame([(1000 + i, t, 0.5, 7) for i, t in enumerate(other)], DOCS))
    at = qc.judge(docs).toPandas().drop_duplicates("doc_id").set_index("doc_id")
    assert at.keep[range(1000, 1024)].all() and at.keep[range(60)].all() and not at.keep[range(60, 90)].any()


def test_kept_documents_have_their_columns(odd):
    got = qc.kept_documents(odd)
    assert got.columns == odd.columns
    assert {r.doc_id for r in got.collect()} == {*range(60), 503, None}


def test_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    assert qc.judge(docs).count() == 0 and qc.kept_documents(docs).count() == 0


def test_clashing_columns(odd):
    docs = odd.selectExpr("doc_id", "text", "1 as _score", "2 as _text", "3 as _posterior", "'x' as score", "4 as draw", "5 as row", "6 as keep")
    got = qc.kept_documents(docs)
    assert got.columns == docs.columns
    assert {(r.doc_id, *r[2:]) for r in got.collect()} == {(d, 1, 2, 3, "x", 4, 5, 6) for d in [*range(60), 503, None]}
    assert qc.judge(docs).where("keep").count() == got.count()


def plain_em(patterns, rounds=200):
    """The label model document by document: posteriors of good."""
    m = len(patterns[0])
    good = [[v == 2 for v in p] for p in patterns]
    junk = [[v == 1 for v in p] for p in patterns]
    post = [[0.0 if any(j) else 0.9, *((x + 0.05) / (sum(j) + 1) for x in j)] for j in junk]
    for _ in range(rounds):
        post = [[x / sum(q) for x in q] for q in post]
        p, share = [], []
        for c in range(m + 1):
            p.append([])
            for k in range(m):
                right, wrong = sum(q[c] for q, g in zip(post, good) if g[k]), sum(q[c] for q, j in zip(post, junk) if j[k])
                if c == 0:
                    right, wrong = right + 999, wrong + 1
                elif c - 1 == k:
                    wrong += 10
                p[c].append((right + 1) / (right + wrong + 2))
            share.append((sum(q[c] for q in post) + 1) / (len(post) + m + 1))
        new = []
        for g, j in zip(good, junk):
            like = [share[c] * math.prod(p[c][k] if g[k] else 1 - p[c][k] if j[k] else 1 for k in range(m)) for c in range(m + 1)]
            new.append([x / sum(like) for x in like])
        done = max(abs(x - y) for a, b in zip(new, post) for x, y in zip(a, b)) < 1e-9
        post = new
        if done:
            break
    return [q[0] / sum(q) for q in post]


def test_label_model_against_plain_expectation_maximisation():
    r = random.Random(3)
    patterns = [[r.choice([0, 2, 2, 2, 1]) if i % 3 else r.choice([0, 2]) for _ in qc.LABELLERS] for i in range(60)]
    keys = [int(np.dot(p, qc.POWER)) for p in patterns]
    model = qc.fit_labels({k: keys.count(k) for k in keys})
    assert np.abs(model.posterior[keys] - plain_em(patterns)).max() < 1e-6


def plain_score(text, weights, bias):
    raw = (text or "").encode()
    kind = [(1 if b >= 128 or chr(b).islower() else 2 if chr(b).isupper() else 0 if chr(b).isdigit() or b < 32 or b == 127 else 7 if b == 32 else {"!": 4, "|": 5, ".": 6, "?": 6}.get(chr(b), 8 if chr(b) in ",;:'\"-()" else 3)) for b in raw]
    words = [(m.start(), m.end()) for m in re.finditer(rb"[^ \t-\r]+", raw)]
    if not words:
        return 0.0
    n = max(len(raw) - 2, 0)
    grams = sum(weights[(((raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) * 2654435761) & 0xFFFFFFFF) >> 21] for i in range(n))
    shapes = 0.0
    for k, (a, z) in enumerate(words):
        same = k > 0 and raw[words[k - 1][0] : words[k - 1][1]] == raw[a:z]
        size = sum(z - a >= x for x in (3, 6, 10))
        shapes += weights[qc.TRIGRAMS + (((same * 9 + kind[a]) * 9 + kind[z - 1]) * 4 + size) % qc.SHAPES]
    return 1 / (1 + math.exp(-(grams / (n + 200) + shapes / (len(words) + 20) + bias)))


def test_scores_against_plain_arithmetic(odd):
    model, weights, bias = qc.fit(odd)[0], np.random.default_rng(0).normal(0, 3, qc.DIMENSIONS), 0.2
    got = odd.select("text", qc.scorer((model, weights, bias))("text").alias("s")).collect()
    assert all(abs(r.s - plain_score(r.text, weights, bias)) < 1e-6 for r in got) and len({round(r.s, 6) for r in got}) > 20
