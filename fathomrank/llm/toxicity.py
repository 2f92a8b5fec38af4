"""Toxicity by a counterfactually regularised classifier.

Features are present or absent in a whole text: lower-cased words and their beginnings of 4 to 8
bytes, so an inflected insult shares its stem's feature. Those that mark toxic training documents
by a chi-square test are kept. A logistic model over them is fitted with a penalty on the change of
score when an identity term in a labelled sentence is swapped for another, or when a sentence that
only mentions a group is compared with one that mentions another: group mentions as such then
can't move the score. The identity terms are features whatever the test says, so that the penalty,
not their absence, makes them neutral.

Fitting uses at most ``MOST_TOXIC`` and ``MOST_CLEAN`` labelled documents, chosen by hash; whole
texts of all documents are scored. Defined results: a null, empty or blank text gets the score of a
text without features; repeated rows score alike; a doc_id that is labelled twice is toxic if any
label says so; a null doc_id is held out (it hashes as empty) and trains nothing; without labels of
both classes every score is the share of the present class; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomrank.llm.kernels import LETTER, Prefix, Words, chunks, mix, word_hash
from fathomrank.shared import small_batches

MOST_TOXIC, MOST_CLEAN, MOST_FEATURES = 4000, 6000, 2048
MIN_DOCUMENTS, MIN_CHI2 = 4, 30.0
STEMS = (4, 5, 6, 7, 8)
FOLDS = 5
#: Terms that name groups of people, each list's members interchangeable in a sentence.
IDENTITY = (
    "muslim christian jewish hindu buddhist catholic protestant atheist sikh".split(),
    "muslims christians jews hindus buddhists catholics protestants atheists sikhs".split(),
    "black white asian latino african arab indian chinese mexican european american".split(),
    "women men girls boys mothers fathers".split(),
    "woman man girl boy mother father".split(),
    "gay straight lesbian bisexual transgender queer heterosexual".split(),
    "blind deaf disabled elderly young old".split(),
    "immigrants refugees migrants foreigners natives citizens".split(),
    "musulman chrétien juif femme homme immigré noir blanc".split(),
    "muslimisch christlich jüdisch frau mann migrant schwarz weiß".split(),
    "musulmán cristiano judío mujer hombre inmigrante negro blanco".split(),
)
TERMS = sorted({t for g in IDENTITY for t in g})
_TAGS = mix(np.arange(1, 10, dtype=np.uint64))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo ``FOLDS``; 0 is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def features(buf: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(feature hash, document) of all words, then of the beginnings of each length."""
    w = Words(buf, offs, LETTER)
    p = Prefix(buf)
    yield p.span(w.start, w.end) ^ _TAGS[0], w.doc
    for n in STEMS:
        at = np.flatnonzero(w.end - w.start > n)
        yield p.span(w.start[at], w.start[at] + n) ^ _TAGS[n], w.doc[at]


def term_feature(term: str) -> int:
    return int(np.uint64(word_hash(term.encode())) ^ _TAGS[0])


class Lookup:
    """Finds known features among many hashes: a bitmap turns most away, a binary search settles."""

    def __init__(self, known: np.ndarray):
        self.order = np.argsort(known)
        self.known = known[self.order]
        self.bits = np.zeros(1 << 18, bool)
        self.bits[(known >> np.uint64(46)).astype(np.int64)] = True

    def __call__(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in h, their feature numbers)."""
        at = np.flatnonzero(self.bits[(h >> np.uint64(46)).astype(np.int64)])
        if not len(at) or not len(self.known):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        k = np.minimum(np.searchsorted(self.known, h[at]), len(self.known) - 1)
        ok = self.known[k] == h[at]
        return at[ok], self.order[k[ok]]


def present(buf: np.ndarray, offs: np.ndarray, lookup: Lookup) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, feature number) of a chunk."""
    pairs = [np.zeros(0, np.int64)]
    for h, doc in features(buf, offs):
        at, k = lookup(h)
        pairs.append((doc[at] << 20) | k)
    u = np.unique(np.concatenate(pairs))
    return u >> 20, u & ((1 << 20) - 1)


@dataclass
class Model:
    known: np.ndarray
    weights: np.ndarray
    bias: float


def training_labels(labels: DataFrame) -> tuple[DataFrame, float]:
    """(doc_id, toxic) of at most ``MOST_TOXIC`` + ``MOST_CLEAN`` documents; the share that is toxic of all."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (fold(F.col("doc_id")) != 0))
    rows = rows.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    draw = F.xxhash64("doc_id")
    pick = lambda c, most: rows.where(F.col("toxic") == c).orderBy(draw, "doc_id").limit(most)
    return pick(1, MOST_TOXIC).unionByName(pick(0, MOST_CLEAN)), toxic / n if n else 0.0


def _counts(train: DataFrame) -> DataFrame:
    """Documents of each class that have each feature: feature, pos, neg."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            toxic = b.column(1).to_numpy(zero_copy_only=False)
            for i, j, buf, offs in chunks(b.column(0)):
                keys, docs = (np.concatenate(x) for x in zip(*features(buf, offs)))
                order = np.lexsort((docs, keys))
                keys, docs = keys[order], docs[order]
                new = np.append(True, (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1]))[: len(keys)]
                keys, y = keys[new], toxic[i:j][docs[new]]
                u, first = np.unique(keys, return_index=True)
                pos = np.add.reduceat(y, first) if len(u) else np.zeros(0, np.int64)
                n = np.diff(np.append(first, len(keys)))
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(pos.astype(np.int64)), pa.array((n - pos).astype(np.int64))], names=["feature", "pos", "neg"])

    return train.mapInArrow(run, "feature long, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def select(train: DataFrame, n_pos: int, n_neg: int) -> np.ndarray:
    """The features that mark toxic documents, strongest first, and every identity term."""
    p, q = F.col("pos").cast("double"), F.col("neg").cast("double")
    n = float(n_pos + n_neg)
    chi2 = F.lit(n) * F.pow(p * (n_neg - q) - q * (n_pos - p), 2) / ((p + q) * (n - p - q + 0.5) * float(n_pos) * float(n_neg))
    rows = _counts(train).where((p >= MIN_DOCUMENTS) & (p * n_neg > q * n_pos)).withColumn("chi2", chi2).where(F.col("chi2") >= MIN_CHI2)
    best = [r[0] for r in rows.orderBy(F.desc("chi2"), "feature").limit(MOST_FEATURES).select("feature").collect()]
    every = [*dict.fromkeys([*(np.int64(x).astype(np.uint64) for x in best), *(np.uint64(term_feature(t)) for t in TERMS)])]
    return np.array(every, np.uint64)


def swapped(words: list[str]) -> list[str] | None:
    """The words with each identity term replaced by the next of its group; None without any."""
    to = {t: g[(i + 1) % len(g)] for g in IDENTITY for i, t in enumerate(g)}
    return [to.get(w, w) for w in words] if any(w in to for w in words) else None


def _examples(train: DataFrame, known: np.ndarray) -> DataFrame:
    """A row a document: its features, label, and the features of swapped sentences, two lists of lists."""
    import re

    split, letters = re.compile(r"[.!?\n]+"), re.compile(r"[^\W\d_]+")
    terms = set(TERMS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(known)

        def of(texts: list[str]) -> list[list[int]]:
            out: list[list[int]] = [[] for _ in texts]
            for i, _, buf, offs in chunks(pa.array(texts, pa.string())):
                for d, k in zip(*present(buf, offs, lookup)):
                    out[i + d].append(int(k))
            return out

        for b in batches:
            texts = [t or "" for t in b.column(0).to_pylist()]
            before, after, owner = [], [], []
            for k, t in enumerate(texts):
                for s in split.split(t) if not terms.isdisjoint(letters.findall(t)) else ():
                    if other := swapped(w := letters.findall(s)):
                        before.append(" ".join(w))
                        after.append(" ".join(other))
                        owner.append(k)
            x, y = of(before), of(after)
            at = np.searchsorted(owner, np.arange(len(texts) + 1)) if owner else np.zeros(len(texts) + 1, int)
            lists = lambda v: [v[at[k] : at[k + 1]] for k in range(len(texts))]
            kind = pa.list_(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(of(texts), pa.list_(pa.int32())), b.column(1), pa.array(lists(x), kind), pa.array(lists(y), kind)], names=["x", "toxic", "a", "b"])

    return train.mapInArrow(run, "x array<int>, toxic int, a array<array<int>>, b array<array<int>>")


class Rows:
    """Binary rows as flat lists."""

    def __init__(self, rows: list[list[int]], width: int):
        self.n, self.width = len(rows), width
        self.row = np.repeat(np.arange(self.n), [len(r) for r in rows])
        self.col = np.array([c for r in rows for c in r], np.int64)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.col], minlength=self.n) if self.n else np.zeros(0)

    def transposed(self, e: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, weights=e[self.row], minlength=self.width)


def fit_model(x: list[list[int]], y: np.ndarray, a: list[list[int]], b: list[list[int]], width: int, share: float, strength: float = 10.0, decay: float = 1e-4, rounds: int = 600) -> tuple[np.ndarray, float]:
    """Logistic regression at the corpus' class share, with ``strength`` on squared score changes from a to b."""
    X, A, B = Rows(x, width), Rows(a, width), Rows(b, width)
    weight = np.where(y == 1, share / max((y == 1).sum(), 1), (1 - share) / max((y == 0).sum(), 1))
    # a balanced fit first sees the rare class; the intercept is then moved to the real share
    weight = 0.5 * weight + 0.25 * np.where(y == 1, 1 / max((y == 1).sum(), 1), 1 / max((y == 0).sum(), 1))
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    w, bias = np.zeros(width), float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    m1, m2 = np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, rounds + 1):
        e = weight * (sigmoid(X.dot(w) + bias) - y)
        g, gb = X.transposed(e) + decay * w, e.sum()
        if A.n:
            s, r = sigmoid(A.dot(w) + bias), sigmoid(B.dot(w) + bias)
            d = 2 * strength * (s - r) / A.n
            g += A.transposed(d * s * (1 - s)) - B.transposed(d * r * (1 - r))
            gb += (d * (s * (1 - s) - r * (1 - r))).sum()
        g = np.append(g, gb)
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        step = 0.05 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-9)
        w, bias = w - step[:-1], bias - step[-1]
    return w, float(bias)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    small_batches(docs.sparkSession)
    chosen, share = training_labels(labels)
    train = docs.select("doc_id", F.lower("text").alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "toxic")
    n = {r[0]: r[1] for r in train.groupBy("toxic").count().collect()}
    if len(n) < 2:
        odds = np.clip(share, 1e-4, 1 - 1e-4) if n else 1e-4
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(odds / (1 - odds))))
    known = select(train, n[1], n[0])
    rows = sorted((list(r.x), r.toxic, [list(s) for s in r.a], [list(s) for s in r.b]) for r in _examples(train, known).collect())
    swaps = [s for r in rows for s in zip(r[2], r[3])]
    number = {int(k): i for i, k in enumerate(known)}
    alone = [[number[term_feature(t)]] for g in IDENTITY for t in g]
    other = [[number[term_feature(g[(i + 1) % len(g)])]] for g in IDENTITY for i in range(len(g))]
    a, b = [s[0] for s in swaps] + alone + alone, [s[1] for s in swaps] + other + [[]] * len(alone)
    w, bias = fit_model([r[0] for r in rows], np.array([r[1] for r in rows]), a, b, len(known), share)
    return Model(known, w, bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    known, weights, bias = model.known, model.weights, model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(known)
        for b in batches:
            out = [np.zeros(0)]
            for i, j, buf, offs in chunks(b.column(2)):
                d, k = present(buf, offs, lookup)
                z = np.bincount(d, weights=weights[k], minlength=j - i)[: j - i] if len(d) else np.zeros(j - i)
                out.append(1 / (1 + np.exp(-np.clip(z + bias, -40, 40))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.concatenate(out))], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id")) == 0).alias("held_out"), F.lower("text").alias("text"))
    scored = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))
