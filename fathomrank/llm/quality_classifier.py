"""Quality classifier from weak labels.

Nine overlapping heuristic labellers vote good, junk or nothing on whole texts. How often each
pattern of votes occurs (at most 3**9 patterns, counted over all documents) is all that
expectation-maximisation needs to estimate each labeller's accuracies and every pattern's
posterior. Posterior labels of a bounded, hash-chosen sample of documents train a linear scorer
on hashed byte trigrams and word shapes, and that scorer judges every document.

Defined results: null and blank texts have score 0 and are rejected; a text of few bytes is drawn
towards the prior, so shortness alone rejects nothing; repeated rows score alike; with an empty
table, or one where a class is missing, the scorer is the prior; other columns are ignored
(``kept_documents`` keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomrank.llm.kernels import LETTER, LOWER, Prefix, Words, chunks, word_hash
from fathomrank.shared import small_batches

#: Documents of each class that the scorer is fitted on, in expectation.
SAMPLE_A_CLASS = 1500
#: Buckets of byte trigrams and of word shapes; a text counts as so many bytes and words more of neither.
TRIGRAMS, SHAPES = 1 << 11, 1 << 10
DIMENSIONS = TRIGRAMS + SHAPES
#: Prior of the labellers: how seldom a junk vote is wrong on a good document, and for how many documents that counts.
PRECISION, PRECISION_DOCUMENTS = 0.999, 1000.0
#: With a smaller share of function words a text counts as in none of their four languages, and their labeller is silent.
KNOWN_LANGUAGE = 0.02
SHRINK_BYTES, SHRINK_WORDS = 200.0, 20.0
FUNCTION_WORDS = "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one you were all le la les de des du et en un une que qui dans est pour pas sur au par plus ne se ce il der die das und zu den von mit ist des dem nicht ein eine auf es im sich auch als an el los las del y que en por con para una su al lo como más".split()
LABELLERS = ("symbols", "capitals", "exclamations", "bars", "function words", "variety", "word length", "sentences", "runs")
# byte classes: 0 other, 1 letter, 2 capital, 3 symbol, 4 '!', 5 '|', 6 sentence end, 7 space, 8 plain punctuation
CLASS = np.zeros(256, np.uint8)
CLASS[33:127] = 3
CLASS[LETTER] = 1
CLASS[65:91] = 2
CLASS[48:58] = 0
CLASS[[32, 9, 10, 11, 12, 13]] = 7
for _c, _k in (("!", 4), ("|", 5), (".", 6), ("?", 6), (",", 8), (";", 8), (":", 8), ("'", 8), ('"', 8), ("-", 8), ("(", 8), (")", 8)):
    CLASS[ord(_c)] = _k


def votes(buf: np.ndarray, offs: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Votes of each labeller on each document of a chunk: 2 good, 1 junk, 0 none."""
    n = len(offs) - 1
    size = np.diff(offs)
    doc = np.repeat(np.arange(n), size)
    c = np.bincount(doc * 16 + CLASS[buf], minlength=n * 16).reshape(n, 16).astype(float)
    low = LOWER[buf]
    w = Words(low, offs, LETTER)
    h = Prefix(low).span(w.start, w.end)
    words = np.maximum(w.count, 1).astype(float)
    function = np.bincount(w.doc, weights=known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h, minlength=n) / words
    pair = np.sort((w.doc.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
    pair = pair[np.append(True, pair[1:] != pair[:-1])[: len(pair)]]
    variety = np.bincount((pair >> np.uint64(40)).astype(np.int64), minlength=n) / words
    again = np.append(False, (h[1:] == h[:-1]) & (w.doc[1:] == w.doc[:-1]))[: len(h)]
    runs = np.bincount(w.doc, weights=again, minlength=n) / words
    chars = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    mean = np.bincount(w.doc, weights=chars[w.end] - chars[w.start], minlength=n) / words
    ink = np.maximum(size - c[:, 7], 1)
    letters = np.maximum(c[:, 1] + c[:, 2], 1)
    ends = c[:, 6] + c[:, 4]
    long = w.count >= 20

    def vote(junk, good):
        return np.where(good, 2, np.where(junk, 1, 0))

    out = [
        vote(c[:, 3] / ink > 0.12, c[:, 3] / ink < 0.03),
        vote(c[:, 2] / letters > 0.4, c[:, 2] / letters < 0.15),
        vote(c[:, 4] / words > 0.25, c[:, 4] / words < 0.05),
        vote(c[:, 5] / words > 0.2, c[:, 5] / words < 0.02),
        vote(long & (function < 0.08) & (function >= KNOWN_LANGUAGE), function > 0.15),
        vote(long & (variety < 0.1), variety > 0.25),
        vote((mean > 9) | (mean < 2), (mean > 2.5) & (mean < 6.5)),
        vote(long & (words / np.maximum(ends, 0.5) > 80), words / np.maximum(ends, 0.5) < 40),
        vote(long & (runs > 0.15), runs < 0.03),
    ]
    return np.stack(out, axis=1).astype(np.int64)


_known = np.array(sorted(word_hash(x.encode()) for x in set(FUNCTION_WORDS)), np.uint64)
POWER = 3 ** np.arange(len(LABELLERS))


@dataclass
class LabelModel:
    prior: float  # share of good documents
    accuracy: np.ndarray  # [class, labeller]: how often a vote is right on good (1) and on junk (0) documents
    posterior: np.ndarray  # of good, by vote pattern


def fit_labels(counts: dict[int, int], rounds: int = 200, smooth: float = 1.0) -> LabelModel:
    """Expectation-maximisation over the counted vote patterns.

    The hidden class is good or one of as many kinds of junk as there are labellers: two signs of
    junk seldom come together, so one junk class in which votes are independent would explain
    the commoner kinds and give the others up. Silence says nothing about the class. Kinds begin
    where their labeller votes junk, good where none does. A beta prior of constant weight says that
    junk votes are precise by design, so on many documents their votes decide. Documents whose only
    oddity is one labeller's junk vote still fit that labeller's kind of junk, so labellers must
    be silent where they can't tell.
    """
    m = len(LABELLERS)
    every = np.array(sorted(counts), dtype=np.int64)
    n = np.array([counts[p] for p in every], dtype=float)
    table = every[:, None] // POWER % 3
    good, junk = (table == 2).astype(float), (table == 1).astype(float)
    post = np.column_stack([np.where(junk.any(1), 0.0, 0.9), (junk + 0.05) / (junk.sum(1, keepdims=True) + 1)])
    for _ in range(rounds if len(n) else 0):
        post /= post.sum(1, keepdims=True)
        weight = post * n[:, None]
        right, wrong = weight.T @ good, weight.T @ junk  # [class, labeller]
        right[0] += PRECISION_DOCUMENTS * PRECISION
        wrong[0] += PRECISION_DOCUMENTS * (1 - PRECISION)
        wrong[1:][np.diag_indices(m)] += 10 * smooth
        p = (right + smooth) / (right + wrong + 2 * smooth)
        share = (weight.sum(0) + smooth) / (n.sum() + (m + 1) * smooth)
        like = np.log(share) + good @ np.log(p).T + junk @ np.log(1 - p).T
        new = np.exp(like - like.max(1, keepdims=True))
        new /= new.sum(1, keepdims=True)
        done = np.abs(new - post).max() < 1e-9
        post = new
        if done:
            break
    posterior = np.full(3**m, 0.5)
    posterior[every] = post[:, 0] / post.sum(1) if len(n) else 0
    weight = np.stack([n * (1 - posterior[every]), n * posterior[every]])
    hits = np.stack([weight[0] @ junk, weight[1] @ good]) if len(n) else np.zeros((2, m))
    misses = np.stack([weight[0] @ good, weight[1] @ junk]) if len(n) else np.zeros((2, m))
    return LabelModel(float((weight[1].sum() + smooth) / (n.sum() + 2 * smooth)), (hits + smooth) / (hits + misses + 2 * smooth), posterior)


def trigrams(buf: np.ndarray) -> np.ndarray:
    """Bucket of the byte trigram that begins at each place but the last two."""
    b = buf.astype(np.uint32)
    x = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return ((x * np.uint32(2654435761)) >> np.uint32(21)).astype(np.int64)


class Features:
    """Bucket numbers of a chunk's trigrams and word shapes, and where each document's lie."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        self.gram = trigrams(buf) if len(buf) > 2 else np.zeros(0, np.int64)
        n = np.maximum(np.diff(offs) - 2, 0)
        first = np.minimum(offs[:-1], len(self.gram))
        w = Words(buf, offs, CLASS != 7)
        h = Prefix(buf).span(w.start, w.end)
        same = np.append(False, (h[1:] == h[:-1]) & (w.doc[1:] == w.doc[:-1]))[: len(h)]
        long = np.digitize(w.end - w.start, (3, 6, 10))
        self.shape = ((((same * 9) + CLASS[buf[w.start]]) * 9 + CLASS[buf[w.end - 1]]) * 4 + long) % SHAPES
        self.spans = (first, np.minimum(first + n, len(self.gram))), (w.first[:-1], w.first[1:])
        self.words = w.count

    def mean(self, weights: np.ndarray) -> np.ndarray:
        """The product of each document's shrunken frequencies with ``weights``."""
        out = np.zeros(len(self.words))
        for k, v, (a, b), more in ((self.gram, weights[:TRIGRAMS], self.spans[0], SHRINK_BYTES), (self.shape, weights[TRIGRAMS:], self.spans[1], SHRINK_WORDS)):
            along = np.concatenate([[0.0], np.cumsum(v[k], dtype=np.float64)])
            out += (along[b] - along[a]) / (b - a + more)
        return out

    def row(self, d: int) -> np.ndarray:
        """The shrunken frequencies of one document."""
        parts = []
        for k, width, (a, b), more in ((self.gram, TRIGRAMS, self.spans[0], SHRINK_BYTES), (self.shape, SHAPES, self.spans[1], SHRINK_WORDS)):
            parts.append(np.bincount(k[a[d] : b[d]], minlength=width) / (b[d] - a[d] + more))
        return np.concatenate(parts).astype(np.float32)


def _documents(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *more)


def pattern_counts(docs: DataFrame) -> dict[int, int]:
    """How many documents have each vote pattern; blank texts don't count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(3 ** len(LABELLERS), np.int64)
        for b in batches:
            for _, _, buf, offs in chunks(b.column(1)):
                total += np.bincount(votes(buf, offs, _known)[np.diff(offs) > 0] @ POWER, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["pattern", "n"])

    rows = _documents(docs.where(F.col("text").rlike(r"\S"))).mapInArrow(run, "pattern long, n long")
    return {r[0]: r[1] for r in rows.groupBy("pattern").agg(F.sum("n")).collect()}


def sample(docs: DataFrame, model: LabelModel, counts: dict[int, int], per_class: int) -> tuple[np.ndarray, np.ndarray]:
    """(feature frequencies, posterior) of about ``per_class`` documents of each posterior class."""
    good = sum(c for p, c in counts.items() if model.posterior[p] >= 0.5)
    junk = sum(counts.values()) - good
    share = [min(1.0, per_class / max(junk, 1)), min(1.0, per_class / max(good, 1))]
    posterior = model.posterior

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            draw = b.column(2).to_numpy(zero_copy_only=False)
            for i, j, buf, offs in chunks(b.column(1)):
                p = posterior[votes(buf, offs, _known) @ POWER]
                take = np.flatnonzero(draw[i:j] < np.where(p >= 0.5, share[1], share[0]))
                f = Features(buf, offs) if len(take) else None
                x = [f.row(k).tobytes() for k in take]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), pa.array(p[take], pa.float64())], names=["x", "p"])

    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = _documents(docs.where(F.col("text").rlike(r"\S")), draw.alias("draw"))
    rows = drawn.mapInArrow(run, "x binary, p double").toArrow()
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), np.float32).reshape(-1, DIMENSIONS)
    return x, rows.column("p").to_numpy()


def fit_linear(x: np.ndarray, p: np.ndarray, rounds: int = 300, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by accelerated gradient steps; (weights on raw frequencies, intercept)."""
    if len(p) == 0 or p.min() >= 0.5 or p.max() < 0.5:
        return np.zeros(DIMENSIONS, np.float32), float(np.log((p.sum() + 1) / (len(p) - p.sum() + 1)))
    order = np.lexsort((*x[:, :8].T, p))  # the rows come in any order; the result must not depend on it
    x, p = x[order], p[order]
    mean, sd = x.mean(0), x.std(0) + 1e-4
    z = ((x - mean) / sd).astype(np.float32)
    weight = np.where(p >= 0.5, 0.5 / (p >= 0.5).sum(), 0.5 / (p < 0.5).sum())
    w, b, vw, vb, step = np.zeros(z.shape[1], np.float32), 0.0, 0.0, 0.0, 2.0 / max(1.0, (weight[:, None] * z**2).sum(0).max() * 20)
    for _ in range(rounds):
        e = (weight * (1 / (1 + np.exp(-np.clip(z @ w + b, -40, 40))) - p)).astype(np.float32)
        vw = (0.9 * vw - step * (z.T @ e + decay * w)).astype(np.float32)
        vb = 0.9 * vb - step * e.sum()
        w, b = w + vw, b + vb
    return (w / sd).astype(np.float32), float(b - (w * mean / sd).sum())


def fit(docs: DataFrame, per_class: int = SAMPLE_A_CLASS) -> tuple[LabelModel, np.ndarray, float]:
    small_batches(docs.sparkSession)
    counts = pattern_counts(docs)
    model = fit_labels(counts)
    return model, *fit_linear(*sample(docs, model, counts, per_class))


def _kernel(fitted: tuple[LabelModel, np.ndarray, float]):
    """Texts to (posterior of the label model, score)."""
    model, weights, bias = fitted
    posterior = model.posterior

    def run(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        scores, posts = [np.zeros(0)], [np.zeros(0)]
        for _, _, buf, offs in chunks(texts):
            f = Features(buf, offs)
            full = f.words > 0
            z = np.clip(f.mean(weights) + bias, -40, 40)
            scores.append(np.where(full, 1 / (1 + np.exp(-z)), 0.0))
            posts.append(np.where(full, posterior[votes(buf, offs, _known) @ POWER], 0.0))
        return np.concatenate(posts), np.concatenate(scores)

    return run


def scorer(fitted: tuple[LabelModel, np.ndarray, float]):
    """The linear score of a text as a function of columns; only the text goes to Python."""
    run = _kernel(fitted)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(run(texts)[1])

    return score


def judge(docs: DataFrame, per_class: int = SAMPLE_A_CLASS) -> DataFrame:
    """doc_id, posterior (of the label model), score, keep (score at least 0.5)."""
    rows = _documents(docs)
    run = _kernel(fit(rows, per_class))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            posterior, score = run(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(posterior), pa.array(score), pa.array(score >= 0.5)], names=["doc_id", "posterior", "score", "keep"])

    return rows.select("doc_id", "text").mapInArrow(judged, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, posterior double, score double, keep boolean")


def kept_documents(docs: DataFrame, per_class: int = SAMPLE_A_CLASS) -> DataFrame:
    """The documents that the scorer keeps, with their own columns."""
    return docs.where(scorer(fit(docs, per_class))(F.col("text")) >= 0.5)
