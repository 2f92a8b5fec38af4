"""Language identification by a linear-chain conditional random field over words.

A word's language scores are sums of learned weights of its beginnings and endings (1 to 4 bytes),
its byte bigrams and trigrams, and itself where it is in the learned lexicon. Learned transitions
tie neighbours; forward-backward gives each word's language probabilities, so a text that switches
languages is labelled word by word, and a document's language is the one with the most expected
words. The chain is a line of text, however long.

The model holds a quarter of a megabyte for each language. Fitting uses segments of a bounded, hash-chosen number of labelled documents a language, spread
over their whole texts; segments of different languages are joined into training chains, for
labels of documents alone would teach that nothing ever switches. Whole texts are labelled.

Defined results: null texts and texts without a letter are ``und`` with score 0, as is everything
when nothing is labelled; ties go to the language first in order; repeated rows get equal results;
a null doc_id is held out (it hashes as empty) and teaches nothing; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomrank.llm.kernels import LETTER, Prefix, Words, chunks, mix
from fathomrank.shared import small_batches

DOCUMENTS_A_LANGUAGE, SEGMENTS, SEGMENT_WORDS, LEXICON = 300, 8, 24, 8000
BUCKETS, FOLDS = 1 << 16, 5
#: Bytes of text and languages whose scores are held at once.
TEXT_BYTES, LANGUAGES_A_BLOCK = 1 << 20, 8
AFFIXES = (1, 2, 3, 4)
_TAGS = mix(np.arange(1, 32, dtype=np.uint64))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo ``FOLDS``; 0 is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(48)).astype(np.int64)


class Observed:
    """Words of a chunk with what their features are read from."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        self.buf, self.words, self.prefix = buf, Words(buf, offs, LETTER), Prefix(buf)
        self.hash = self.prefix.span(self.words.start, self.words.end)

    def affixes(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(word, bucket) of each kind of beginning and ending; every word of sufficient length has one."""
        w = self.words
        size = w.end - w.start
        for n in AFFIXES:
            at = np.flatnonzero(size >= n)
            yield at, _bucket(mix(self.prefix.span(w.start[at], w.start[at] + n) ^ _TAGS[n]))
            yield at, _bucket(mix(self.prefix.span(w.end[at] - n, w.end[at]) ^ _TAGS[n + 8]))

    def grams(self) -> Iterator[tuple[int, np.ndarray]]:
        """(n, bucket of the n bytes at each place)."""
        b = self.buf.astype(np.uint64)
        for n in (2, 3):
            x = b[: len(b) - n + 1].copy() if len(b) >= n else np.zeros(0, np.uint64)
            for j in range(1, n):
                x = x << np.uint64(8) | b[j : len(b) - n + 1 + j]
            yield n, _bucket((x + np.uint64(n << 24)) * _TAGS[20])

    def emissions(self, weights: np.ndarray, lexicon: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Language scores of each word."""
        w = self.words
        out = np.zeros((len(w.start), weights.shape[1]), np.float32)
        for at, bucket in self.affixes():
            if len(at) == len(out):
                out += weights[bucket]
            else:
                out[at] += weights[bucket]
        for n, bucket in self.grams():
            m = len(bucket)
            last, first = np.minimum(np.maximum(w.end - n + 1, w.start), m), np.minimum(w.start, m)
            for k in range(0, weights.shape[1], LANGUAGES_A_BLOCK):
                part = weights[:, k : k + LANGUAGES_A_BLOCK]
                along = np.zeros((m + 1, part.shape[1]))
                np.cumsum(part[bucket], axis=0, dtype=np.float64, out=along[1:])
                out[:, k : k + LANGUAGES_A_BLOCK] += along[last] - along[first]
        if len(known):
            k = np.minimum(np.searchsorted(known, self.hash), len(known) - 1)
            at = np.flatnonzero(known[k] == self.hash)
            out[at] += lexicon[k[at]]
        return out


def forward_backward(score: np.ndarray, start: np.ndarray, length: np.ndarray, trans: np.ndarray, pairs: bool = False):
    """(probabilities of each word's labels, log-likelihood normaliser, expected transitions).

    Chains advance in step, longest first, so each step is a few operations on all of them.
    """
    n, m = score.shape
    top = score.max(axis=1, keepdims=True) if n else score
    e = np.exp(score - top)
    t = np.exp(trans)
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    alpha, scale = np.zeros_like(e), np.ones(n)
    steps = int(length[0]) if len(length) else 0
    active = np.searchsorted(-length, -np.arange(steps), side="left")  # chains longer than t
    for i in range(steps):
        at = start[: active[i]] + i
        a = e[at] if i == 0 else (alpha[at - 1] @ t) * e[at]
        c = a.sum(axis=1)
        scale[at] = c
        alpha[at] = a / c[:, None]
    beta = np.ones_like(e)
    expected = np.zeros((m, m))
    for i in range(steps - 1, 0, -1):
        at = start[: active[i]] + i
        x = e[at] * beta[at] / scale[at][:, None]
        beta[at - 1] = x @ t.T
        if pairs:
            expected += (alpha[at - 1].T @ x) * t
    norm = float(np.log(scale).sum() + top.sum())
    gamma = alpha * beta
    return gamma / np.maximum(gamma.sum(axis=1, keepdims=True), 1e-30), norm, expected


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # [bucket, language]
    lexicon: np.ndarray  # [known word, language]
    known: np.ndarray  # hashes, sorted
    trans: np.ndarray  # [from, to]


def fit_chains(texts: list[str], labels: np.ndarray, languages: list[str], rounds: int = 60, decay: float = 1e-5, rate: float = 0.15) -> Model:
    """Maximum likelihood on chains of three segments, by Adam on forward-backward's gradient."""
    m = len(languages)
    order = np.random.default_rng(7).permutation(len(texts))
    buf = np.frombuffer("\n".join(texts[i] for i in order).encode(), np.uint8)
    seen = Observed(buf, np.array([0, len(buf)]))
    breaks = np.flatnonzero(buf == 10)
    segment = np.searchsorted(breaks, seen.words.start)
    y = labels[order][segment]
    first = np.searchsorted(segment, np.arange(0, len(texts), 3))
    length = np.diff(np.append(first, len(segment)))
    first, length = first[length > 0], length[length > 0]
    vocabulary, one, inverse, count = np.unique(seen.hash, return_index=True, return_inverse=True, return_counts=True)
    word = b" ".join(buf[s:e].tobytes() for s, e in zip(seen.words.start[one], seen.words.end[one]))
    unique = Observed(np.frombuffer(word, np.uint8), np.array([0, len(word)]))
    rows, cols = [np.concatenate(x) for x in zip(*unique.affixes())]
    for n, bucket in unique.grams():
        w = np.searchsorted(unique.words.start, np.arange(len(bucket)), side="right") - 1
        ok = np.arange(len(bucket)) + n <= unique.words.end[w]
        rows, cols = np.append(rows, w[ok]), np.append(cols, bucket[ok])
    frequent = np.sort(np.argsort(-count, kind="stable")[:LEXICON])
    frequent = frequent[count[frequent] > 1]
    used, cols = np.unique(cols, return_inverse=True)
    by_row, by_col = np.argsort(rows, kind="stable"), np.argsort(cols, kind="stable")
    row_cut, col_cut = np.searchsorted(rows[by_row], np.arange(len(vocabulary))), np.searchsorted(cols[by_col], np.arange(len(used)))
    tokens = np.argsort(inverse, kind="stable")
    token_cut = np.searchsorted(inverse[tokens], np.arange(len(vocabulary)))
    gold = np.eye(m, dtype=np.float32)[y]
    same = np.ones(len(y), bool)
    same[first] = False
    pairs = np.zeros((m, m))
    np.add.at(pairs, (y[:-1][same[1:]], y[1:][same[1:]]), 1)
    params = [np.zeros((len(used), m), np.float32), np.zeros((len(frequent), m), np.float32), np.zeros((m, m), np.float32)]
    moment = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for step in range(1, rounds + 1):
        w, lex, trans = params
        score = np.add.reduceat(w[cols[by_row]], row_cut, axis=0)
        score[frequent] += lex
        gamma, _, expected = forward_backward(score[inverse].astype(np.float64), first, length, trans.astype(np.float64), True)
        g = np.add.reduceat((gamma - gold).astype(np.float32)[tokens], token_cut, axis=0)
        grads = [np.add.reduceat(g[rows[by_col]], col_cut, axis=0), g[frequent], (expected - pairs).astype(np.float32)]
        for p, d, (a, b) in zip(params, grads, moment):
            d = d / len(y) + decay * p
            a += 0.1 * (d - a)
            b += 0.01 * (d * d - b)
            p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-7)
    weights = np.zeros((BUCKETS, m), np.float32)
    weights[used] = params[0]
    return Model(languages, weights, params[1], vocabulary[frequent], params[2].astype(np.float64))


def fit(docs: DataFrame, per_language: int = DOCUMENTS_A_LANGUAGE) -> Model:
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text", "lang").where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (fold(F.col("doc_id")) != 0) & F.col("text").rlike(r"\p{L}"))
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}  # a row a language
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((0, 0), np.float32), np.zeros(0, np.uint64), np.zeros((0, 0)))
    share = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, per_language / counts[k])))])
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for d, text, lang in zip(*(c.to_pylist() for c in b.columns)):
                raw = text.encode()
                a = np.frombuffer(raw, np.uint8)
                w = Words(a, np.array([0, len(a)]), LETTER)
                n = len(w.start)
                for k, f in enumerate(np.unique(np.linspace(0, max(n - SEGMENT_WORDS, 0), SEGMENTS).astype(int) // SEGMENT_WORDS * SEGMENT_WORDS) if n else ()):
                    z = min(f + SEGMENT_WORDS, n)
                    out.append((d, k, " ".join(raw[s:e].decode() for s, e in zip(w.start[f:z], w.end[f:z])), lang))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, (pa.int64(), pa.int32(), pa.string(), pa.string()))], names=["doc_id", "k", "words", "lang"])

    chosen = rows.where(draw < F.coalesce(F.element_at(share, F.col("lang")), F.lit(0.0))).select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text"), "lang")
    got = sorted(map(tuple, chosen.mapInArrow(run, "doc_id long, k int, words string, lang string").collect()))
    at = {k: i for i, k in enumerate(languages)}
    if not got:
        return Model(languages, np.zeros((BUCKETS, len(languages)), np.float32), np.zeros((0, len(languages)), np.float32), np.zeros(0, np.uint64), np.zeros((len(languages),) * 2))
    return fit_chains([g[2] for g in got], np.array([at[g[3]] for g in got]), languages)


def chains(buf: np.ndarray, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """First word and length of each chain, a line of a document."""
    n = len(w.start)
    line = np.searchsorted(np.flatnonzero(buf == 10), w.start)
    new = np.ones(n, bool)
    new[1:] = (line[1:] != line[:-1]) | (w.doc[1:] != w.doc[:-1])
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, n))


def chunk_bytes(model: Model) -> int:
    """Many chains advance together, but fewer the more languages there are."""
    return max(1 << 16, TEXT_BYTES * LANGUAGES_A_BLOCK // max(len(model.languages), LANGUAGES_A_BLOCK))


def _probabilities(model: Model, buf: np.ndarray, offs: np.ndarray) -> tuple[Words, np.ndarray]:
    seen = Observed(buf, offs)
    score = seen.emissions(model.weights, model.lexicon, model.known)
    gamma, _, _ = forward_backward(score, *chains(buf, seen.words), model.trans.astype(np.float32))
    return seen.words, gamma


def _rows(docs: DataFrame) -> DataFrame:
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id")) == 0).alias("held_out"), F.when(letters, F.lower("text")).alias("text"))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score (expected share of words in that language), n_words."""
    names = np.array([*model.languages, "und"], dtype=object)
    m = len(model.languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pred, score, words = [], [], []
            for i, j, buf, offs in chunks(b.column(2), chunk_bytes(model)):
                if not m:
                    pred.append(np.zeros(j - i, int)), score.append(np.zeros(j - i)), words.append(np.zeros(j - i, int))
                    continue
                w, gamma = _probabilities(model, buf, offs)
                total = np.stack([np.bincount(w.doc, weights=gamma[:, k], minlength=j - i) for k in range(m)], axis=1)
                share = np.clip(total / np.maximum(w.count, 1)[:, None], 0, 1)
                best = share.argmax(axis=1)
                pred.append(np.where(w.count > 0, best, m))
                score.append(np.where(w.count > 0, share[np.arange(j - i), best], 0.0))
                words.append(w.count)
            cat = lambda v, t: np.concatenate(v) if v else np.zeros(0, t)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names[cat(pred, int)], pa.string()), pa.array(cat(score, float)), pa.array(cat(words, int).astype(np.int64))], names=["doc_id", "held_out", "lang_pred", "score", "n_words"])

    return _rows(docs).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, n_words long")


def label_words(docs: DataFrame, model: Model) -> DataFrame:
    """Runs of words of one language: doc_id, first_word, n_words, lang, confidence (mean probability)."""
    names = np.array(model.languages, dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, buf, offs in chunks(b.column(2), chunk_bytes(model)):
                w, gamma = _probabilities(model, buf, offs)
                best = gamma.argmax(axis=1)
                new = np.ones(len(best), bool)
                new[1:] = (best[1:] != best[:-1]) | (w.doc[1:] != w.doc[:-1])
                at = np.flatnonzero(new)
                n = np.diff(np.append(at, len(best)))
                sure = np.add.reduceat(gamma.max(axis=1), at) / n if len(at) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i).take(pa.array(w.doc[at])), pa.array(at - w.first[w.doc[at]]), pa.array(n), pa.array(names[best[at]], pa.string()), pa.array(sure.astype(float))], names=["doc_id", "first_word", "n_words", "lang", "confidence"])

    return _rows(docs).mapInArrow(run if model.languages else lambda _: iter(()), "doc_id long, first_word long, n_words long, lang string, confidence double")


def predict(docs: DataFrame) -> DataFrame:
    return identify(docs, fit(docs))
