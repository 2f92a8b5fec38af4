"""Substring dedup of paragraphs by MinHash banding.

A paragraph is a line with at least ``min_words`` words (runs of letters, A-Z lower-cased, so that
dates and punctuation don't make a new text). Equal word sequences are one class by their 64-bit
hash. In each band of their MinHash signature over 3-word shingles, colliding classes are joined to the
band's least class and verified by the exact Jaccard index of their shingle sets; classes of one band that this
left in different components are then paired with each other, so the components are those of all pairs, which
aren't listed. In each cluster the first paragraph by (doc_id, place) stays and the others go.
``tune_bands`` picks the fewest bands that find a pair at the threshold with the wanted recall.

A passage may also stand inside lines that differ otherwise, or run over line breaks. So every window of
``MIN_RUN`` words of a document, where a line break is white space like any other, goes if the same
words stand at an earlier place outside the lines that went. Each window names a seed in it (its run of
``SEED`` words with the least hash); only windows whose seed occurs in another text are compared, and equal
windows have equal seeds, so none is missed. A window that only arises where a passage was cut out isn't looked for.

What one document repeats within itself only is no passage shared by documents and is left alone.

Equal texts are looked at once, by their hash; their rows meet the result at the end.

Defined results: null, empty and short texts have no paragraph to remove; a text of ``MIN_RUN`` words that has
copies goes whole from all rows but the first, and of equal rows only one keeps it; a null doc_id sorts last; an
empty table gives no rows; other columns are ignored (``deduplicated`` keeps them and drops documents left without text).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from fathomrank.llm.kernels import LETTER, LOWER, Prefix, Words, chunks, grams, mix, powers
from fathomrank.shared import connected_components, deal, gathered, join_by_class, parts_of, release, sieve, write_table

MIN_WORDS, THRESHOLD, RECALL, SHINGLE = 30, 0.7, 0.97, 3
#: The fewest words of a run that counts; words of a seed.
MIN_RUN, SEED = 20, 10
PAIRS = 256  # pairs whose shingle sets are held at once
LETTERS = 20  # code points of a text for each seed, about; only the number of parts depends on it
WORD = re.compile(rb"[A-Za-z\x80-\xff]+")


def tune_bands(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = 4) -> tuple[int, int]:
    """(bands, rows): the fewest bands of ``rows`` values that meet a pair at ``threshold`` with probability ``recall``."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows))), rows


def _multipliers(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _lines(buf: np.ndarray, offs: np.ndarray, min_words: int):
    """Word hashes of a chunk, its long lines (doc, number, begin, end, first and end word), code points before each byte."""
    low = LOWER[buf]
    words = Words(low, offs, LETTER)
    h = Prefix(low).span(words.start, words.end)
    breaks = np.flatnonzero(buf == 10)
    doc_of = np.searchsorted(offs, breaks, side="right") - 1
    begin = np.concatenate([offs[:-1], breaks + 1])
    doc = np.concatenate([np.arange(len(offs) - 1), doc_of])
    order = np.lexsort((begin, doc))
    begin, doc = begin[order], doc[order]
    last = np.append(doc[1:] != doc[:-1], True)
    end = np.where(last, offs[doc + 1], np.append(begin[1:] - 1, len(buf)))
    number = np.arange(len(doc)) - np.searchsorted(doc, doc)
    w0, w1 = np.searchsorted(words.start, begin), np.searchsorted(words.start, end)
    keep = w1 - w0 >= max(min_words, SHINGLE)
    begin, end, doc, number, w0, w1 = (x[keep] for x in (begin, end, doc, number, w0, w1))
    chars = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=chars[1:])
    return h, words, doc, number, begin, end, w0, w1, chars


def _along(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums that hash any run of words."""
    r, inv = powers(len(h))
    along = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * r[: len(h)], out=along[1:])
    return along, inv


def places(buf: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """The words of a chunk: hash h, doc, word (number in the document), paragraph (line number), start and end (code points)."""
    low = LOWER[buf]
    words = Words(low, offs, LETTER)
    chars = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=chars[1:])
    breaks = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(buf == 10, out=breaks[1:])
    begin = offs[words.doc]
    return {
        "h": Prefix(low).span(words.start, words.end), "doc": words.doc, "word": np.arange(len(words.start)) - words.first[words.doc],
        "paragraph": breaks[words.start] - breaks[begin], "start": chars[words.start] - chars[begin], "end": chars[words.end] - chars[begin],
    }


def windows_of(p: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word of each window of MIN_RUN words inside a document, first word of its seed, hashes of the seeds at all words).

    The seed is the first of the window's runs of SEED words with the least hash, so equal windows have equal seeds.
    """
    g = grams(p["h"], SEED)
    n = len(p["h"]) - MIN_RUN + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), g
    at = np.flatnonzero(p["doc"][:n] == p["doc"][MIN_RUN - 1 :])
    least = np.lib.stride_tricks.sliding_window_view(g, MIN_RUN - SEED + 1).argmin(axis=1)
    return at, at + least[at], g


def scan(buf: np.ndarray, offs: np.ndarray, min_words: int, bands: int, rows: int) -> dict[str, np.ndarray]:
    """The paragraphs of a chunk: doc, paragraph, start, length (code points), n_words, cid, bands."""
    h, _, doc, number, begin, end, w0, w1, chars = _lines(buf, offs, min_words)
    along, inv = _along(h)
    cid = mix((along[w1] - along[w0]) * inv[w0] + (w1 - w0).astype(np.uint64))
    sig = np.zeros((len(doc), bands), np.uint64)
    if len(doc):
        g = np.append(grams(h, SHINGLE), np.uint64(0))
        cuts = np.column_stack([w0, w1 - SHINGLE + 1]).ravel()
        for b in range(bands):
            for k, a in enumerate(_multipliers(bands * rows)[b * rows : (b + 1) * rows]):
                sig[:, b] = mix(sig[:, b] * np.uint64(31) + np.minimum.reduceat(g * a, cuts)[::2])
            sig[:, b] = mix(sig[:, b] + np.uint64(b))
    base = chars[offs[doc]]
    return {"doc": doc, "paragraph": number, "start": chars[begin] - base, "length": chars[end] - chars[begin], "n_words": w1 - w0, "cid": cid.view(np.int64), "bands": sig.view(np.int64), "from": begin, "to": end}


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("thash"), "text")


def _once(b: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray]:
    """The distinct texts of a batch (doc_id, thash, ...), each under its least doc_id, and the number of rows of each."""
    t, null = b.column(1).to_numpy(zero_copy_only=False), b.column(0).is_null().to_numpy(zero_copy_only=False)
    order = np.lexsort((b.column(0).fill_null(0).to_numpy(zero_copy_only=False), null, t))
    first = np.flatnonzero(np.append(True, t[order][1:] != t[order][:-1])) if len(t) else np.zeros(0, np.int64)
    at, n = order[first], np.diff(np.append(first, len(t)))
    rows = np.argsort(at)
    return (b if len(at) == len(t) else b.take(pa.array(at[rows]))), n[rows]


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(values))


PARAGRAPH = "doc_id long, thash long, rows int, again boolean, paragraph int, start int, length int, n_words int, cid long"


def paragraphs(docs: DataFrame, min_words: int, bands: int, rows: int) -> DataFrame:
    """The long lines of the distinct texts, again where the text has had that class already; paragraph -1 is a whole text of MIN_RUN words."""
    names = [x.split()[0] for x in PARAGRAPH.split(", ")] + ["bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, n in map(_once, batches):
            for i, j, buf, offs in chunks(b.column(2)):
                p, t = scan(buf, offs, min_words, bands, rows), whole_texts(buf, offs)
                at = np.append(p["doc"], t["doc"])
                order = np.lexsort((p["paragraph"], p["cid"], p["doc"]))
                again = np.zeros(len(at), bool)
                again[order[1:]] = (p["doc"][order][1:] == p["doc"][order][:-1]) & (p["cid"][order][1:] == p["cid"][order][:-1])
                both = [pa.array(np.append(p[c], t[c]).astype(np.int32)) for c in ("paragraph", "start", "length", "n_words")]
                place = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i).take(place), b.column(1).slice(i, j - i).take(place), pa.array(n[i:j][at].astype(np.int32)), pa.array(again), *both, pa.array(np.append(p["cid"], t["cid"])), _lists(p["bands"].ravel(), np.append(np.full(len(p["doc"]), bands), np.zeros(len(t["doc"]), int)))],
                    names=names,
                )

    return _source(docs).mapInArrow(run, PARAGRAPH + ", bands array<long>")


def whole_texts(buf: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """The texts of MIN_RUN words of a chunk as one paragraph each, number -1."""
    p = places(buf, offs)
    first = np.searchsorted(p["doc"], np.arange(len(offs)))
    doc = np.flatnonzero(np.diff(first) >= MIN_RUN)
    a, z = first[doc], first[doc + 1] - 1
    along, inv = _along(p["h"])
    cid = mix((along[z + 1] - along[a]) * inv[a]).view(np.int64)
    return {"doc": doc, "paragraph": np.full(len(doc), -1), "start": p["start"][a], "length": p["end"][z] - p["start"][a], "n_words": z - a + 1, "cid": cid}


def _groups(key: np.ndarray) -> np.ndarray:
    """Where groups of equal values begin in a sorted key."""
    return np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])


def seeds(docs: DataFrame, parts: int) -> DataFrame:
    """For each distinct text (thash) the words at which a seed begins that another text has too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        for b, _ in map(_once, batches):
            of = b.column(1).to_numpy(zero_copy_only=False)
            for i, j, buf, offs in chunks(b.column(2)):
                p = places(buf, offs)
                _, seed, g = windows_of(p)
                seed = np.unique(seed)
                yield [g[seed], of[i:j][p["doc"][seed]], p["word"][seed].astype(np.int32)]

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        seed, text, word = gathered(batches, np.uint64, np.int64, np.int32)
        if len(seed):
            order = np.argsort(seed)
            seed, text, word = seed[order], text[order], word[order]
            at = _groups(seed)
            keep = np.repeat(np.minimum.reduceat(text, at) < np.maximum.reduceat(text, at), np.diff(np.append(at, len(seed))))
            yield [text[keep], word[keep]]

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, word = gathered(batches, np.int64, np.int32)
        order = np.lexsort((word, text))
        text, word = text[order], word[order]
        new = np.append(True, (text[1:] != text[:-1]) | (word[1:] != word[:-1]))[: len(text)]  # equal texts of several tasks
        text, word = text[new], word[new]
        at = _groups(text)
        yield pa.RecordBatch.from_arrays([pa.array(text[at]), _lists(word, np.diff(np.append(at, len(text))))], names=["thash", "seeds"])

    return deal(deal(_source(docs), run, parts, 3), shared, parts, 2).mapInArrow(listed, "thash long, seeds array<int>")


def windows(texts: DataFrame, parts: int) -> DataFrame:
    """Blocks of the windows at the marked seeds of texts (doc_id, thash, text, seeds, gone) that have a word outside the lines in gone.

    Columns: hash, doc_id, its absence, thash, word, paragraph, start, length, whole (no word lies in those lines).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        for b in batches:
            ids, null = b.column(0).fill_null(0).to_numpy(zero_copy_only=False), b.column(0).is_null().to_numpy(zero_copy_only=False)
            text = b.column(1).to_numpy(zero_copy_only=False)
            for i, j, buf, offs in chunks(b.column(2)):
                p = places(buf, offs)
                at, seed, _ = windows_of(p)
                first = np.searchsorted(p["doc"], np.arange(j - i + 1))
                hit, out = np.zeros(len(p["h"]), bool), np.zeros(len(p["h"]), bool)
                for d in range(j - i):
                    wanted, gone = b.column(3)[i + d].values, b.column(4)[i + d].values
                    hit[first[d] + wanted.to_numpy()] = True
                    if gone is not None and len(gone):
                        out[first[d] : first[d + 1]] = np.isin(p["paragraph"][first[d] : first[d + 1]], gone.to_numpy())
                lost = np.concatenate([[0], np.cumsum(out)])
                at = at[hit[seed] & (lost[at + MIN_RUN] - lost[at] < MIN_RUN)]
                along, inv = _along(p["h"])
                h = mix((along[at + MIN_RUN] - along[at]) * inv[at])
                doc = p["doc"][at] + i
                ints = [x.astype(np.int32) for x in (p["word"][at], p["paragraph"][at], p["start"][at], p["end"][at + MIN_RUN - 1] - p["start"][at])]
                yield [h, ids[doc], null[doc], text[doc], *ints, lost[at + MIN_RUN] == lost[at]]

    return deal(texts.select("doc_id", "thash", "text", "seeds", "gone"), run, parts, 9)


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Of the windows that several texts have, the first whole one, which stays, and those at later places."""
    h, doc, null, text, word, paragraph, start, length, whole = gathered(batches, np.uint64, np.int64, bool, np.int64, np.int32, np.int32, np.int32, np.int32, bool)
    if not len(h):
        return
    order = np.argsort(h)
    at = _groups(h[order])
    several = np.minimum.reduceat(text[order], at) < np.maximum.reduceat(text[order], at)
    order = order[np.repeat(several, np.diff(np.append(at, len(h))))]
    if not len(order):
        return
    order = order[np.lexsort((word[order], text[order], doc[order], null[order], h[order]))]  # groups in order of places
    at = _groups(h[order])
    place = np.arange(len(order))
    first = np.minimum.reduceat(np.where(whole[order], place, len(order)), at)
    first = np.repeat(first, np.diff(np.append(at, len(order))))
    keep = place >= first
    order, stays, first = order[keep], (place == first)[keep], order[first[keep]]
    yield [text[order], word[order], paragraph[order], start[order], length[order], h[order], stays, doc[first], null[first]]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of ``_repeats`` as the runs of words that they cover, in the columns ``SPAN``."""
    columns = gathered(batches, np.int64, np.int32, np.int32, np.int32, np.int32, np.uint64, bool, np.int64, bool)
    order = np.lexsort((columns[1], columns[6], columns[0]))
    text, word, paragraph, start, length, h, stays, doc, null = (c[order] for c in columns)
    if len(text):
        at = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (stays[1:] != stays[:-1]) | (word[1:] - word[:-1] > 1)))
        last = np.append(at[1:], len(text)) - 1
        begin, end = np.minimum.reduceat(start, at), np.maximum.reduceat(start + length, at)
        yield pa.RecordBatch.from_arrays(
            [pa.array(text[at]), pa.array(paragraph[at]), pa.array(begin), pa.array(end - begin), pa.array((word[last] - word[at] + MIN_RUN).astype(np.int32)), pa.array(h[at].view(np.int64)), pa.array(stays[at]), pa.array(doc[at], mask=null[at]), pa.array(np.zeros(len(at), bool))],
            names=list(SPAN),
        )


SPAN = ("thash", "paragraph", "start", "length", "n_words", "cluster_id", "stays", "keeper_doc_id", "whole")


def _place(*more: str) -> Column:
    """The order of places: null ids sort last; no field is null, so places compare as a whole."""
    return F.struct(F.col("doc_id").isNull().alias("x"), F.coalesce("doc_id", F.lit(0)).alias("d"), "thash", *more)


def _id(place: str) -> Column:
    return F.expr(f"if({place}.x, null, {place}.d)")


def passages(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Runs of at least MIN_RUN words that another text has, in the columns ``SPAN``.

    A window stays where it stands first outside the lines in ``gone`` (thash, paragraph) and goes at every
    later place. So what a removed word repeats stands earlier, and the first such place is never removed.
    """
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = parts_of(docs.sparkSession, chars // LETTERS)
    hits = write_table(seeds(docs, parts), "substring-hits")
    marked = gone.groupBy("thash").agg(F.collect_list("paragraph").alias("gone"))
    texts = _source(docs).where(sieve(hits, "thash")(F.col("thash"))).groupBy("thash").agg(F.min("doc_id").alias("doc_id"), F.any_value("text").alias("text"))
    found = windows(texts.join(hits, "thash").join(marked, "thash", "left"), parts)
    runs = write_table(deal(found, _repeats, parts, 9).mapInArrow(_runs, "thash long, paragraph int, start int, length int, n_words int, cluster_id long, stays boolean, keeper_doc_id long, whole boolean"), "substring-runs")
    release(hits)
    return runs


def _sets(docs: DataFrame, min_words: int, wanted) -> DataFrame:
    """cid and shingle hashes, each once, of the paragraphs whose class ``wanted`` lets pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, _ in map(_once, batches):
            for _, _, buf, offs in chunks(b.column(2)):
                h, _, _, _, _, _, w0, w1, _ = _lines(buf, offs, min_words)
                along, inv = _along(h)
                cid, at = np.unique(mix((along[w1] - along[w0]) * inv[w0] + (w1 - w0).astype(np.uint64)).view(np.int64), return_index=True)
                take = wanted.passes(cid)
                g = grams(h, SHINGLE)
                sets = [np.unique(g[a : z - SHINGLE + 1]) for a, z in zip(w0[at[take]], w1[at[take]])]
                yield pa.RecordBatch.from_arrays([pa.array(cid[take]), _lists(np.concatenate(sets or [g[:0]]).view(np.int64), np.array([len(x) for x in sets], int))], names=["cid", "shingles"])

    return _source(docs).mapInArrow(run, "cid long, shingles array<long>").groupBy("cid").agg(F.any_value("shingles").alias("shingles"))


def shingles(line: bytes) -> set[tuple[bytes, ...]]:
    w = WORD.findall(line.lower())
    return {tuple(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)}


def overlaps(x: pa.ListArray, y: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(size of the intersection, size of the union) of the sets in each row; pairs are sorted together."""
    sizes = [np.diff(c.offsets.to_numpy()) for c in (x, y)]
    pair = np.concatenate([np.repeat(np.arange(len(x)), n) for n in sizes])
    h = np.concatenate([c.flatten().to_numpy(zero_copy_only=False).view(np.uint64) for c in (x, y)])
    h = mix(h + mix(pair.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(h)
    both = np.bincount(pair[order[:-1][h[order][1:] == h[order][:-1]]], minlength=len(x))
    return both, sizes[0] + sizes[1] - both


def _verified(pairs: DataFrame, threshold: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(i, PAIRS) for whole in batches for i in range(0, whole.num_rows, PAIRS)):
            both, union = overlaps(b.column(2), b.column(3))
            good = pa.array(np.flatnonzero(both >= threshold * union))
            yield pa.RecordBatch.from_arrays([b.column(0).take(good), b.column(1).take(good)], names=["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def _linked(docs: DataFrame, pairs: DataFrame, min_words: int, threshold: float) -> DataFrame:
    """The links among pairs a, b; b may be the same in many."""
    wanted = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).distinct()
    sets = write_table(_sets(docs, min_words, sieve(wanted, "cid")), "substring-sets")
    other = pairs.groupBy("b").agg(F.count("*").alias("n")).join(sets.select(F.col("cid").alias("b"), F.col("shingles").alias("y")), "b")
    left = pairs.join(sets.select(F.col("cid").alias("a"), F.col("shingles").alias("x")), "a")
    links = write_table(_verified(join_by_class(left, other, "b", "n", pairs.count()).select("a", "b", "x", "y"), threshold), "substring-links")
    release(sets)
    return links


def _rest(index: DataFrame, roots: DataFrame, met: DataFrame) -> DataFrame:
    """Pairs of classes that share a band and are in different components, but for those in ``met``.

    A band's commonest component meets only the band's other classes, so a large group isn't paired with itself.
    """
    rooted = index.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    split = rooted.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("band")
    rooted = write_table(rooted.join(split, "band"), "substring-split")
    main = rooted.groupBy("band", "root").agg(F.count("*").alias("n")).groupBy("band").agg(F.max_by("root", "n").alias("main"))
    rooted = rooted.join(main, "band")
    stray = rooted.where("root <> main").select("band", F.col("cid").alias("x"), F.col("root").alias("xr"))
    pairs = stray.join(rooted.select("band", F.col("cid").alias("y"), F.col("root").alias("yr"), "main"), "band").where("xr <> yr and (yr = main or x < y)")
    pairs = pairs.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
    return write_table(pairs.join(met, ["a", "b"], "left_anti"), "substring-rest")


def _bands(every: DataFrame) -> DataFrame:
    """band, cid and b, the band's least class, for the bands of several classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        for b in batches:
            for part in (b.slice(i, 10_000) for i in range(0, b.num_rows, 10_000)):
                sizes = np.diff(part.column(1).offsets.to_numpy())
                yield [part.column(1).flatten().to_numpy(zero_copy_only=False), np.repeat(part.column(0).to_numpy(zero_copy_only=False), sizes)]

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band, cid = gathered(batches, np.int64, np.int64)
        order = np.lexsort((cid, band))
        band, cid = band[order], cid[order]
        new = np.append(True, (band[1:] != band[:-1]) | (cid[1:] != cid[:-1]))[: len(band)]
        band, cid = band[new], cid[new]
        at = _groups(band)
        sizes = np.diff(np.append(at, len(band)))
        keep = np.repeat(sizes > 1, sizes)
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (band, cid, np.repeat(cid[at], sizes))], names=["band", "cid", "b"])

    records = every.agg(F.sum(F.size("bands"))).first()[0] or 0
    return deal(every.select("cid", "bands"), run, parts_of(every.sparkSession, records), 2).mapInArrow(met, "band long, cid long, b long")


def similar_classes(docs: DataFrame, every: DataFrame, min_words: int, threshold: float) -> DataFrame:
    """(node, root) of the linked paragraph classes of ``every`` (cid, bands)."""
    index = write_table(_bands(every), "substring-index")
    met = write_table(index.where("cid <> b").select(F.col("cid").alias("a"), "b").distinct(), "substring-met")
    links = _linked(docs, met, min_words, threshold)
    roots = connected_components(links, "substring-components")
    rest = _rest(index.select("band", "cid"), roots, met)
    if not rest.isEmpty():
        release(roots)
        roots = connected_components(links.unionByName(_linked(docs, rest, min_words, threshold)), "substring-components")
    release(index, met, links, rest)
    return roots


def _line_spans(docs: DataFrame, every: DataFrame, min_words: int, threshold: float) -> DataFrame:
    """The lines that occur in more than one document, in the columns ``SPAN``; ``every`` has the paragraphs."""
    lines = every.where("paragraph >= 0")
    roots = similar_classes(docs, lines, min_words, threshold)
    # documents: rows, where a text's later lines of the class don't count
    classes = lines.groupBy("cid").agg(F.sum("rows").alias("n"), F.sum(F.when(~F.col("again"), F.col("rows"))).alias("documents"), F.min("thash").alias("lo"), F.max("thash").alias("hi"), F.min(_place("paragraph")).alias("first"))
    rooted = write_table(classes.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid")), "substring-classes")
    clusters = rooted.groupBy("root").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("documents").alias("documents"), F.min("first").alias("keeper")).where("lo < hi or documents > 1")
    marked = write_table(rooted.select("cid", "n", "root").join(clusters.select("root", "keeper"), "root"), "substring-marked")
    spans = join_by_class(lines.where(sieve(marked, "cid")(F.col("cid"))), marked, "cid", "n", lines.count())
    stays = (F.col("keeper.thash") == F.col("thash")) & (F.col("keeper.paragraph") == F.col("paragraph"))
    spans = spans.select("thash", "paragraph", "start", "length", "n_words", F.col("root").alias("cluster_id"), stays.alias("stays"), _id("keeper").alias("keeper_doc_id"), F.lit(True).alias("whole"))
    spans = write_table(spans.dropDuplicates(["thash", "paragraph"]), "substring-lines")
    release(rooted, marked, roots)
    return spans


def _texts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a row for equal rows of a task: doc_id, thash, part, rows; one for each text: thash, n, first)."""
    rows = _source(docs).groupBy("doc_id", "thash", F.spark_partition_id().alias("part")).agg(F.count("*").alias("rows"))
    rows = write_table(rows, "substring-rows")
    return rows, rows.groupBy("thash").agg(F.sum("rows").alias("n"), F.min(_place("part")).alias("first"))


def _occurrences(rows: DataFrame, texts: DataFrame, spans: DataFrame) -> DataFrame:
    """The spans of texts at every row that has the text; one that stays does so at the text's first row."""
    of = spans.groupBy("thash").agg(F.collect_list(F.struct(*SPAN[1:])).alias("spans"))  # of one text
    of = write_table(of.join(texts, "thash"), "substring-spans")
    at = join_by_class(rows.where(sieve(of, "thash")(F.col("thash"))), of, "thash", "n", rows.count())
    at = at.select("*", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("i"), F.expr("first.x = (doc_id is null) and first.d = coalesce(doc_id, 0) and first.part = part").alias("one"))
    return at.select("doc_id", "thash", (F.col("one") & (F.col("i") == 1)).alias("one"), F.explode("spans").alias("s")).select(
        "doc_id", "thash", "s.paragraph", F.col("s.start").cast("long").alias("start"), F.col("s.length").cast("long").alias("length"), "s.n_words", "s.cluster_id", (F.col("one") & F.col("s.stays")).alias("keep"), "s.keeper_doc_id", "s.whole"
    )


def _found(docs: DataFrame, min_words: int, threshold: float, recall: float) -> tuple[DataFrame, DataFrame]:
    bands, rows = tune_bands(threshold, recall)
    every = write_table(paragraphs(docs, min_words, bands, rows), "substring-paragraphs")
    return every, _line_spans(docs, every, min_words, threshold)


def _copies(every: DataFrame, texts: DataFrame) -> DataFrame:
    """Texts of MIN_RUN words that stand in several rows, as spans: the whole text stays at its first row."""
    many = texts.where("n > 1")
    whole = every.where("paragraph < 0").dropDuplicates(["thash"]).join(many, "thash")
    return whole.select("thash", F.lit(0).alias("paragraph"), "start", "length", "n_words", F.col("cid").alias("cluster_id"), F.lit(True).alias("stays"), _id("first").alias("keeper_doc_id"), F.lit(False).alias("whole"))


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """The lines that occur in more than one document: one row an occurrence.

    Columns: doc_id, thash, paragraph (line number), start and length in code points, n_words,
    cluster_id, keep (the first of its cluster), keeper_doc_id, whole (here always).
    """
    _, lines = _found(docs, min_words, threshold, recall)
    return _occurrences(*_texts(docs), lines)


def repeated(docs: DataFrame, min_words: int = MIN_WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """The passages that occur in more than one document, whole lines, runs of words and whole texts: one row an occurrence.

    The columns are those of ``repeated_lines``; whole says whether the passage is a line. A run has the number of
    the line where it begins and may reach over later lines, also over such as go as whole lines. A text that has copies
    is a run at line 0 too, from its first word to its last. Rows equal in doc_id and text have equal spans; where some
    say keep and some don't, the first of them keeps it.
    """
    every, lines = _found(docs, min_words, threshold, recall)
    rows, texts = _texts(docs)
    copies = write_table(_copies(every, texts), "substring-copies")
    release(every)
    runs = passages(docs, lines.where("not stays"))
    return _occurrences(rows, texts, lines.unionByName(runs).unionByName(copies))


@F.arrow_udf(StringType())
def _without(text: pa.Array, spans: pa.Array) -> pa.Array:
    """Texts without their spans (start, length, whole); a whole line goes with its line break."""

    def one(t: str, cuts) -> str:
        if t is None or cuts is None:
            return t
        out, at = [], 0
        for c in sorted(cuts, key=lambda c: (c["start"], -c["length"])):
            s, e = c["start"], c["start"] + c["length"]
            if c["whole"]:
                e = e + 1 if e < len(t) else e
            else:  # what is attached to its first and last word goes too
                while s > at and not t[s - 1].isspace():
                    s -= 1
                while e < len(t) and not t[e].isspace():
                    e += 1
            out.append(t[at : max(at, s)])
            at = max(at, e)
        kept = "".join(out) + t[at:]
        return kept[:-1] if kept.endswith("\n") and not t.endswith("\n") else kept

    return pa.array([one(t, c) for t, c in zip(text.to_pylist(), spans.to_pylist())], pa.string())


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """The documents without their repeated passages; a copy of an earlier text, or one left blank, is dropped."""
    every, lines = _found(docs, min_words, threshold, recall)
    _, texts = _texts(docs)
    copies = write_table(_copies(every, texts).select("thash", "keeper_doc_id"), "substring-copies")
    release(every)
    runs = passages(docs, lines.where("not stays"))
    cuts = lines.unionByName(runs).where("not stays").groupBy("thash").agg(F.collect_list(F.struct("start", "length", "whole")).alias("cuts"))
    changed = cuts.join(copies.withColumn("copied", F.lit(True)), "thash", "full").join(texts.select("thash", "n"), "thash")
    changed = write_table(changed, "substring-changed")
    # the caller's columns travel in a struct: their names can't clash with these
    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("thash"))
    maybe = sieve(changed, "thash")
    some = packed.where(maybe(F.col("thash")))
    hit = join_by_class(some, changed, "thash", "n", some.count())
    hit = write_table(hit.where("copied is null or doc_id <=> keeper_doc_id"), "substring-hit")  # joined once; one Python step a task
    first = hit.where("copied").withColumn("i", F.row_number().over(Window.partitionBy("thash").orderBy("doc_id"))).where("i = 1").drop("i")
    hit = hit.where("copied is null").unionByName(first)
    # Spark would cut a text for the filter and again for the result, by two Python workers a task
    cut = hit.withColumn("text", _without.asNondeterministic()("text", "cuts")).where(F.col("cuts").isNull() | F.col("text").rlike(r"\S"))
    same = packed.where(~maybe(F.col("thash"))).unionByName(some.join(changed, "thash", "left_anti").select(*packed.columns))
    out = same.select("row", "text").unionByName(cut.select("row", "text"))
    return out.select(*[F.col("text") if c.lower() == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])
