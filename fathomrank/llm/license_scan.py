"""License scans by diagonal voting.

Base phrases are places where a phrase's words stand consecutively. Beyond them, every rolling
word k-gram hash of a text is joined to the positions it has in licence templates; joined rows
vote for the diagonal (place in the text less place in the template), neighbouring diagonals are
merged, so that inserted and dropped words only shift a span, and each merged span is verified by
its word edit distance to the template. The scan drops k-grams that no template has before they
leave Python (a semi-join with a fixed set); the join to positions, votes and merging are Spark's.

Defined results: a null or empty text has no words, no places, empty labels and score 0; repeated
rows are scanned as separate documents; equal labels from several spans count once; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomrank.llm.kernels import ALNUM, LOWER, Prefix, Words, chunks, grams, word_hash
from fathomrank.shared import write_table

PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
K, DRIFT, MIN_VOTES, SIMILARITY, COVERAGE, LONG_SPAN = 3, 3, 2, 0.75, 0.6, 12
#: Wording of public licences and of their usual notices.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and or sell copies of the Software"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"),
    ("lgpl", "This library is free software; you can redistribute it and or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc", "Permission to use, copy, modify, and or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("proprietary", "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher"),
)


def words_of(text: str) -> list[bytes]:
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    low = LOWER[raw]
    w = Words(low, np.array([0, len(low)]), ALNUM)
    flat = low.tobytes()
    return [flat[s:e] for s, e in zip(w.start, w.end)]


def template_grams(templates=TEMPLATES, k: int = K) -> list[tuple[int, int, int]]:
    """(hash, template, position) of every k-gram of the templates: a table of constant size."""
    out = []
    for t, (_, text) in enumerate(templates):
        h = np.array([word_hash(w) for w in words_of(text)], np.uint64)
        out += [(int(g), t, p) for p, g in enumerate(grams(h, k).view(np.int64))]
    return out


_SCAN = "uid long, doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, at array<int>, gram array<long>, body string"


def _scan(docs: DataFrame, phrases: dict[str, str], templates, k: int) -> DataFrame:
    labels = sorted(set(phrases.values()))
    wanted = [([word_hash(w.encode()) for w in p.split()], labels.index(v)) for p, v in phrases.items()]
    known = np.sort(np.array(sorted({g for g, _, _ in template_grams(templates, k)}), np.int64).view(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        few = np.zeros(1 << 16, bool)
        few[(known & np.uint64(0xFFFF)).astype(np.int64)] = True
        uid = TaskContext.get().partitionId() << 40
        for b in batches:
            for i, j, buf, offs in chunks(b.column(1)):
                n = j - i
                low = LOWER[buf]
                w = Words(low, offs, ALNUM)
                h = Prefix(low).span(w.start, w.end)
                n_base, first, last, bits = np.zeros(n, np.int64), np.full(n, 1 << 60), np.full(n, -1), np.zeros((n, len(labels)), bool)
                for hashes, label in wanted:
                    m = len(hashes)
                    if len(h) < m:
                        continue
                    at = np.flatnonzero(h[: len(h) - m + 1] == np.uint64(hashes[0]))
                    for s in range(1, m):
                        at = at[h[at + s] == np.uint64(hashes[s])]
                    at = at[w.doc[at] == w.doc[at + m - 1]]
                    d = w.doc[at]
                    place = at - w.first[d]
                    np.add.at(n_base, d, 1)
                    np.minimum.at(first, d, place)
                    np.maximum.at(last, d, place)
                    bits[d, label] = True
                g = grams(h, k)
                at = np.flatnonzero(few[(g & np.uint64(0xFFFF)).astype(np.int64)])
                at = at[known[np.minimum(np.searchsorted(known, g[at]), len(known) - 1)] == g[at]]
                at = at[w.doc[at] == w.doc[at + k - 1]] if len(at) else at
                d = w.doc[at]
                cut = pa.array(np.searchsorted(d, np.arange(n + 1)).astype(np.int32))
                hit = np.zeros(n, bool)
                hit[d] = True
                none = n_base == 0
                body = b.column(1).slice(i, n)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(uid + np.arange(n)), b.column(0).slice(i, n), pa.array(w.count.astype(np.int64)), pa.array(n_base), pa.array(first, mask=none), pa.array(last, mask=none),
                        pa.array([",".join(x for x, y in zip(labels, r) if y) for r in bits], pa.string()),
                        pa.ListArray.from_arrays(cut, pa.array((at - w.first[d]).astype(np.int32))), pa.ListArray.from_arrays(cut, pa.array(g[at].view(np.int64))),
                        body.take(pa.array(np.arange(n), mask=~hit)),
                    ],
                    names=[x.split()[0] for x in _SCAN.split(", ")],
                )
                uid += n

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SCAN)


def edit_distance(a: list, b: list) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def spans(scanned: DataFrame, templates=TEMPLATES, k: int = K) -> DataFrame:
    """Verified spans: uid, template, label, lo, hi (words, end exclusive), votes, similarity, coverage."""
    spark = scanned.sparkSession
    table = F.broadcast(spark.createDataFrame(template_grams(templates, k), "gram long, template int, tpos int"))
    hits = scanned.where(F.size("at") > 0).select("uid", F.explode(F.arrays_zip("at", "gram")).alias("h")).select("uid", F.col("h.at").alias("pos"), F.col("h.gram").alias("gram"))
    votes = hits.join(table, "gram").groupBy("uid", "template", (F.col("pos") - F.col("tpos")).alias("diagonal"))
    votes = votes.agg(F.count("*").alias("votes"), F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.min("tpos").alias("tlo"), F.max("tpos").alias("thi"))
    along = Window.partitionBy("uid", "template").orderBy("diagonal")
    fresh = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(along) > DRIFT) | (F.col("lo") > F.lag("hi").over(along) + k + 2 * DRIFT) | (F.col("hi") + k + 2 * DRIFT < F.lag("lo").over(along)), F.lit(True))
    merged = votes.withColumn("_new", fresh.cast("int")).withColumn("group", F.sum("_new").over(along)).groupBy("uid", "template", "group")
    merged = merged.agg(F.sum("votes").alias("votes"), F.min("lo").alias("lo"), (F.max("hi") + k).alias("hi"), F.min("tlo").alias("tlo"), (F.max("thi") + k).alias("thi")).where(F.col("votes") >= MIN_VOTES)
    bodies = merged.join(scanned.where("body is not null").select("uid", "body"), "uid")
    template_words = [words_of(t) for _, t in templates]
    label = [x for x, _ in templates]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, seen = [], (None, [])
            for r in b.to_pylist():
                if seen[0] != r["uid"]:
                    seen = r["uid"], words_of(r["body"])
                want = template_words[r["template"]]
                got, part = seen[1][r["lo"] : r["hi"]], want[r["tlo"] : r["thi"]]
                like = 1 - edit_distance(got, part) / max(len(got), len(part), 1)
                cover = len(part) / len(want)
                if like >= SIMILARITY and (cover >= COVERAGE or len(part) >= LONG_SPAN):
                    out.append((r["uid"], r["template"], label[r["template"]], r["lo"], r["hi"], r["votes"], like, cover))
            types = (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 8, types)], names=["uid", "template", "label", "lo", "hi", "votes", "similarity", "coverage"])

    return bodies.mapInArrow(verify, "uid long, template int, label string, lo int, hi int, votes long, similarity double, coverage double")


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates=TEMPLATES, k: int = K) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every document.

    The score is 1 with a base place, else the best verified span's similarity times its share of the template.
    """
    scanned = write_table(_scan(docs, phrases, templates, k), "license-scan")
    found = spans(scanned, templates, k).groupBy("uid").agg(F.collect_set("label").alias("more"), F.max(F.col("similarity") * F.col("coverage")).alias("best"))
    rows = scanned.drop("at", "gram", "body").join(found, "uid", "left")
    base = F.filter(F.split("base_labels", ","), lambda x: x != "")
    every = F.array_sort(F.array_union(base, F.coalesce("more", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0)))
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", F.array_join(every, ",").alias("labels"), score.alias("score"))
