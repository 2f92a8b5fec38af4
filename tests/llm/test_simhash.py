import random
import re

import numpy as np
import xxhash

from fathomrank import shared
from fathomrank.llm import simhash_dedup as sh
from fathomrank.shared import connected_components

DOCS = "doc_id long, text string, fp string, n int"


def reference_fp(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def corpus():
    r = random.Random(3)
    words = [f"W{i}é" for i in range(60)]
    out = []
    for _ in range(40):
        base = [r.choice(words) for _ in range(r.choice([1, 2, 3, 4, 120, 400]))]
        for _ in range(r.choice([1, 1, 3, 6])):
            w = list(base)
            if len(w) > 100:
                w[r.randrange(len(w))] = r.choice(words)
            out.append(" ".join(w))
    out += ["", "   \t\n", None, "One", "one", "ONE  "]
    rows = [(i, t, "clash", 1) for i, t in enumerate(out)]
    r.shuffle(rows)
    return rows + rows[:4] + [(None, "one", "x", 0), (None, "completely other text here", "x", 0)]


def brute(rows):
    fps = [reference_fp(t) for _, t, *_ in rows]
    n = len(rows)
    link = [[j for j in range(n) if j != i and (fps[i] ^ fps[j]).bit_count() <= 2] for i in range(n)]
    comp = list(range(n))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(n):
        for j in link[i]:
            comp[find(i)] = find(j)
    least = {}
    for i, (d, *_) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(-1 if d is None else d, f"{fps[i]:016x}", len(link[i]), least.get(find(i), -1)) for i, (d, *_) in enumerate(rows)]


def test_documents_against_brute_force(spark):
    rows = corpus()
    got = sh.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(5)).toPandas()
    got = got.fillna({"doc_id": -1, "component_id": -1}).astype({"doc_id": int, "component_id": int})
    assert sorted(brute(rows)) == sorted(got.itertuples(index=False, name=None))


def test_pairs_of_random_neighbours_against_brute_force(spark):
    r = random.Random(9)
    fps = set()
    for _ in range(120):
        x = r.getrandbits(64)
        fps |= {x, x ^ 1 << r.randrange(64), x ^ 1 << r.randrange(64) ^ 1 << r.randrange(64), x ^ 1 << 63, x ^ (1 << 63 | 1 << 31)}
    fps = sorted(int(np.uint64(x).astype(np.int64)) for x in fps)
    got = sh.near_pairs(spark.createDataFrame([(x,) for x in fps], "fp long")).collect()
    want = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    assert len(got) == len(want) and {tuple(p) for p in got} == want


def test_one_document_of_each_component_stays(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, DOCS)
    got = sh.near_deduplicated(docs).toPandas()
    assert list(got.columns) == docs.columns
    want = {c for _, _, _, c in brute(rows)}
    assert sorted(got.doc_id.fillna(-1).astype(int)) == sorted(want)


def test_components_without_id_or_with_the_same_id_stay_apart(spark):
    texts = [" ".join(f"{chr(97 + i)}{j * (i + 3) % 47}" for j in range(60)) for i in range(4)]
    rows = [(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (None, texts[0]), (7, texts[2])]
    got = sh.near_deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.text for r in got) == sorted(texts)


def test_clashing_columns(spark):
    texts = [" ".join(f"{chr(97 + i)}{j * (i + 3) % 47}" for j in range(60)) for i in range(3)]
    docs = spark.createDataFrame([(i, texts[i % 3], 7, 8, 9, "a", 10) for i in range(6)], "doc_id long, text string, h int, _h int, i int, row string, fp int")
    got = sh.near_deduplicated(docs)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == [(i, texts[i], 7, 8, 9, "a", 10) for i in range(3)]
    assert sh.near_duplicates(docs).count() == 6


def test_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    assert sh.near_duplicates(docs).count() == 0 and sh.near_deduplicated(docs).count() == 0


def test_components_of_chains_stars_and_cycles(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (7, 7), (201, 200)]
    edges += [(r.randrange(300, 360), r.randrange(300, 360)) for _ in range(50)]
    got = {x.node: x.root for x in connected_components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {i: find(i) for i in list(root)}


def test_small_graphs_take_few_jobs(spark):
    """Each job leaves plans, threads and broadcasts with the driver; rounds of joins took dozens over a chain of 40."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    spark.sparkContext.setJobGroup("small graph", "")
    got = connected_components(edges, "t").collect()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("small graph"))
    spark.sparkContext.setJobGroup("", "")
    assert sorted(got) == [(i, 0) for i in range(41)] and jobs <= 8


def test_one_task_and_rounds_give_the_same_components(spark, monkeypatch):
    r = random.Random(2)
    ids = [r.randrange(-(2**63), 2**63) for _ in range(300)]
    edges = spark.createDataFrame([(r.choice(ids), r.choice(ids)) for _ in range(200)], "a long, b long")
    got = sorted(connected_components(edges, "t").collect())
    monkeypatch.setattr(shared, "WHOLE_GRAPH", 0)
    assert got == sorted(connected_components(edges, "t").collect()) and len(got) > 100
    assert connected_components(edges.limit(0), "t").count() == 0
    monkeypatch.undo()
    assert connected_components(edges.limit(0), "t").count() == 0
