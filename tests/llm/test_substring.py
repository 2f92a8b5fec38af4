import random

import pyarrow as pa
import pytest

from fathomrank.llm import substring_dedup as sd
from fathomrank.llm.kernels import chunks

DOCS = "doc_id long, text string, thash string, cid int"
R = random.Random(4)
VOCABULARY = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}é" for i in range(400)]


def line(n):
    return " ".join(R.choice(VOCABULARY) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    shared = [line(60) for _ in range(6)]
    rows = []
    for i in range(60):
        ls = [line(R.choice([2, 35, 80])) for _ in range(R.choice([1, 2, 4]))]
        for s in R.sample(shared, R.choice([0, 0, 1, 2])):
            w = s.split()
            if R.random() < 0.4:
                w[R.randrange(len(w))] = "changedword"
            ls.insert(R.randrange(len(ls) + 1), " ".join(w).capitalize() + R.choice([".", "!", " 12"]))
        rows.append((i, "\n".join(ls), "x", 1))
    rows += [(100, None, None, 1), (101, "", "", 1), (102, "\n\n", "", 1), (103, shared[0], "", 1), (None, shared[1], "", 1), rows[0], rows[0]]
    return rows


def brute(rows):
    ps = []
    for k, (d, t, *_) in enumerate(rows):
        for n, s in enumerate((t or "").split("\n")):
            w = sd.WORD.findall(s.encode().lower())
            if len(w) >= sd.MIN_WORDS:
                ps.append((d is None, -1 if d is None else d, n, k, sd.shingles(s.encode())))
    root = list(range(len(ps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, p in enumerate(ps):
        for j in range(i):
            q = ps[j]
            if len(p[4] & q[4]) >= sd.THRESHOLD * len(p[4] | q[4]):
                root[find(i)] = find(j)
    groups = {}
    for i, p in enumerate(ps):
        groups.setdefault(find(i), []).append(p[:4])
    return [sorted(g) for g in groups.values() if len(g) > 1]


def test_repeats_against_brute_force(spark, corpus):
    got = sd.repeated_lines(spark.createDataFrame(corpus, DOCS).repartition(4)).toPandas()
    got["doc_id"] = got.doc_id.fillna(-1).astype(int)
    want = brute(corpus)
    assert sorted(sorted((r.doc_id, r.paragraph) for r in g.itertuples()) for _, g in got.groupby("cluster_id")) == sorted(sorted((d, n) for _, d, n, _ in g) for g in want)
    for _, g in got.groupby("cluster_id"):
        assert g.keep.sum() == 1
    for r in got[got.doc_id < 100].itertuples():
        text = {d: t for d, t, *_ in corpus}[None if r.doc_id == -1 else r.doc_id]
        assert text[r.start : r.start + r.length] == text.split("\n")[r.paragraph]


def test_only_the_first_of_a_cluster_stays_in_the_text(spark, corpus):
    docs = spark.createDataFrame(corpus, DOCS)
    got = sd.deduplicated(docs)
    assert got.columns == docs.columns
    assert not brute([tuple(r) for r in got.collect()])
    texts = {r.doc_id: r.text for r in got.collect()}
    assert texts[100] is None and texts[101] == "" and texts[102] == "\n\n" and 103 not in texts and None not in texts


def test_passages_inside_lines(spark):
    passage, other = line(70), line(55)
    rows = [(i, f"{line(R.randrange(3, 60))} {passage if i % 2 else other} {line(R.randrange(3, 60))}", "x", 1) for i in range(12)]
    rows += [(20, "x " * 3 + passage, "x", 1), (21, line(90), "x", 1), (22, line(40) + "\n" + line(40), "x", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    got = sd.repeated(docs).toPandas()
    assert set(got.doc_id) == {*range(12), 20} and set(got[got.keep].doc_id) == {0, 1}
    for r in got.itertuples():
        cut = rows[[d for d, *_ in rows].index(r.doc_id)][1][r.start : r.start + r.length]
        assert cut in (passage if r.doc_id % 2 or r.doc_id == 20 else other) and len(cut.split()) == r.n_words >= 20
    left = {r.doc_id: r.text for r in sd.deduplicated(docs).collect()}
    assert len(left) == len(rows) and left[21] == rows[-2][1] and left[0] == rows[0][1]
    for d in (3, 5, 7, 9, 11):
        words = rows[d][1].split()
        kept = iter(words)
        assert len(left[d].split()) <= len(words) - 20 and all(w in kept for w in left[d].split())


def windows(text):
    w = [m.group() for m in sd.WORD.finditer((text or "").encode().lower())]
    return [tuple(w[i : i + sd.MIN_RUN]) for i in range(len(w) - sd.MIN_RUN + 1)]


def test_runs_over_lines_against_brute_force(spark):
    r = random.Random(8)
    some = [line(n) for n in (20, 21, 35, 51, 53, 60, 120)]

    def wrapped(text, n):
        w = text.split()
        return "\n".join(" ".join(w[i : i + n]) for i in range(0, len(w), n))

    rows = [(i, wrapped(f"{line(r.randrange(25, 60))} {some[i % 7]} {line(r.randrange(25, 60))}", r.choice([7, 12, 18, 25])), "x", 1) for i in range(42)]
    rows += [(50, f"{line(10)}\n{' '.join(some[4].split()[:35])}\n{' '.join(some[4].split()[35:])}\n{line(12)}", "x", 1), (None, wrapped(some[5], 9), "x", 1)]
    got = sd.repeated(spark.createDataFrame(rows, DOCS).repartition(3)).where("not whole").toPandas()
    seen, want = set(), {}
    for d, text, *_ in rows:
        for k, w in enumerate(windows(text)):
            if w in seen:
                want.setdefault(d, set()).update(range(k, k + sd.MIN_RUN))
            seen.add(w)
    texts, cut = {d: t for d, t, *_ in rows}, {}
    for x in got[~got.keep].itertuples():
        d = None if x.doc_id != x.doc_id else int(x.doc_id)
        before, inside = texts[d][: x.start].split(), texts[d][x.start : x.start + x.length].split()
        assert len(inside) == x.n_words
        cut.setdefault(d, set()).update(range(len(before), len(before) + len(inside)))
    assert cut == want and len(want) == 37 and None in want
    left = {x.doc_id: x.text for x in sd.deduplicated(spark.createDataFrame(rows, DOCS)).collect()}
    every = [w for t in left.values() for w in windows(t)]
    assert len(every) == len(set(every)) and None not in left
    for d, text, *_ in rows:
        if d is not None:
            assert left[d].split() == [w for k, w in enumerate(text.split()) if k not in want.get(d, ())]


def test_equal_windows_have_equal_seeds_wherever_they_stand():
    passage = line(51)
    texts = [line(7), *[f"{line(40)} {passage} {line(40)}" for _ in range(40)], passage, line(19), ""]
    p = next((sd.places(buf, offs) for _, _, buf, offs in chunks(pa.array(texts))))
    at, seed, g = sd.windows_of(p)
    assert len(at) == sum(len(windows(t)) for t in texts)
    seeds = {}
    for a, k in zip(at, seed):
        assert a <= k <= a + sd.MIN_RUN - sd.SEED and p["doc"][k + sd.SEED - 1] == p["doc"][a]
        seeds.setdefault(tuple(p["h"][a : a + sd.MIN_RUN]), []).append((g[k], k - a))
    assert all(len(set(x)) == 1 for x in seeds.values())
    assert sum(len(x) == 41 for x in seeds.values()) == 51 - sd.MIN_RUN + 1


def test_one_of_equal_rows_keeps_its_text(spark):
    long, short = line(60), "\n".join(line(9) for _ in range(5))
    rows = [(1, long, "x", 1)] * 3 + [(2, short, "x", 1)] * 3 + [(None, line(70) + "\n" + long, "x", 1)] * 2 + [(4, "few words", "x", 1)] * 2
    got = [r.text for r in sd.deduplicated(spark.createDataFrame(rows, DOCS).repartition(3)).collect()]
    assert sorted(t.rstrip("\n") for t in got) == sorted([long, short, rows[6][1].split("\n")[0], "few words", "few words"])


def test_bands_reach_the_recall():
    b, r = sd.tune_bands(0.7, 0.97)
    assert 1 - (1 - 0.7**r) ** b >= 0.97 > 1 - (1 - 0.7**r) ** (b - 1)


def test_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    assert sd.repeated(docs).count() == 0 and sd.deduplicated(docs).count() == 0


def test_what_one_document_repeats_is_left_alone(spark):
    own, shared = line(50), line(60)
    rows = [(1, "\n".join([own] * 4), "x", 1), (2, f"{shared}\n{line(30)}\n{shared}", "x", 1), (3, line(40) + " " + shared, "x", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    assert {r.doc_id for r in sd.repeated(docs).collect()} == {2, 3}
    left = {r.doc_id: r.text for r in sd.deduplicated(docs).collect()}
    assert left[1] == rows[0][1] and left[2].split("\n")[0] == shared and left[2].count(shared) == 1 and shared not in left[3]


def test_components_are_those_of_all_pairs(spark):
    """Many near-copies of a few lines: stars leave some links out, and no component may break."""
    r = random.Random(6)
    rows = []
    for i in range(150):
        w = line(40).split() if i % 50 == 0 else rows[-r.randrange(1, min(i % 50, 6) + 1)][1].split()
        for _ in range(3):
            w[r.randrange(len(w))] = f"new{chr(97 + i % 26)}{chr(97 + i // 26)}{r.choice('abcdef')}"
        rows.append((i, " ".join(w), "x", 1))
    got = sd.repeated_lines(spark.createDataFrame(rows, DOCS), recall=0.999999).toPandas()
    assert sorted(sorted(g.doc_id) for _, g in got.groupby("cluster_id")) == sorted(sorted(d for _, d, _, _ in g) for g in brute(rows))


def test_clashing_columns(spark):
    text = line(60)
    docs = spark.createDataFrame([(1, text, 3, 4, 5, "a"), (2, text, 3, 4, 5, "b"), (3, line(9) + "\n" + text, 3, 4, 5, "c")], "doc_id long, text string, _gone int, thash int, n int, row string")
    got = sd.deduplicated(docs)
    assert got.columns == docs.columns
    assert {r.doc_id: tuple(r)[2:] for r in got.collect()} == {1: (3, 4, 5, "a"), 3: (3, 4, 5, "c")}


def test_no_row_is_made_for_a_word_or_a_band(spark, monkeypatch):
    r = random.Random(8)
    words = lambda n: " ".join("".join(r.choices("abcdefgh", k=6)) for _ in range(n))
    passage = words(150)
    rows = [(i, words(30) + " " + passage + " " + words(30)) for i in range(40)]
    most, write = {}, sd.write_table

    def counted(df, label):
        out = write(df, label)
        most[label] = out.count()
        return out

    monkeypatch.setattr(sd, "write_table", counted)
    got = sd.repeated(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert sorted(got[got.keep].doc_id) == [0] and len(got) == 40 and set(got.n_words) >= {150}
    assert max(most.values()) <= 40 * sd.tune_bands()[0]
