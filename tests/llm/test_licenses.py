import random
import re

from fathomrank.llm import license_scan as ls

DOCS = "doc_id long, text string, uid string, label int"


def brute(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    places, labels = [], set()
    for p, label in ls.PHRASES.items():
        q = p.split()
        at = [i for i in range(len(w) - len(q) + 1) if w[i : i + len(q)] == q]
        places += at
        labels |= {label} if at else set()
    return len(w), len(places), min(places, default=-1), max(places, default=-1), ",".join(sorted(labels))


def rows():
    r = random.Random(8)
    parts = ["MIT License", "mit-license", "Apache  License", "cc", "by", "CC BY", "GNU General\nPublic License", "gnu general", "é", "漢字", "x1", "the", "APACHE", "license,", "Mit"]
    out = [(i, " ".join(r.choice(parts) for _ in range(r.choice([0, 1, 5, 60]))), "u", 1) for i in range(80)]
    mpl = next(t for x, t in ls.TEMPLATES if x == "bsd").split()
    out.append((200, "prose " * 40 + " ".join(mpl) + " more prose", "u", 1))
    out.append((201, "prose " * 9 + " ".join(mpl[:9] + ["inserted"] + mpl[9:14] + mpl[15:]) + " more prose", "u", 1))
    out.append((202, " ".join(r.sample(mpl, len(mpl))), "u", 1))
    out += [(203, None, "u", 1), (204, "", "u", 1), (None, "cc by", None, None), out[1], out[1]]
    return out


def test_base_places_against_brute_force(spark):
    got = ls.scan(spark.createDataFrame(rows(), DOCS).repartition(3)).toPandas()
    got = got.fillna({"doc_id": -1, "first_word": -1, "last_word": -1})
    got = got.astype({"doc_id": int, "first_word": int, "last_word": int})
    have = got[["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]].itertuples(index=False, name=None)
    assert sorted(have) == sorted((-1 if d is None else d, *brute(t)) for d, t, *_ in rows())
    for r in got.itertuples():
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert r.labels == ",".join(sorted(set(r.labels.split(",")))) and 0 <= r.score <= 1


def test_spans_survive_edits_and_order_matters(spark):
    got = ls.scan(spark.createDataFrame(rows(), DOCS)).toPandas().set_index("doc_id")
    assert got.labels[200] == "bsd" and got.score[200] == 1.0 and got.n_base[200] == 0
    assert got.labels[201] == "bsd" and 0.75 < got.score[201] < 1
    assert got.labels[202] == "" and got.score[202] == 0
    assert got.labels[203] == "" and got.n_words[203] == 0


def test_empty_table(spark):
    assert ls.scan(spark.createDataFrame([], DOCS)).count() == 0


def test_edit_distance():
    assert ls.edit_distance(list("kitten"), list("sitting")) == 3 and ls.edit_distance([], list("ab")) == 2


def plain_spans(text):
    """Verified spans of one text, without Spark and without hashes: (template, lo, hi, votes)."""
    w, k, out = ls.words_of(text or ""), ls.K, []
    for t, (_, template) in enumerate(ls.TEMPLATES):
        q = ls.words_of(template)
        by = {}
        for p in range(len(w) - k + 1):
            for s in range(len(q) - k + 1):
                if w[p : p + k] == q[s : s + k]:
                    by.setdefault(p - s, []).append((p, s))
        groups, before = [], None
        for d in sorted(by):
            now = (d, min(by[d])[0], max(by[d])[0])
            far = before is None or d - before[0] > ls.DRIFT or now[1] > before[2] + k + 2 * ls.DRIFT or now[2] + k + 2 * ls.DRIFT < before[1]
            if far:
                groups.append([])
            groups[-1] += by[d]
            before = now
        for g in groups:
            lo, hi, a, z = min(g)[0], max(g)[0] + k, min(s for _, s in g), max(s for _, s in g) + k
            like = 1 - ls.edit_distance(w[lo:hi], q[a:z]) / max(hi - lo, z - a)
            if len(g) >= ls.MIN_VOTES and like >= ls.SIMILARITY and ((z - a) / len(q) >= ls.COVERAGE or z - a >= ls.LONG_SPAN):
                out.append((t, lo, hi, len(g)))
    return sorted(out)


def test_votes_and_spans_against_brute_force(spark):
    r = random.Random(12)
    texts = []
    for _ in range(40):
        parts = []
        for _ in range(r.randrange(1, 4)):
            w = r.choice(ls.TEMPLATES)[1].split()
            a = r.randrange(max(1, len(w) // 2))
            w = w[a : a + r.randrange(4, len(w) + 1)]
            for _ in range(r.randrange(3)):
                w.insert(r.randrange(len(w)), "odd") if r.random() < 0.5 else w.pop(r.randrange(len(w)))
            parts += w + ["filler"] * r.randrange(3)
        texts.append(" ".join(parts))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, "", "odd"])], "doc_id long, text string")
    scanned = ls.write_table(ls._scan(docs, ls.PHRASES, ls.TEMPLATES, ls.K), "test-licences")
    got = {}
    for x in ls.spans(scanned).join(scanned.select("uid", "doc_id"), "uid").collect():
        got.setdefault(x.doc_id, []).append((x.template, x.lo, x.hi, x.votes))
    want = {i: s for i, t in enumerate(texts) if (s := plain_spans(t))}
    assert {i: sorted(s) for i, s in got.items()} == want and sum(map(len, want.values())) > 20
