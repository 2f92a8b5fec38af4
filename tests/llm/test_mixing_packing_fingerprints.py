import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fathomrank.llm import best_fit_packing as packing
from fathomrank.llm import source_mixing as mixing
from fathomrank.llm import span_fingerprints as prints
from fathomrank.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, size long, taken int"


def rows(n=60, seed=1):
    r = random.Random(seed)
    texts = [" ".join(r.choice(["alpha", "bêta", "c", "δ", "\n", "x!"]) for _ in range(r.choice([0, 1, 3, 40, 400]))) for _ in range(n)]
    out = [(i, t, "en", r.choice(["a", "a", "a", "b", "Z", None]), len(t), 7) for i, t in enumerate(texts)]
    return out + [out[3], out[3], (None, "no id", None, "b", 5, 1), (900, None, None, None, None, None), (901, "", "en", "empty", 0, 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3)


def test_targets_are_met(docs):
    got = mixing.mix(docs).toPandas()
    assert len(got) == len(rows())
    sizes = [len((t or "").split()) for _, t, *_ in rows()]
    assert sorted(got["size"]) == sorted(sizes)
    assert (got.taken <= 3 * got["size"]).all() and (got.taken >= 0).all()
    src = {}
    for (d, t, _, s, _, _), n in zip(rows(), sizes):
        src[s] = src.get(s, 0) + n
    order = sorted((s for s in src if s is not None)) + ([None] if None in src else [])
    w = {s: 1 + i % 3 for i, s in enumerate(order)}
    target, capped = {}, set()
    while True:
        free = sum(w[s] for s in order if s not in capped)
        level = (sum(sizes) - sum(3 * src[s] for s in capped)) / free
        target = {s: 3 * src[s] if s in capped else level * w[s] for s in order}
        over = {s for s in order if s not in capped and target[s] > 3 * src[s]}
        if not over:
            break
        capped |= over
    assert sorted(set(np.round(got.target, 6))) == sorted({round(x, 6) for x in target.values()})
    by = got.groupby("target").taken.sum()
    for t, n in by.items():
        assert abs(n - t * sum(abs(v - t) < 1e-9 and src[s] > 0 for s, v in target.items())) <= 3 or t == 0


def test_mixed_copies_hold_the_words_taken(docs):
    taken = mixing.mix(docs).toPandas()
    mixed = mixing.mixed_documents(docs).toPandas()
    assert list(mixed.columns) == docs.columns
    assert mixed.text.map(lambda t: len(t.split())).sum() == taken.taken.sum()


def test_buckets_are_even_and_in_order_whatever_the_weights(spark):
    texts = F.when(F.col("id") % 3 > 0, F.lit("!!!")).otherwise(F.lit("word word"))
    docs = spark.range(100_000).select(F.when(F.col("id") < 95_000, F.col("id")).alias("doc_id"), F.when(F.col("id") < 95_000, texts).otherwise(F.concat(F.lit("t"), "id")).alias("text"), F.lit("s").alias("source"))
    key = (-F.ln(mixing.uniform(F.coalesce(F.col("doc_id").cast("string"), F.md5("text")))) / mixing.quality_weight(F.col("text"))).alias("key")
    got = mixing.bucketed(docs.select("doc_id", key), 1000).groupBy("bucket").agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).orderBy("bucket").collect()
    assert len(got) == 100 and max(r.n for r in got) < 1500
    assert all(a.hi <= b.lo for a, b in zip(got, got[1:]))
    taken = mixing.mix(docs).agg(F.sum("taken"), F.first("target")).first()
    assert abs(taken[0] - taken[1]) < 1


def few_a_bucket(monkeypatch, n):
    bucketed = mixing.bucketed
    monkeypatch.setattr(mixing, "bucketed", lambda drawn: bucketed(drawn, n))


def test_any_bucket_size_takes_the_same(spark, monkeypatch):
    docs = spark.createDataFrame(rows(600, 4), DOCS).repartition(3)

    def taken():
        return sorted(map(str, mixing.mix(docs).collect())), sorted(map(str, mixing.mixed_documents(docs).collect()))

    want = taken()  # one bucket: all rows in order
    few_a_bucket(monkeypatch, 7)
    assert taken() == want


def test_texts_are_not_shuffled_where_sources_are_large(spark, monkeypatch):
    r = random.Random(6)
    texts = [" ".join(f"{r.randrange(10**9)}" for _ in range(150)) for _ in range(3000)]
    docs = spark.createDataFrame([(i, t, "en", "ab"[i % 2], 0, 0) for i, t in enumerate(texts)], DOCS)
    few_a_bucket(monkeypatch, 100)
    spark.sparkContext.setJobGroup("mix", "")
    mixing.mixed_documents(docs).write.format("noop").mode("overwrite").save()
    tracker, store = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = {s for j in tracker.getJobIdsForGroup("mix") for s in tracker.getJobInfo(j).stageIds}
    spark.sparkContext.setJobGroup("", "")
    assert 0 < sum(store.lastStageAttempt(s).shuffleWriteBytes() for s in stages) < sum(map(len, texts)) / 5


def test_mixing_is_repeatable(docs):
    a = mixing.mix(docs).toPandas().sort_values(["doc_id", "size"]).reset_index(drop=True)
    b = mixing.mix(docs.repartition(7)).toPandas().sort_values(["doc_id", "size"]).reset_index(drop=True)
    assert a.equals(b)


@pytest.mark.parametrize("run", [mixing.mix, mixing.mixed_documents, prints.fingerprints, lambda d: packing.pack_documents(d, tokenizer_path())])
def test_empty_table(spark, run):
    assert run(spark.createDataFrame([], DOCS)).count() == 0


def test_pieces_are_the_tokenizers_ids_and_fill_sequences(docs):
    tok = Tokenizer.from_file(tokenizer_path())
    got = packing.pack_documents(docs, tokenizer_path(), capacity=64).toPandas()
    want = []
    for d, t, *_ in rows():
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        head = len(ids) % 64
        at = [0, *range(head, len(ids), 64)] if head else list(range(0, len(ids), 64))
        for k, s in enumerate(at):
            e = at[k + 1] if k + 1 < len(at) else len(ids)
            want.append((-1 if d is None else d, k, s, e - s, zlib.crc32(ids[s:e].tobytes())))
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(want) == sorted(got[key].fillna(-1).astype("int64").itertuples(index=False, name=None))
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g.offset.to_numpy() == np.concatenate([[0], g.length.cumsum()[:-1]])).all() and g.length.sum() <= 64
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 64) + 2


def test_fast_encoder_equals_the_exact_one():
    tok = Tokenizer.from_file(tokenizer_path())
    r = random.Random(5)
    for _ in range(300):
        t = "".join(r.choice(["a", "B", "é", "漢", " ", "  ", "\n", "\t", "'s", "12", "!?", " ", "🙂", "x" * 30, "<|endoftext|>", " "]) for _ in range(r.randint(0, 60)))
        assert packing.encode(t, tokenizer_path()).tolist() == tok.encode(t, add_special_tokens=False).ids


def test_long_runs_of_one_kind_get_the_same_ids():
    tok = Tokenizer.from_file(tokenizer_path())
    for t in (" " * 600_000, "ab " * 100_000, "x" * 250_001, "\n\t" * 200_000 + "y"):  # the fast encoder gives up on the first
        assert packing.encode(t, tokenizer_path()).tolist() == tok.encode(t, add_special_tokens=False).ids


def test_plan_is_exact_where_complements_exist():
    counts = {600: 5, 424: 5, 1024: 3, 500: 4, 300: 4, 224: 4, 700: 2, 200: 2, 100: 2, 24: 2}
    plan = packing.plan(counts)
    assert max(p[3] + (p[2] - p[1] - 1) // p[5] for p in plan) + 1 == sum(n * c for n, c in counts.items()) // 1024
    placed = {}
    for n, lo, hi, *_ in plan:
        placed[n] = placed.get(n, 0) + hi - lo
    assert placed == counts


def test_combinations_respect_counts():
    r = random.Random(2)
    for _ in range(300):
        left = np.zeros(65, dtype=np.int64)
        for _ in range(r.randint(1, 12)):
            left[r.randint(1, 63)] += 1
        gap = r.randint(1, 63)
        got = packing.exact_combination(left, gap)
        if got:
            assert sum(got) == gap and all(left[x] >= got.count(x) for x in got)
        else:
            items = [i for i in range(65) for _ in range(left[i])]
            sums = {a for a in items} | {items[i] + items[j] for i in range(len(items)) for j in range(i)}
            sums |= {items[i] + items[j] + items[k] for i in range(len(items)) for j in range(i) for k in range(j)}
            assert gap not in sums


def test_fingerprints_against_brute_force(docs):
    def poly(t):
        h = [sum((ord(c) + 1) * pow(b, i, p) for i, c in enumerate(t)) % p for p, b in zip(prints.PRIMES, prints.BASES)]
        return prints.show(len(t), h)

    def like(a, b):
        n, m = len(a), len(b)
        if not max(n, m):
            return 1.0
        p = 0
        while p < min(n, m) and a[p] == b[p]:
            p += 1
        s = 0
        while s < min(n, m) - p and a[n - 1 - s] == b[m - 1 - s]:
            s += 1
        return (p + s) / max(n, m)

    got = prints.fingerprints(docs).toPandas()
    # equal ids have equal texts here, so any order among them gives the same rows
    data = sorted(((d, t or "") for d, t, *_ in rows()), key=lambda x: (x[0] is None, -(x[0] or 0)))
    want = []
    for (d, a), (_, b) in zip(data, data[1:] + data[:1]):
        e = a[: len(a) - len(a) // 2] + b[: len(a) // 2]
        want.append((-1 if d is None else d, len(a), hashlib.sha256(e.encode()).hexdigest(), poly(a), poly(e), round(like(a, e), 9), round(like(a, b), 9)))
    got["doc_id"] = got.doc_id.fillna(-1).astype("int64")
    assert sorted(want) == sorted(got.round(9).itertuples(index=False, name=None))


def test_span_equality_and_extension():
    a, b = prints.PrefixHash("xxabcdefgh🙂yy"), prints.PrefixHash("abcdefgh🙂zz")
    assert prints.extension(a, 2, b, 0, 11) == 9
    assert prints.extension_left(a, 11, b, 9, 9) == 9
    assert prints.equal(a, 2, b, 0, 9) and not prints.equal(a, 1, b, 0, 3)
