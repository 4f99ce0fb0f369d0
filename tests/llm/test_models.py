import collections
import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from pagestrata.llm import ann, lm, quality


def labelled(seed, n):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(5, 80))]
        rows.append((i, " ".join(words) if good else rng.choice([" | ".join(words), " ".join(w.upper() + "!!" for w in words), " ".join([words[0]] * len(words))])))
        labels.append((i, int(good), 0))
    return rows, labels


def test_classifier(spark):
    rows, labels = labelled(1, 900)
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.quality_digest(docs, known).collect()
    truth = dict((i, q) for i, q, _ in labels)
    held = [r for r in got if r["held_out"]]
    assert len(got) == 900 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97
    model = quality.train(docs, known)
    stats = docs.select(*[c.alias(k) for k, c in quality.statistics(F.col("text")).items()])
    both = stats.withColumn("s", model.score()).toPandas()
    assert np.allclose(both["s"], model.apply(both[list(quality.FEATURES)].to_numpy()))
    assert 0 < len(model.rules) < 200
    kept = quality.keep_good(docs.withColumn("score", F.lit("own")), known)
    assert kept.columns == ["doc_id", "text", "score"] and 0 < kept.count() < 900


def test_classifier_odd_rows(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.quality_digest(odd_docs, none).collect()
    assert len(got) == 8 and {r["score"] for r in got} == {0.5} and {r["predicted"] for r in got} == {1}
    one = spark.createDataFrame([(i, 0) for i in range(8)] + [(1, None), (None, 1), (5, 7)], "doc_id long, quality int")
    assert {r["predicted"] for r in quality.quality_digest(odd_docs, one).collect()} == {0}
    assert quality.quality_digest(no_docs, one).count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 16))
    x[1000:1400] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5050, [0.0] * 16), (5100, [float("nan")] * 16), (5150, [1.0] * 3), (5200, [float("inf")] * 16), (5250, [None] * 16)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(v, v.filter("vec_id % 50 = 0")).collect()
    by = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(by) == set(range(0, 3000, 50))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for q, found in by.items():
        s = np.round(u @ u[q], 12)
        s[q] = -9
        best = np.lexsort((np.arange(3000), -s))[:5].tolist()
        hit += len(set(best) & {i for i, _ in found})
        assert [round(float(u[i] @ u[q]), 9) for i, _ in found] == [round(c, 9) for _, c in found]
        if 1000 <= q < 1400:
            assert [i for i, _ in found] == best
    assert hit >= 0.9 * 5 * len(by)
    few = v.filter("vec_id < 3")
    assert ann.nearest(few, few.filter("vec_id = 0")).count() == 2
    assert ann.nearest(v.limit(0), v).count() == 0


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def test_language_model(spark, no_docs, odd_docs):
    rng = random.Random(3)
    phrase = "the quick brown fox jumps".split()
    rows = [(i, " ".join(x for _ in range(rng.randint(0, 12)) for x in (phrase if rng.random() < 0.5 else [f"w{rng.randint(0, 50)}"]))) for i in range(400)] + [(9001, None), (9002, "")]
    got = {r["doc_id"]: r for r in lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    count = collections.Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 10 for w in tokens(t))
    n, v = sum(count.values()), len(count)
    for i, t in rows:
        r, w = got[i], tokens(t)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(w), sum(count[x] > 0 for x in w), n, zlib.crc32(str(i).encode()) % 10 == 0)
        assert math.isclose(r["base_score"], sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), rel_tol=1e-9)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert lm.score_documents(no_docs).count() == 0
    assert lm.score_documents(odd_docs).count() == 8


def test_automaton_states_sum_to_one(spark):
    rows = [(i, t) for i, t in enumerate(["a b a b c", "a b c", "b a b", "c c a", "a b"] * 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    part, n, v = lm.whole_automaton(docs)
    assert len(part.on_pair) and len(part.on_triple)
    counts = collections.Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 10 for w in tokens(t))
    assert (n, v) == (sum(counts.values()), len(counts))
    pairs = {(h, w): k for k, (h, w) in enumerate(zip(part.history.tolist(), part.word.tolist()))}
    unigram = [*part.unigram.tolist(), 0.1 / (n + 0.1 * (v + 1))]  # the last stands for all unknown words

    def after(word, w):
        at = pairs.get((word, w))
        return part.on_pair[at] if at is not None else part.word_fail[word] * unigram[w]

    every = range(len(unigram))
    assert math.isclose(sum(unigram), 1.0, rel_tol=1e-9)
    for word in range(len(part.words) + 1):
        assert math.isclose(sum(after(word, w) for w in every), 1.0, rel_tol=1e-9)
    arcs = {(c, part.word[k]): x for c, k, x in zip(part.context3.tolist(), part.lower.tolist(), part.on_triple.tolist())}
    end = int(np.searchsorted(part.words, lm.END_HASH))
    for (_, second), k in pairs.items():
        if second != end:
            assert math.isclose(sum(arcs[k, w] if (k, w) in arcs else part.pair_fail[k] * after(second, w) for w in every), 1.0, rel_tol=1e-9)


def found_share(spark, x, step, k=5):
    """The share of the true neighbours of every ``step``-th row that are found."""
    v = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    by = collections.defaultdict(set)
    for r in ann.nearest(v, v.filter(F.col("vec_id") % step == 0), k).collect():
        by[r["query_id"]].add(r["vec_id"])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for q in range(0, len(x), step):
        s = u @ u[q]
        s[q] = -9
        hit += len(by[q] & set(np.argsort(-s)[:k].tolist()))
    return hit / (k * len(range(0, len(x), step)))


def test_nearest_probes_enough_of_many_cells(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELL_ROWS", 16)
    x = np.random.default_rng(5).normal(size=(6000, 64))
    assert ann.cells_for(6000)[1] < ann.cells_for(6000)[0]
    assert found_share(spark, x, 60) >= 0.9


def test_nearest_among_near_copies(spark):
    rng = np.random.default_rng(6)
    x = np.repeat(rng.normal(size=(3, 32)), 700, axis=0) + 0.01 * rng.normal(size=(2100, 32))
    assert found_share(spark, x, 60) >= 0.9


def test_every_repeated_ngram_has_an_arc(spark, monkeypatch):
    """More words than 2**16, in several chunks, against a model of plain counters."""
    monkeypatch.setattr(lm, "CHUNK_WORDS", 30_000)
    rng = random.Random(8)
    passages = [[f"{rng.choice('ab')}{i}x{j}" for j in range(190)] for i in range(400)]
    rows = [(i, " ".join(passages[i % 400] + rng.sample(passages[(7 * i) % 400], 20))) for i in range(1200)]
    train = [["<s>", *tokens(t)] for i, t in rows if zlib.crc32(str(i).encode()) % 10]
    c1 = collections.Counter(w for t in train for w in t)
    c2 = collections.Counter(p for t in train for p in zip(t, t[1:]))
    c3 = collections.Counter(p for t in train for p in zip(t, t[1:], t[2:]))
    n, v = sum(c1.values()) - c1["<s>"], len(c1) - 1
    uni = lambda w: (c1[w] + 0.1) / (n + 0.1 * (v + 1))
    two = {p: (c - 0.5) / c1[p[0]] for p, c in c2.items() if c >= 2}
    three = {p: (c - 0.5) / c2[p[:2]] for p, c in c3.items() if c >= 2}
    left2, below2, left3, below3 = (collections.Counter() for _ in range(4))
    for p, share in two.items():
        left2[p[0]] += share
        below2[p[0]] += uni(p[1])
    for p, share in three.items():
        left3[p[:2]] += share
        below3[p[:2]] += two[p[1:]]
    fail = lambda used, below: max(1 - used, 1e-12) / max(1 - below, 1e-12)

    def bigram(a, w):
        return two[a, w] if (a, w) in two else fail(left2[a], below2[a]) * uni(w)

    def trigram(z, a, w):
        return three[z, a, w] if (z, a, w) in three else fail(left3[z, a], below3[z, a]) * bigram(a, w) if (z, a) in two else bigram(a, w)

    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in lm.score_documents(docs).collect()}
    for i, t in rows[::7]:
        w = ["<s>", *tokens(t)]
        want = math.log10(bigram(*w[:2])) + sum(math.log10(trigram(*w[k : k + 3])) for k in range(len(w) - 2))
        assert math.isclose(got[i], want, rel_tol=1e-9), i
