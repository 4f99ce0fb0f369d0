import random

import pytest

from pagestrata.llm import jaccard_join
from pagestrata.llm.components import components
from pagestrata.llm.prefix_tree import link_roots


def sets_of(rows, k):
    out = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out.append((i, frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else (frozenset([tuple(w)]) if w else frozenset())))
    return out


def brute(rows, k, num, den):
    sets = sets_of(rows, k)
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and den * len(x & y) >= num * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for a in range(len(sets)):
        least[find(a)] = min(least.get(find(a), 1 << 60), sets[a][0])
    return sorted((i, len(s), least[find(a)]) for a, (i, s) in enumerate(sets))


def near_copies(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    bases = [[rng.choice(words) for _ in range(rng.choice([3, 5, 30, 80]))] for _ in range(6)]
    passage = [rng.choice(words) for _ in range(30)]
    rows = []
    for i in range(n):
        t = list(rng.choice(bases))
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = rng.choice(words)
        if rng.random() < 0.3:
            t += passage
        rows.append((i, " ".join(t)))
    return rows


@pytest.mark.parametrize(("k", "num", "den"), [(4, 85, 100), (5, 80, 100)])
def test_against_brute_force(spark, k, num, den):
    rows = near_copies(k, 150)
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), k, num, den).collect()
    assert sorted(map(tuple, got)) == brute(rows, k, num, den)


def test_blocks_give_the_same(spark, monkeypatch):
    rows = near_copies(3, 120)
    monkeypatch.setattr(jaccard_join, "FAMILY_TOKENS", 300)
    monkeypatch.setattr(jaccard_join, "RUN_BLOCK", 7)
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100).collect()
    assert sorted(map(tuple, got)) == brute(rows, 4, 85, 100)


def test_odd_rows(spark, odd_docs, no_docs):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(odd_docs, 4, 85, 100).collect()}
    assert {(1, 3, 1), (2, 0, 2), (3, 0, 3), (5, 3, 1), (6, 1, 6), (7, 1, 7)} <= got
    assert jaccard_join.jaccard_components(no_docs, 4, 85, 100).count() == 0
    nulls = spark.createDataFrame([(None, "a b c d e"), (1, "a b c d e")], "doc_id long, text string")
    assert sorted(map(tuple, jaccard_join.jaccard_components(nulls, 4, 85, 100).collect()), key=str) == [(1, 2, 1), (None, 2, None)]
    kept = jaccard_join.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 4, 6, 7]


def test_prefix_tree():
    import numpy as np

    rng = random.Random(5)
    sets = list({tuple(sorted(rng.sample(range(40), rng.randint(1, 20)))) for _ in range(120)})
    arrays = [np.array(s, dtype=np.uint64) for s in sets]
    got = link_roots(arrays, 6, 10)
    seen = list(range(len(sets)))
    for _ in sets:
        for a in range(len(sets)):
            for b in range(len(sets)):
                x, y = set(sets[a]), set(sets[b])
                if 10 * len(x & y) >= 6 * len(x | y):
                    seen[a] = min(seen[a], seen[b])
    assert got == seen


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 9), (7, 8), (8, 7), (3, 10), (20, 21), (21, 22), (22, 23), (23, 20)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {1: 1, 2: 1, 3: 1, 10: 1, 9: 9, 7: 7, 8: 7, 20: 20, 21: 20, 22: 20, 23: 20}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_one_by_id_and_text(spark):
    """Another text under the id of a copy stays; of equal rows one stays; null ids and empty texts stay."""
    a, u = " ".join(f"w{i}" for i in range(40)), " ".join(f"u{i}" for i in range(40))
    rows = [(1, a, 1), (5, a, 2), (5, u, 3), (1, a, 4), (None, a, 5), (9, "", 6), (10, None, 7), (9, "", 8), (5, a.upper(), 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node long")
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted(r["node"] for r in kept.collect())
    assert got in ([1, 3, 5, 6, 7, 8], [3, 4, 5, 6, 7, 8])


def test_many_texts_of_one_id_and_many_copies(spark):
    rows = [(7, " ".join(f"x{i} y{j} z{(i * j) % 7}" for j in range(12))) for i in range(120)] + [(100 + i, "the same few words in all of these rows") for i in range(400)]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100).collect()
    assert len(got) == 520 and {r["component_id"] for r in got} == {7, 100}
