import random

import numpy as np

from pagestrata.llm import decontaminate as d


def brute(item, text):
    best = len(item)
    for a in range(len(text) + 1):
        row = list(range(len(item) + 1))
        best = min(best, row[-1])
        for w in text[a : a + 2 * len(item)]:
            new = [row[0] + 1]
            for i, x in enumerate(item):
                new.append(min(row[i] + (x != w), row[i + 1] + 1, new[i] + 1))
            row = new
            best = min(best, row[-1])
    return best


def test_stretch_distance():
    rng = random.Random(2)
    for _ in range(40):
        item = [rng.randint(1, 5) for _ in range(rng.randint(1, 8))]
        text = [rng.randint(1, 5) for _ in range(rng.randint(0, 12))]
        assert d.stretch_distance(np.array(item), np.array(text, dtype=np.int64))[0] == brute(item, text)


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(12, 50)))) for i in range(25)]
    docs, truth = [], set()
    for n in range(200):
        t = [rng.choice(words) for _ in range(rng.randint(0, 300))]
        if n % 3 == 0:
            i, text = rng.choice(items)
            got = text.split()
            for _ in range(rng.randint(0, int(0.15 * len(got)))):
                got[rng.randrange(len(got))] = "changed"
            at = rng.randint(0, len(t))
            t[at:at] = got
            truth.add((n, i))
        docs.append((n, " ".join(t)))
    return items, docs, truth


def test_recall_and_no_false_hits(spark):
    items, docs, truth = corpus(4)
    got = d.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    pairs = {(r["doc_id"], r["item_id"]) for r in got}
    assert len(pairs & truth) >= 0.97 * len(truth) and not pairs - truth
    words = {i: d.normal_words(t) for i, t in items}
    texts = {i: d.normal_words(t) for i, t in docs}
    for r in got[:10]:
        assert r["distance"] == brute(words[r["item_id"]], texts[r["doc_id"]])


def test_blocks_and_odd_rows(spark, odd_docs, no_docs, monkeypatch):
    items = spark.createDataFrame([(1, "A plain, text of SOME words"), (2, None), (3, ""), (4, "x"), (5, "word1 item1 word2 item2")], "item_id long, text string")
    want = [(1, 1), (4, 5), (5, 1), (5, 1), (6, 4)]
    assert sorted((r["doc_id"], r["item_id"]) for r in d.contaminated(odd_docs, items).collect()) == want
    monkeypatch.setattr(d, "ITEM_BLOCK", 2)
    assert sorted((r["doc_id"], r["item_id"]) for r in d.contaminated(odd_docs, items).collect()) == want
    assert d.contaminated(no_docs, items).count() == 0
    assert d.contaminated(odd_docs, items.limit(0)).count() == 0
    kept = d.remove_contaminated(odd_docs, items)
    assert kept.columns == odd_docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 7]


def test_decisions_by_id_and_text(spark):
    """A clean text stays under the id of a contaminated one; null ids; columns named like the operator's own."""
    item = " ".join(f"w{i}" for i in range(20))
    rows = [(7, f"before {item} after", 1, "a"), (7, "a clean text of its own", 2, "b"), (None, f"null id {item}", 3, "c"), (None, "null id but clean", 4, "d"), (8, None, 5, "e"), (7, f"before {item} after", 6, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h long, _row string")
    kept = d.remove_contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert kept.columns == docs.columns and sorted(r["h"] for r in kept.collect()) == [2, 4, 5]


def test_all_pairs_with_insertions_and_deletions(spark):
    """Found pairs are those that brute force finds over every document and item."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(10, 40)))) for i in range(8)]
    docs = []
    for n in range(60):
        t = [rng.choice(words) for _ in range(rng.randint(0, 60))]
        if n % 2:
            got = rng.choice(items)[1].split()
            for _ in range(rng.randint(0, int(0.25 * len(got)))):
                at, kind = rng.randrange(len(got)), rng.randrange(3)
                got[at : at + (kind > 0)] = ["new"] if kind < 2 else []
            t[len(t) // 2 : len(t) // 2] = got
        docs.append((n, " ".join(t)))
    found = d.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = {}
    for n, t in docs:
        for i, x in items:
            a, b = x.split(), t.split()
            if (least := brute(a, b)) <= int(0.2 * len(a) + 1e-9):
                want[n, i] = least
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in found}
    assert set(got) <= set(want) and len(got) >= 0.99 * len(want) and all(want[k] == v for k, v in got.items())


def test_long_items_with_all_their_edits():
    rng = np.random.default_rng(9)
    items = [(i, " ".join(f"w{w}" for w in rng.integers(0, 5000, 300))) for i in range(12)]
    index = d.build_index(items)
    texts = []
    for n in range(60):
        words = items[n % 12][1].split()
        for at in rng.choice(300, 60, replace=False):
            words[at] = "changed"
        cut = set(rng.choice(300, 20, replace=False).tolist())
        words = [w for i, w in enumerate(words) if i not in cut or w != "changed"]
        texts.append(" ".join([f"x{i}" for i in range(int(rng.integers(0, 60)))] + words + ["y"] * 30))
    found = {(number, item) for number, item, *_ in d.search(index, texts)}
    assert len(found & {(n, n % 12) for n in range(60)}) >= 0.99 * 60
