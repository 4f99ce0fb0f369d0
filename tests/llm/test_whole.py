"""The pipeline and the contract queries against plain versions, and odd rows in every operator."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pagestrata.llm import ann, decontaminate, jaccard_join, line_dedup, lm, packing, pii, quality, sharding, sstable

from .test_decontaminate import brute as edit_distance
from .test_lines import maximal_runs


def plain_ids(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text or "", add_special_tokens=False).ids, 2]


def shingles(text, k=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def plain_groups(rows):
    """The least id of each text's group, links being a Jaccard similarity of 0.8 of five-word shingles."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_pipeline_against_plain_stages(spark, tmp_path):
    rng = random.Random(21)
    words = [f"w{i}" for i in range(900)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, item = prose(30), prose(25)
    texts = []
    for i in range(50):
        lines = [prose(rng.randint(8, 40)) for _ in range(rng.randint(1, 4))]
        if i % 7 == 0:
            lines.insert(rng.randrange(len(lines) + 1), passage)
        if i % 9 == 4:
            got = item.split()
            got[rng.randrange(25)] = "changed"
            lines.append("see " + " ".join(got))
        texts.append("\n".join(lines))
    for i in range(6):  # near copies, and a chain of them
        got = texts[3 * i + 1].split(" ")
        got[len(got) // 2] = "other"
        texts.append(" ".join(got))
    texts += [" ".join("$$##" for _ in range(50)) + f" {i}" for i in range(30)]  # junk
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 56), 0) for i in range(len(texts))], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    kept = [(i, t) for i, t in enumerate(texts) if i < 56]
    cut = maximal_runs_by_hash(spark, kept)
    group = plain_groups(cut.items())
    single = [(i, t) for i, t in cut.items() if group[i] == i]
    clean = [(i, t) for i, t in single if edit_distance(decontaminate.normal_words(item), decontaminate.normal_words(t)) > 5]
    assert 0 < len(clean) < len(single) < len(kept)

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    by_doc = {}
    for r in sorted(got, key=lambda r: (r["doc_id"], r["piece"])):
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert set(by_doc) == {i for i, _ in clean}
    for i, t in clean:
        ids = np.array(plain_ids(t), dtype="<u4")
        at = 0
        for r in by_doc[i]:
            assert (r["start"], r["ids_crc32"]) == (at, zlib.crc32(ids[at : at + r["length"]].tobytes()))
            at += r["length"]
        assert at == len(ids)
    total = sum(r["length"] for r in got)
    assert len({r["sequence_id"] for r in got}) <= -(-total // 1024) + 1


def maximal_runs_by_hash(spark, rows):
    """``maximal_runs`` of documents of different ids."""
    return maximal_runs(rows, line_dedup.MIN_WORDS)


def test_held_out_quality(spark):
    rng = random.Random(5)
    good = lambda: " ".join(rng.choice(["the", "river", "runs", "below", "old", "stone", "walls", "and", "fields"]) for _ in range(rng.randint(30, 200))) + "."
    bad = [lambda: " ".join("BUY!!" for _ in range(60)), lambda: "|".join("x" for _ in range(80)), lambda: "word " * 90, lambda: "$%&" * 50]
    rows, labels = [], []
    for i in range(900):
        q = int(rng.random() < 0.6)
        rows.append((i, good() if q else rng.choice(bad)()))
        labels.append((i, q, 0))
    got = quality.quality_digest(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    held = [(r["predicted"], labels[r["doc_id"]][1]) for r in got if r["held_out"]]
    assert len(held) > 200 and np.mean([a == b for a, b in held]) >= 0.97
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)


ODD = "doc_id long, text string, row string, key string, h long, _row string, _slice int, _rank int, _named string, _changed string, told_by int, named int, changed int, slot int, score double, replaced int"


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids and texts, empty and blank texts, a long text, ties, repeated rows, columns named like the operators' own."""
    texts = [(None, "no id here 4111 1111 1111 1111"), (None, None), (1, "one and the same"), (1, "one and the same"), (1, "other text"), (2, ""), (3, " \n"), (4, None), (5, "word " * 20000)]
    return spark.createDataFrame([(i, t, "r", "k", 1, "u", 2, 3, "n", "c", 4, 5, 6, 7, 0.25, 8) for i, t in texts], ODD)


def test_odd_rows_in_operators_that_keep_columns(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "one and the same")], "item_id long, text string")
    ways = {
        "shards": (lambda d: sharding.shard_documents(d, 3), 9),
        "pseudonyms": (lambda d: pii.pseudonymize(d, "k"), 9),
        "scores": (lambda d: quality.score_documents(d, quality.train(d, labels)), 9),
        "lines": (lambda d: line_dedup.dedup_lines(d, 3), 9),
        "one of each": (jaccard_join.keep_one, 8),
        "clean": (lambda d: decontaminate.remove_contaminated(d, items), 7),
    }
    own = {"slot", "shard", "grown_shard", "score", "predicted", "replaced", "kinds", "n_lines", "removed_lines"}
    for name, (way, rows) in ways.items():
        out = way(odd)
        got = out.collect()
        assert len(got) == rows and set(out.columns) >= set(odd.columns), name
        for c, v in zip(odd.columns[2:], ("r", "k", 1, "u", 2, 3, "n", "c", 4, 5, 6, 7, 0.25, 8), strict=True):
            if c not in own:
                assert all(r[c] == v for r in got), (name, c)
        none = way(odd.limit(0))
        assert none.count() == 0 and none.columns == out.columns, name
    slots = sorted((r["shard"], r["slot"]) for r in sharding.shard_documents(odd, 3).collect())
    assert slots == [(s, k) for s in sorted({s for s, _ in slots}) for k in range(sum(x == s for x, _ in slots))]
    hidden = {r["text"] for r in pii.pseudonymize(odd, "k").collect()}
    assert "no id here 4111 1111 1111 1111" not in hidden and len(hidden) == 7


def test_odd_rows_in_operators_that_give_digests(spark, odd):
    ways = {
        "packing": (packing.pack_documents, 9),
        "jaccard": (lambda d: jaccard_join.jaccard_components(d, 4, 85, 100), 9),
        "tables": (sstable.roundtrip, 9),
        "model": (lm.score_documents, 9),
        "shards": (lambda d: sharding.shard_digest(d, 8), 9),
    }
    for name, (way, rows) in ways.items():
        got = way(odd).collect()
        seen = [r for r in got if r["piece"] == 0] if name == "packing" else got
        assert len(seen) == rows and sum(r["doc_id"] is None for r in seen) == 2, name
        assert way(odd.limit(0)).count() == 0, name
    from_files = sorted((r["start"], r["n_tokens"]) for r in sstable.roundtrip(odd).collect())
    assert [s for s, _ in from_files] == np.cumsum([0, *(n for _, n in from_files)])[:-1].tolist()


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [1.0, 1.0]), (None, [1.0, 0.5]), (7, [1.0, 0.0]), (8, [1.0, 2.0, 3.0]), (50, [3.0, 0.0])]
    v = spark.createDataFrame([(i, x, 1, 2) for i, x in rows], "vec_id long, embedding array<double>, h long, cell int")
    got = ann.nearest(v, v.filter(F.col("vec_id") % 50 == 0)).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in got] == [(0, 1), (0, 7), (0, 50), (0, 6), (50, 0), (50, 1), (50, 7), (50, 6)]
    assert [r["rank"] for r in got] == [1, 2, 3, 4] * 2 and abs(got[3]["score"] - 2**-0.5) < 1e-12
