import zlib

import numpy as np
from pyspark.sql import functions as F

from pagestrata.llm import packing, sstable, tokens
from pagestrata.llm.common import scratch_path


def plain(text):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokens.tokenizer_path())
    return [*tok.encode(text or "", add_special_tokens=False).ids, tokens.END_ID]


def test_encoder_equals_the_library():
    enc = tokens.encoder(tokens.tokenizer_path())
    texts = ["", " ", "a  b\n\n c", "it's \t x <|endoftext|> y", "naïve Ünï ｆｕｌｌ 日本 🎉 text", "don't we'll I'd", "a b\nc", "x y z", "1234 56,78", "\x1cq r", None]
    assert [[*np.frombuffer(x, enc.dtype).tolist(), tokens.END_ID] for x in enc.encode(texts)] == [plain(t) for t in texts]


def test_round_trip(spark, odd_docs, no_docs):
    rows = sorted(sstable.roundtrip(odd_docs).collect(), key=lambda r: r["start"])
    docs = sorted(((r["doc_id"], r["text"]) for r in odd_docs.collect()), key=lambda r: (r[0], r[1] or ""))
    at = 0
    for r, (i, t) in zip(rows, docs, strict=True):
        ids = plain(t)
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (i, at, len(ids))
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert sstable.roundtrip(no_docs).count() == 0


def test_table_lookup():
    w = sstable.Writer(2, block_bytes=200)
    ids = [None, -5, 0, *range(3, 400, 3)]
    for i in ids:
        w.add(sstable.make_key(i, 0), np.arange(abs(i or 1) % 50, dtype="<u2").tobytes())
    t = sstable.Table(w.finish())
    assert len(t.blocks) > 3 and [sstable.read_key(k) for k, _ in t] == ids
    for i in ids:
        assert t.get(i).tolist() == list(range(abs(i or 1) % 50))
    assert t.get(4) is None and t.get(10**9) is None and t.get(-6) is None


def test_small_files_roll(spark):
    docs = spark.createDataFrame([(i, f"text number {i} " * 40) for i in range(200)], "doc_id long, text string")
    folder = scratch_path(spark, "roll")
    manifest = sstable.write_shards(docs, folder, file_bytes=5000)
    assert manifest.count() > 5
    assert sstable.read_shards(spark, folder, manifest).agg(F.max(F.col("start") + F.col("n_tokens"))).first()[0] == sum(len(plain(f"text number {i} " * 40)) for i in range(200))


def check_packing(pieces, docs, most=1024):
    by_doc, by_seq = {}, {}
    for r in pieces:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for rows in by_seq.values():
        rows.sort(key=lambda r: r["offset"])
        at = 0
        for r in rows:
            assert r["offset"] == at
            at += r["length"]
        assert at <= most
    for i, texts in docs.items():
        want = []
        for t in texts:
            ids = plain(t)
            first = len(ids) % most or most
            cuts = [0, *range(first, len(ids) + 1, most)]
            want += [(k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
        assert sorted(want) == sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by_doc[i])
    return len(by_seq)


def test_packing(spark, odd_docs, no_docs):
    docs = {}
    for r in odd_docs.collect():
        docs.setdefault(r["doc_id"], []).append(r["text"])
    rows = packing.pack_documents(odd_docs).collect()
    n = check_packing(rows, docs)
    assert n <= -(-sum(r["length"] for r in rows) // 1024) + 1
    assert packing.pack_documents(no_docs).count() == 0


def brute_best_fit(counts, cap):
    """Item by item."""
    bins = []
    scale = np.array(cap.weights) / cap.whole
    for length in sorted(counts, reverse=True):
        v = cap.vector(length)
        for _ in range(counts[length]):
            fit = [(float((((b - v) * scale) ** 2).sum()), k) for k, b in enumerate(bins) if (b >= v).all()]
            if fit:
                bins[min(fit)[1]] = bins[min(fit)[1]] - v
            else:
                bins.append(cap.whole - v)
    return bins


def test_plan_equals_item_by_item_best_fit():
    rng = np.random.default_rng(0)
    for cap in (packing.Capacity(100, 100, 10_000), packing.Capacity(100, 3, 10_000), packing.Capacity(100, 50, 4_000, rule="norm")):
        for _ in range(15):
            counts = {int(k): int(rng.integers(1, 9)) for k in rng.integers(1, 60, size=12)}
            plan = packing.plan_sequences(counts, cap)
            bins = {}
            for length, a, b, seq, per, place in plan:
                for r in range(a, b + 1):
                    bins.setdefault(seq + (r - a) // per, []).append((place + (r - a) % per * length, length))
            for items in bins.values():
                items.sort()
                assert all(x[0] + x[1] == y[0] for x, y in zip(items, items[1:], strict=False)) and items[0][0] == 0
                assert sum(x[1] for x in items) <= cap.tokens and len(items) <= cap.documents and sum(x[1] ** 2 for x in items) <= cap.cost
            assert sum(len(x) for x in bins.values()) == sum(counts.values())
            assert len(bins) == len(brute_best_fit(counts, cap))


def test_other_residuals_decide_between_bins_at_no_loss():
    """The production settings: all three residuals choose, and no more sequences are taken than by tokens alone."""
    rng = np.random.default_rng(3)
    counts = {int(n): int(c) for n, c in zip(*np.unique(np.minimum(1024, rng.lognormal(5, 1.2, 6000).astype(int) + 1), return_counts=True))}
    plan, scalar = (packing.plan_sequences(counts, packing.Capacity(weights=w)) for w in (packing.Capacity().weights, (1.0, 0.0, 0.0)))
    used = lambda p: max(r[3] + (r[2] - r[1]) // r[4] for r in p) + 1
    assert plan != scalar and used(plan) <= used(scalar) + 1
    fill: dict[int, list[int]] = {}
    for length, first, last, sequence, each, place in plan:
        for r in range(last - first + 1):
            fill.setdefault(sequence + r // each, []).append((place + r % each * length, length))
    assert sum(map(len, fill.values())) == sum(counts.values())
    for items in fill.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 1024
    tight = packing.Capacity(documents=4, weights=(1.0, 0.3, 0.3))
    for row in packing.plan_sequences({10: 9, 500: 3}, tight):
        assert row[4] <= 4
