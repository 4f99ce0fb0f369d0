import zlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagestrata.llm import sharding


def jump(key: int, n: int) -> int:
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * sharding.MULTIPLIER + 1) & ((1 << 64) - 1)
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_hash_is_the_published_one(spark):
    keys = [*range(200), -1, 2**63 - 1, -(2**63), 123456789012345678]
    for n in (1, 2, 8, 9, 300):
        got = spark.createDataFrame([(k,) for k in keys], "k long").select("k", sharding.jump_hash(F.col("k"), n).alias("s")).collect()
        assert {r["k"]: r["s"] for r in got} == {k: jump(k, n) for k in keys}


def test_digest(spark, odd_docs, no_docs):
    rows = sharding.shard_digest(odd_docs, 8).collect()
    assert len(rows) == 8
    for r in rows:
        assert r["shard"] == jump(r["doc_id"], 8) and r["grown_shard"] in (r["shard"], 8)
    texts = {(r["doc_id"], r["text"]) for r in odd_docs.collect()}
    for i, t in texts:
        assert any(r["doc_id"] == i and r["size"] == len((t or "").encode()) + 1 and r["text_crc32"] == zlib.crc32((t or "").encode()) for r in rows)
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.shard_digest(no_docs, 8).count() == 0


def test_operator_keeps_other_columns(odd_docs):
    out = sharding.shard_documents(odd_docs, 4)
    assert set(out.columns) == set(odd_docs.columns) | {"slot", "grown_shard"}
    assert out.filter("shard > 3").count() == 0


@settings(max_examples=30, deadline=None)
@given(st.integers(-(2**63), 2**63 - 1), st.integers(1, 60))
def test_growth_moves_only_into_the_new_shard(key, n):
    assert jump(key, n + 1) in (jump(key, n), n)
