"""Sharding by jump consistent hashing (Lamping and Veach, 2014), DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc32_of, gapless_index

# Fixed value: the multiplier of the published generator.
MULTIPLIER = 2862933555777941757
_LIMBS = [(MULTIPLIER >> (16 * i)) & 0xFFFF for i in range(4)]
_MASK = (1 << 32) - 1


def _step(hi: Column, lo: Column) -> tuple[Column, Column]:
    """key * MULTIPLIER + 1 modulo 2**64, on 32-bit halves so that nothing overflows under ANSI."""
    m0, m1, m2, m3 = (F.lit(m).cast("long") for m in _LIMBS)
    mask = F.lit(_MASK).cast("long")
    low = lambda x: F.shiftleft(x.bitwiseAND(F.lit(0xFFFF).cast("long")), 16)
    full = lo * m0 + low(lo * m1) + F.lit(1).cast("long")
    carry = F.shiftright(full, 32) + F.shiftright(lo * m1, 16)
    high = carry + lo * m2 + low(lo * m3) + hi * m0 + low(hi * m1)
    return high.bitwiseAND(mask), full.bitwiseAND(mask)


def jump_hash(key: Column, shards: int, jumps: int = 256) -> Column:
    """The shard of ``key`` (long) among ``shards``; a null key counts as 0.

    A walk makes at most ``shards`` jumps and about ln(shards) on average.
    Beyond ``jumps`` shards the walk is cut at that many jumps and an
    unfinished one raises an error (chance below 1e-100) instead of giving a
    wrong shard.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    mask = F.lit(_MASK).cast("long")
    start = F.struct(
        F.shiftrightunsigned(key, 32).bitwiseAND(mask).alias("hi"),
        key.bitwiseAND(mask).alias("lo"),
        F.lit(0).cast("long").alias("b"),
        F.lit(0).cast("long").alias("j"),
    )

    def walk(acc: Column, _: Column) -> Column:
        hi, lo = _step(acc["hi"], acc["lo"])
        ahead = ((acc["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(hi, 1) + 1).cast("double"))).cast("long")
        moved = F.struct(hi.alias("hi"), lo.alias("lo"), acc["j"].alias("b"), ahead.alias("j"))
        return F.when(acc["j"] < F.lit(shards), moved).otherwise(acc)

    end = F.aggregate(F.sequence(F.lit(1), F.lit(min(shards, jumps))), start, walk)
    if shards <= jumps:
        return end["b"].cast("int")
    return F.when(end["j"] >= F.lit(shards), end["b"].cast("int")).otherwise(F.raise_error(F.lit("jump hash: too many jumps")))


def stable_key(*columns: str) -> Column:
    """A key for ids that are not integers: a 64-bit hash of them."""
    return F.xxhash64(*columns)


def shard_documents(docs: DataFrame, shards: int, key: str = "doc_id", slices: int = 256, grow: int = 1) -> DataFrame:
    """All rows with ``shard``, ``grown_shard`` (with ``grow`` shards more) and a gapless ``slot``.

    Key and shard count alone decide, so equal ids (repeated rows too) share a
    shard, and an appended shard takes rows only into itself. Null keys count
    as 0. Texts of any length, null and empty ones are carried as they are, and
    rows of one key are numbered in any order. An empty table gives an empty
    table. Input columns named like an output column are replaced; all others
    pass through, whatever their names.
    """
    taken = {"shard", "slot", "grown_shard"}
    columns = [c for c in docs.columns if c.lower() not in taken]
    # rows of one key are told apart by what else they have, so that a frequent key is shared out
    told_by = [F.col(f"`{c}`") for c, kind in docs.dtypes if c in columns and "map<" not in kind and "variant" not in kind]
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"),
        F.xxhash64(*told_by).alias("told_by"),
        F.col(f"`{key}`").alias("key"),
        jump_hash(F.col(f"`{key}`"), shards).alias("shard"),
        jump_hash(F.col(f"`{key}`"), shards + grow).alias("grown_shard"),
    )
    out = gapless_index(packed, ["shard"], ["key", "told_by"], "slot", slices)
    return out.select("row.*", "shard", "grown_shard", "slot")


def shard_digest(docs: DataFrame, shards: int) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``."""
    text = F.col("text")
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        crc32_of(text).alias("text_crc32"),
    )
    out = shard_documents(slim, shards).withColumn("law", F.lit("key"))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")

