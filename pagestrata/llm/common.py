"""Shared helpers: scratch tables, gapless ranks, word hashing."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager, suppress

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the session names none, one is set: a temporary folder under a local
    master, else a folder in the warehouse.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
    found = "file://" + tempfile.mkdtemp(prefix="strata-") if local else spark.conf.get("spark.sql.warehouse.dir") + "/_scratch"
    spark.conf.set("spark.checkpoint.dir", found)
    spark.sparkContext.setCheckpointDir(found)
    return found


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Holds while a table is written: small Arrow batches bound the memory of Python workers (rows differ in length, so a
#: count of rows does not), and a shuffle's files go when the table that was made of them stands.
WRITING = {"spark.sql.execution.arrow.maxBytesPerBatch": "4m", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """The session with other settings for a while."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a Parquet table in the shared folder and read it back.

    This cuts the lineage with replicated storage: a lost executor costs a
    reread, never a recomputation of what stands before. ``forget`` deletes it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with settings(spark, WRITING):
        df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._scratch = path
    return back


def materialize_by(df: DataFrame, key: str, name: str) -> DataFrame:
    """Like ``materialize``, dealt out by ``key`` into as many buckets as a shuffle has partitions: joins by it leave the table where it is."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    table = path.rsplit("/", 1)[-1].replace("-", "_")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with settings(spark, WRITING):
        df.repartition(n, key).write.option("compression", "zstd").option("path", path).bucketBy(n, key).saveAsTable(table)
    back = spark.table(table)
    back._scratch, back._table = path, table
    return back


def forget(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing will read again."""
    for t in tables:
        spark = t.sparkSession
        if "_table" in t.__dict__:
            spark.sql(f"DROP TABLE IF EXISTS {t._table}")
        at = spark._jvm.org.apache.hadoop.fs.Path(t._scratch)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def lean(work: Callable) -> Callable:
    """``work`` for mapInArrow, in a worker that keeps no freed memory: not in Arrow's pool, and at the end not in the allocator."""

    def run(batches):
        import pyarrow as pa

        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from work(batches)
        finally:
            trim()

    return run


def trim() -> None:
    """Give freed memory back to the system, where the allocator can."""
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def drop_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` without columns that would clash (any case) with ``names``."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def gapless_index(df: DataFrame, by: list[str], order: list[str], out: str, slices: int = 256) -> DataFrame:
    """Number the rows of each group ``by`` from 0 without gaps.

    A group is cut into ``slices`` by a hash of ``order``; rows are ranked
    inside a slice and shifted by the summed counts of the slices before, so
    that no task holds a whole group, whatever its size. Rows equal in
    ``order`` get different numbers in any order.
    """
    at = F.pmod(F.xxhash64(*order), F.lit(slices)).cast("int")
    cut = df.withColumn("_slice", at)
    counts = cut.groupBy(*by, "_slice").count()
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(
        *[F.col(b).alias(f"_b_{b}") for b in by],
        F.col("_slice").alias("_b_slice"),
        F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"),
    )
    within = Window.partitionBy(*by, "_slice").orderBy(*order)
    ranked = cut.withColumn("_rank", F.row_number().over(within) - 1)
    on = [F.col(b).eqNullSafe(F.col(f"_b_{b}")) for b in by] + [F.col("_slice") == F.col("_b_slice")]
    joined = ranked.join(base, on, "inner")
    return joined.withColumn(out, (F.col("_base") + F.col("_rank")).cast("long")).drop(
        "_slice", "_rank", "_base", "_b_slice", *[f"_b_{b}" for b in by]
    )


def slices_of(batches, rows: int = 1000, size: int = 2_000_000):
    """Arrow batches cut into smaller ones of at most ``rows`` rows, and about ``size`` bytes unless one row has more."""
    for batch in batches:
        step = max(1, min(rows, int(batch.num_rows * size / max(1, batch.nbytes))))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


#: The most bits of a filter of ids (16 MB), the bits for each id, and those of one row of it.
FILTER_BITS, ID_BITS, ROW_BITS = 1 << 27, 16, 1 << 15


def split_by(df: DataFrame, key: str, ids: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose long ``key`` may be in ``ids``, rows whose key is surely not), for keeping the latter out of a shuffle before a join.

    By a bitmap of hashed ids with ID_BITS bits for each, FILTER_BITS in all,
    which is broadcast; where these would be too few to tell rows apart, all
    rows may be in. The keys are hashes already. Rows with a null key are not
    in. No Python takes part.
    """
    few = ids.select(F.col(column).alias("_id")).filter("_id is not null")
    count = few.count()
    if count * ID_BITS > 4 * FILTER_BITS:
        return df.filter(F.col(key).isNotNull()), df.filter(F.col(key).isNull())
    rows = max(1, min(FILTER_BITS, 1 << int(count * ID_BITS).bit_length()) // ROW_BITS)
    place = lambda c: F.pmod(c, F.lit(rows * ROW_BITS))
    row = lambda c: F.floor(place(c) / ROW_BITS).cast("int")
    bits = few.groupBy(row(F.col("_id")).alias("_bits_row")).agg(F.bitmap_construct_agg(F.pmod(F.col("_id"), F.lit(ROW_BITS))).alias("_bits"))
    # as a table, so that both halves read the same one
    bits = materialize(bits, "filter")
    marked = df.join(F.broadcast(bits), row(F.col(key)) == F.col("_bits_row"), "left")
    at = F.pmod(F.col(key), F.lit(ROW_BITS))
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(at / 8) + 1).cast("int"), 1)), 16, 10).cast("int")
    one = F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod(at, F.lit(8)))), F.lit(2)) == 1
    maybe = F.coalesce(one, F.lit(False))
    drop = ("_bits_row", "_bits")
    return marked.filter(maybe).drop(*drop), marked.filter(~maybe).drop(*drop)


def crc32_of(column: Column) -> Column:
    """Unsigned crc32 of a text's UTF-8 bytes; null counts as empty."""
    return F.crc32(F.coalesce(column, F.lit("")).cast("binary"))


def id_remainder(column: Column, mod: int) -> Column:
    """crc32 of an id written as text, modulo ``mod`` (null: as an empty text)."""
    return crc32_of(column.cast("string")) % F.lit(mod)
