"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize


def _least(pairs: DataFrame) -> DataFrame:
    """pairs(u, v) with ``m``, the least of u and its neighbours; partial sums meet a hot u's rows before the shuffle."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return pairs.join(least, "u")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """For edges(a, b), long: every vertex that has an edge, with the least vertex it can reach: (vertex, root).

    Repeated edges, loops and either direction are allowed; an edge with a null
    end is ignored; no edges give no rows. Each round is written to the shared
    folder. A star graph is reached in O(log n) rounds; an unfinished graph
    after ``rounds`` raises an error.
    """
    loops = edges.filter(F.col("a") == F.col("b")).select(F.col("a").alias("vertex"))
    now = materialize(edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    sign = F.xxhash64("u", "v").cast("decimal(38,0)")
    before = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small = _least(large)
        small = small.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("p")).select(F.col("p.v").alias("u"), F.col("p.m").alias("v"))
        then, now = now, materialize(small.filter("u <> v").distinct(), "stars")
        forget(then)
        after = tuple(now.agg(F.count("*"), F.sum(sign)).first())
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components: not finished")
    found = now.select(F.col("u").alias("vertex"), F.col("v").alias("root"))
    roots = now.select(F.col("v").alias("vertex")).distinct().withColumn("root", F.col("vertex"))
    done = found.unionByName(roots)
    alone = loops.distinct().join(done.select("vertex"), "vertex", "left_anti").withColumn("root", F.col("vertex"))
    return done.unionByName(alone)
