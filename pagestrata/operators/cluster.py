"""Tolerance clustering, snapping and joining of edges, as windows over gaps and islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cluster_1d(df: DataFrame, by: list[str], value: Column, tolerance: float | Column, out: str = "cluster") -> DataFrame:
    """Number clusters of ``value`` in each ``by`` from 0: a new one begins where a value lies more than ``tolerance`` beyond the one before."""
    order = Window.partitionBy(*by).orderBy("_value")
    rows = df.withColumn("_value", value)
    by_how_much = tolerance if isinstance(tolerance, Column) else F.lit(float(tolerance))
    gap = F.col("_value") > F.lag("_value").over(order) + by_how_much
    return rows.withColumn("_new", F.when(gap, 1).otherwise(0)).withColumn(out, F.sum("_new").over(order.rangeBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_value", "_new")


def cluster_runs(df: DataFrame, by: list[str], value: Column, tolerance: float, seq: str = "seq", out: str = "run") -> DataFrame:
    """Consecutive rows (by ``seq``) of one cluster, numbered from 0; a cluster may come in several runs."""
    order = Window.partitionBy(*by).orderBy(seq)
    rows = cluster_1d(df, by, value, tolerance, "_cluster")
    turn = F.col("_cluster") != F.lag("_cluster").over(order)
    return rows.withColumn("_turn", F.when(turn, 1).otherwise(0)).withColumn(out, F.sum("_turn").over(order).cast("int")).drop("_turn", "_cluster")


def snap_edges(edges: DataFrame, by: list[str], x_tolerance: float = 3.0, y_tolerance: float = 3.0) -> DataFrame:
    """Move vertical edges to the mean x0 of their cluster and horizontal ones to its mean top; edges without orientation go."""
    v = F.col("orientation") == "v"
    tolerance = F.when(v, F.lit(float(x_tolerance))).otherwise(F.lit(float(y_tolerance)))
    group = [*by, "orientation"]
    rows = edges.filter(F.col("orientation").isin("v", "h")).withColumn("_p", F.when(v, F.col("x0")).otherwise(F.col("top")))
    labelled = cluster_1d(rows, group, F.col("_p"), tolerance, "_at")
    mean = F.avg("_p").over(Window.partitionBy(*group, "_at"))
    # without a tolerance nothing moves, not even by a rounding
    moved = labelled.withColumn("_by", F.when(tolerance > 0, mean - F.col("_p")).otherwise(0.0))
    shift = {c: F.col(c) + F.when(v == (c in ("x0", "x1")), F.col("_by")).otherwise(0.0) for c in ("x0", "x1", "top", "bottom")}
    return moved.withColumns(shift).select(*edges.columns)


def join_edges(edges: DataFrame, by: list[str], x_tolerance: float = 3.0, y_tolerance: float = 3.0) -> DataFrame:
    """Join edges on one line whose ends are within a tolerance: by, object_type, orientation, box, width, height."""
    upright = F.col("orientation") == "v"
    rows = edges.filter("orientation is not null").select(
        *by,
        "orientation",
        "object_type",
        F.when(upright, F.col("x0")).otherwise(F.col("top")).alias("_at"),
        F.when(upright, F.col("top")).otherwise(F.col("x0")).alias("_from"),
        F.when(upright, F.col("bottom")).otherwise(F.col("x1")).alias("_to"),
        F.when(upright, F.lit(float(y_tolerance))).otherwise(F.lit(float(x_tolerance))).alias("_tol"),
    )
    order = Window.partitionBy(*by, "orientation", "_at").orderBy("_from", "_to", "object_type")
    reach = F.max("_to").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("_new", F.when(F.col("_from") > reach + F.col("_tol"), 1).otherwise(0)).withColumn("_island", F.sum("_new").over(order))
    joined = marked.groupBy(*by, "orientation", "_at", "_island").agg(F.min("_from").alias("_from"), F.max("_to").alias("_to"), F.min_by("object_type", F.struct("_from", "_to", "object_type")).alias("object_type"))
    v = F.col("orientation") == "v"
    box = joined.select(
        *by,
        "object_type",
        "orientation",
        F.when(v, F.col("_at")).otherwise(F.col("_from")).alias("x0"),
        F.when(v, F.col("_from")).otherwise(F.col("_at")).alias("top"),
        F.when(v, F.col("_at")).otherwise(F.col("_to")).alias("x1"),
        F.when(v, F.col("_to")).otherwise(F.col("_at")).alias("bottom"),
    )
    return box.withColumn("width", F.col("x1") - F.col("x0")).withColumn("height", F.col("bottom") - F.col("top"))


def merge_edges(edges: DataFrame, by: list[str], snap_x: float = 3.0, snap_y: float = 3.0, join_x: float = 3.0, join_y: float = 3.0) -> DataFrame:
    return join_edges(snap_edges(edges, by, snap_x, snap_y), by, join_x, join_y)
