"""Distinct rows in order, splits, picks, and a set of boxes that grows and shrinks."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import geometry


def ordered_distinct(df: DataFrame, values: Sequence[str], by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row, by ``order``, of each combination of ``values`` in each group ``by``."""
    first = Window.partitionBy(*by, *values).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def split(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """Rows for which a condition holds, and all others (also those where it is null)."""
    return df.filter(condition), df.filter(~F.coalesce(condition, F.lit(False)))


def filter_objects(df: DataFrame, test: Column | Callable[[dict], bool]) -> DataFrame:
    """Rows that pass: a column stays in the JVM; a function of a row (as a dict) goes to Python in Arrow batches."""
    if isinstance(test, Column):
        return df.filter(test)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield batch.filter(pa.array([bool(test(r)) for r in batch.to_pylist()], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def pick_least(df: DataFrame, by: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row of each group, the least by ``order``, by partial aggregation (no sort of whole groups)."""
    names = [c for c in df.columns if c not in by]
    key = F.struct(*[F.col(c).alias(f"k{i}") if isinstance(c, str) else c.alias(f"k{i}") for i, c in enumerate(order)])
    return df.groupBy(*by).agg(F.min_by(F.struct(*names), key).alias("_row")).select(*by, "_row.*")


class BoxIndex:
    """Boxes with a key, by page or any other columns: grown, shrunk and asked as tables; nothing is held outside Spark."""

    def __init__(self, boxes: DataFrame, by: Sequence[str], key: str, square: float = 32.0):
        self.boxes, self.by, self.key, self.square = boxes, list(by), key, square

    def _with(self, boxes: DataFrame) -> BoxIndex:
        return BoxIndex(boxes, self.by, self.key, self.square)

    def extend(self, *more: DataFrame) -> BoxIndex:
        """With other boxes; one whose key is there already takes its place."""
        new = reduce(DataFrame.unionByName, more)
        return self._with(self.remove(new).boxes.unionByName(new.select(*self.boxes.columns)))

    def remove(self, keys: DataFrame) -> BoxIndex:
        """Without the boxes whose ``by`` and key stand in ``keys``."""
        return self._with(self.boxes.join(keys.select(*self.by, self.key).distinct(), [*self.by, self.key], "left_anti"))

    def contains(self, keys: DataFrame) -> DataFrame:
        """The rows of ``keys`` that are in the index."""
        return keys.join(self.boxes.select(*self.by, self.key).distinct(), [*self.by, self.key], "left_semi")

    def find(self, queries: DataFrame, strict: bool = True) -> DataFrame:
        """Pairs (l_* of queries, r_* of the index) that overlap; strictly: with a common area."""
        return geometry.box_join(queries, self.boxes, self.by, self.square, strict)

    def any(self, queries: DataFrame) -> DataFrame:
        """The keys of queries with another box in them."""
        hit = self.find(queries).filter(F.col(f"l_{self.key}") != F.col(f"r_{self.key}"))
        return hit.select(*[F.col(f"l_{c}").alias(c) for c in (*self.by, self.key)]).distinct()

    def neighbours(self, queries: DataFrame, k: int) -> DataFrame:
        return geometry.nearest_boxes(queries, self.boxes, self.by, self.key, k)
