"""Page selection, running offsets and labels."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import page_label


def select_pages(pages: DataFrame, numbers: Iterable[int] | None = None, most: int = 0) -> DataFrame:
    """Pages in document order: of the given numbers (from 1; unknown ones and repeats are ignored), then the first ``most``."""
    out = pages
    if numbers is not None:
        wanted = sorted(set(numbers))
        if any(n < 1 for n in wanted):
            raise ValueError("page numbers begin at 1")
        out = out.filter(F.col("page_no").isin(wanted))
    if most > 0:
        out = out.withColumn("_k", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_no"))).filter(F.col("_k") <= most).drop("_k")
    return out


def parse_page_spec(spec: str) -> list[int]:
    """'1,3-5' as [1, 3, 4, 5]."""
    out: list[int] = []
    for part in spec.split(","):
        a, _, b = part.strip().partition("-")
        out += range(int(a), int(b or a) + 1)
    return out


def normalize_numbers(numbers: Iterable[int], base: int = 1) -> list[int]:
    """Page numbers that count from ``base`` (0 or 1) as numbers from 1, sorted, each once; raises below the base."""
    wanted = sorted(set(numbers))
    if base not in (0, 1) or any(n < base for n in wanted):
        raise ValueError(f"page numbers begin at {base}")
    return [n + 1 - base for n in wanted]


def with_doctop(pages: DataFrame) -> DataFrame:
    """Add initial_doctop, the summed heights of the pages before among those given."""
    before = Window.partitionBy("doc_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
    return pages.withColumn("initial_doctop", F.coalesce(F.sum("height").over(before), F.lit(0.0)))


def with_labels(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """Add page_label from label ranges (doc_id, first_page from 1, style, prefix, start): the last range that begins at or before a page.

    Ranges and pages are merged in one sorted window, an as-of join without a range join.
    """
    a = ranges.select("doc_id", F.col("first_page").cast("int").alias("page_no"), F.struct("first_page", "style", "prefix", "start").alias("_range"), F.lit(0).alias("_kind"))
    rows = pages.withColumn("_kind", F.lit(1)).unionByName(a, allowMissingColumns=True)
    order = Window.partitionBy("doc_id").orderBy("page_no", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    r = F.last("_range", ignorenulls=True).over(order)
    out = rows.withColumn("_r", r).filter("_kind = 1")
    number = F.col("_r.start") + F.col("page_no") - F.col("_r.first_page")
    return out.withColumn("page_label", F.when(F.col("_r").isNotNull(), page_label(F.col("_r.style"), F.col("_r.prefix"), number))).drop("_r", "_range", "_kind")
