"""A stream of files: each new file goes through the same plan as in batch."""

from __future__ import annotations

import asyncio
from collections.abc import AsyncIterator, Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType, TimestampType

FILES = StructType([StructField("path", StringType()), StructField("modificationTime", TimestampType()), StructField("length", LongType()), StructField("content", BinaryType())])


def file_stream(spark: SparkSession, path: str, pattern: str = "*.pdf", files_per_batch: int = 50) -> DataFrame:
    """doc_id, modified, content of files as they come; at most so many in a micro-batch."""
    got = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).load(path)
    return got.select(F.col("path").alias("doc_id"), F.col("modificationTime").alias("modified"), "content")


def run_stream(files: DataFrame, plan: Callable[[DataFrame], DataFrame], output: str, checkpoint: str, once: bool = True):
    """Apply a batch plan to each micro-batch and append its rows, by batch, to Parquet in ``output``.

    A batch that is run again after a failure replaces its own folder.
    """

    def write(batch: DataFrame, number: int) -> None:
        plan(batch).write.mode("overwrite").parquet(f"{output}/batch={number}")

    writer = files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def ordered_rows(df: DataFrame, *order: str) -> Iterator[Row]:
    """Rows in order, a partition at a time, the next one fetched ahead."""
    return df.repartitionByRange(*order).sortWithinPartitions(*order).toLocalIterator(prefetchPartitions=True)


def cancellable(spark: SparkSession, tag: str) -> Callable[[], None]:
    """Tag this thread's queries; the returned function stops those that run."""
    spark.addTag(tag)
    return lambda: spark.interruptTag(tag) and None


class Cursor:
    """Rows in order, once: next row or None, and an end at any time, which stops the query that feeds it."""

    def __init__(self, df: DataFrame, *order: str):
        self.spark, self.tag = df.sparkSession, f"cursor-{id(self)}-{id(df)}"
        self.spark.addTag(self.tag)
        try:
            self.rows: Iterator[Row] | None = ordered_rows(df, *order)
        finally:
            self.spark.removeTag(self.tag)

    def next(self) -> Row | None:
        if self.rows is None:
            return None
        row = next(self.rows, None)
        if row is None:
            self.rows = None
        return row

    def cancel(self) -> None:
        self.rows = None
        self.spark.interruptTag(self.tag)

    @property
    def closed(self) -> bool:
        return self.rows is None

    def __iter__(self) -> Iterator[Row]:
        while (row := self.next()) is not None:
            yield row


async def rows_async(df: DataFrame, *order: str) -> AsyncIterator[Row]:
    """Rows in order, each waited for in a thread, so that other tasks run meanwhile."""
    rows = await asyncio.to_thread(ordered_rows, df, *order)
    while (row := await asyncio.to_thread(next, rows, None)) is not None:
        yield row


class PageList:
    """The pages of one document by position: length, negative positions and slices are filters, rows are kept once read."""

    def __init__(self, pages: DataFrame, doc_id: str):
        self.pages = pages.filter(F.col("doc_id") == doc_id)
        self.kept: dict[int, Row] = {}
        self.size: int | None = None

    def __len__(self) -> int:
        if self.size is None:
            self.size = self.pages.count()
        return self.size

    def __getitem__(self, at: int | slice) -> Row | list[Row]:
        if isinstance(at, slice):
            wanted = list(range(len(self)))[at]
            self._read([k for k in wanted if k not in self.kept])
            return [self.kept[k] for k in wanted]
        k = at + len(self) if at < 0 else at
        if not 0 <= k < len(self):
            raise IndexError(at)
        self._read([k] if k not in self.kept else [])
        return self.kept[k]

    def _read(self, places: list[int]) -> None:
        if places:
            for row in self.pages.filter(F.col("page_no").isin([k + 1 for k in places])).toLocalIterator():
                self.kept[row["page_no"] - 1] = row

    def __iter__(self) -> Iterator[Row]:
        return ordered_rows(self.pages, "page_no")
