"""A training corpus from ``documents``: quality, line dedup, near duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and reread as the next stage's docs. All but the last return
the columns of documents, whatever other columns these have and whatever their
names. An empty table gives an empty table. Texts are read whole, at any length,
by one task each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagestrata.llm import decontaminate, jaccard_join, line_dedup, packing, quality
from pagestrata.llm.common import materialize


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble rejects go.

    Rows are judged one by one by their texts: null and empty texts count as
    empty, repeated rows go or stay together, an id may be null or repeat, and
    a score of 0.5 counts as good. Without labels all stay.
    """
    return quality.keep_good(docs, _table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:  # noqa: ARG001
    """Later repeated runs of lines are cut from the texts; a changed text's n_chars is counted again.

    No row goes: a text all of whose lines are cut is empty. Null texts stay
    null; null ids come first; of texts of one id the one of least hash comes
    first; rows equal in id and text are one document and stay alike.
    """
    cut = line_dedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("removed_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return cut.select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:  # noqa: ARG001
    """Of documents linked by a similarity of 0.8 on five-word shingles the one of least doc_id stays.

    Rows are told apart by id and text: of one id's texts in a group that of
    least hash stays, of equal rows one. Rows with a null id, and those without
    words, all stay.
    """
    return jaccard_join.keep_one(docs, 5, 80, 100)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item within its edits go.

    Rows are told apart by id (null is one) and text, so a clean text under the
    id of a contaminated one stays. Null and empty texts and items match
    nothing; an empty benchmark leaves all.
    """
    return decontaminate.remove_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:  # noqa: ARG001
    """Token pieces of all documents in sequences of at most 1024.

    Null and empty texts have the end id alone; repeated rows are packed as
    often as they stand; a null id stays null.
    """
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("best-fit packing", packing_stage),
]

#: Fitted rules, edit distances and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
