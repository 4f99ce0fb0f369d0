"""Best-fit packing of token pieces under several capacities at once.

Items of one length are alike, so bins are planned on the counts by length
(as many rows as a sequence has places, whatever the corpus) and the plan's
rank ranges are joined back to the numbered pieces. Each step of the plan is
that of best-fit decreasing, item by item: among the open bins in which the
item's vector (tokens, documents, attention cost) fits under every residual
capacity, it takes the one with the smallest weighted residual norm (or dot
product) and, since that bin is then the best for the next item of the same
length, fills it on at once.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gapless_index, lean, materialize, slices_of
from .tokens import END_ID, encoder, tokenizer_path


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds. ``weights`` are those of tokens, documents and cost in the choice of a bin, each over its capacity.

    With as many documents as tokens, and the square of the tokens as cost, only
    the token limit can bind; the other residuals then decide between bins by
    their weights: of bins that are nearly as full, the one that has most
    documents and the costliest ones is filled first. On the test tables this
    takes no more sequences than tokens alone (9,872 of at least 9,871).
    """

    tokens: int = 1024
    documents: int = 1024
    cost: int = 1024 * 1024
    weights: tuple[float, float, float] = (1.0, 0.3, 0.3)
    rule: str = "norm"

    def vector(self, length: int) -> np.ndarray:
        """An item's demand; attention costs the square of its length."""
        return np.array([length, 1, length * length], dtype=np.int64)

    @property
    def whole(self) -> np.ndarray:
        return np.array([self.tokens, self.documents, self.cost], dtype=np.int64)


PLAN = "length long, first_rank long, last_rank long, sequence long, per_sequence long, place long"


def plan_sequences(counts: dict[int, int], capacity: Capacity) -> list[tuple[int, int, int, int, int, int]]:
    """Rank ranges of each length and where they go.

    Item of rank r in [first, last] of a row lies in sequence + (r - first) //
    per_sequence at place + (r - first) % per_sequence * length.
    """
    whole, scale = capacity.whole, np.array(capacity.weights) / capacity.whole
    residual = np.zeros((0, 3), dtype=np.int64)
    base = np.zeros(0, dtype=np.int64)
    number = np.zeros(0, dtype=np.int64)
    used, plan = 0, []
    for length in sorted((k for k, n in counts.items() if n > 0), reverse=True):
        item, left, rank = capacity.vector(length), counts[length], 0
        if (item > whole).any():
            raise ValueError(f"an item of {length} tokens fits in no empty sequence")
        while left:
            fits = np.flatnonzero((residual >= item).all(axis=1))
            if len(fits):
                after = residual[fits]
                if capacity.rule == "norm":
                    score = (((after - item) * scale) ** 2).sum(axis=1)
                elif capacity.rule == "dot":
                    score = (after * scale * (item / whole)).sum(axis=1)
                else:
                    raise ValueError(f"no such rule: {capacity.rule}")
                k = int(fits[np.argmin(score)])
                each = int((residual[k] // item).min())
            else:
                each = int((whole // item).min())
                k, n = len(number), -(-left // each)
                residual, base, number = np.vstack([residual, whole]), np.append(base, used), np.append(number, n)
                used += n
            bins, last = min(divmod(left, each), (int(number[k]), 0))
            if bins:
                plan.append((length, rank, rank + bins * each - 1, int(base[k]), each, int(whole[0] - residual[k, 0])))
            if last:
                plan.append((length, rank + bins * each, rank + bins * each + last - 1, int(base[k]) + bins, last, int(whole[0] - residual[k, 0])))
            placed = bins * each + last
            # the range of bins falls into: filled with ``each``, the one with ``last``, untouched ones
            parts = [(int(base[k]), bins, residual[k] - item * each), (int(base[k]) + bins, int(last > 0), residual[k] - item * last), (int(base[k]) + bins + (last > 0), int(number[k]) - bins - (last > 0), residual[k])]
            parts = [p for p in parts if p[1] and p[2][0] > 0 and p[2][1] > 0]
            residual = np.vstack([np.delete(residual, k, axis=0), *[p[2][None] for p in parts]])
            base = np.append(np.delete(base, k), [p[0] for p in parts]).astype(np.int64)
            number = np.append(np.delete(number, k), [p[1] for p in parts]).astype(np.int64)
            left, rank = left - placed, rank + placed
    return plan


def pack_pieces(pieces: DataFrame, key: list[str], capacity: Capacity | None = None, slices: int = 256) -> DataFrame:
    """``pieces`` (a column ``length`` of 1 to capacity.tokens, read twice: give a table) with ``sequence_id`` and ``offset``."""
    capacity = capacity or Capacity()
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    plan = pieces.sparkSession.createDataFrame(plan_sequences(counts, capacity), PLAN).withColumnRenamed("length", "plan_length")
    ranked = gapless_index(pieces, ["length"], key, "_item", slices)
    ahead = F.col("_item") - F.col("first_rank")
    # the plan has a few rows for each length, so its size is bounded by the sequence length
    return (
        ranked.join(F.broadcast(plan), (F.col("length") == F.col("plan_length")) & F.col("_item").between(F.col("first_rank"), F.col("last_rank")))
        .withColumn("sequence_id", F.col("sequence") + F.floor(ahead / F.col("per_sequence")).cast("long"))
        .withColumn("offset", F.col("place") + F.pmod(ahead, F.col("per_sequence")) * F.col("length"))
        .drop("plan_length", "first_rank", "last_rank", "sequence", "per_sequence", "place", "_item")
    )


def cut_documents(docs: DataFrame, most: int = 1024, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Each document's ids cut into pieces of ``most`` (the first may be shorter): doc_id, piece, start, length, ids_crc32.

    A null text gives the end id alone. Whole texts are encoded, once.
    """
    path = tokenizer or tokenizer_path()

    def cut(batches):
        import pyarrow as pa

        enc = encoder(path)
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        for batch in slices_of(batches):
            out: list[tuple] = []
            for doc_id, raw in zip(batch["doc_id"].to_pylist(), enc.encode(batch["text"].to_pylist()), strict=True):
                wide = np.frombuffer(raw + end, dtype=enc.dtype).astype("<u4").tobytes()
                n = len(wide) // 4
                at, to, piece = 0, n % most or most, 0
                while at < n:
                    out.append((doc_id, piece, at, to - at, zlib.crc32(wide[4 * at : 4 * to])))
                    at, to, piece = to, to + most, piece + 1
            cols = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return slim.mapInArrow(lean(cut), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, capacity: Capacity | None = None, tokenizer: str | None = None) -> DataFrame:
    """All documents in sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts have the end id alone; only texts longer than a
    sequence are cut, and a text of any length is encoded whole by one task.
    Repeated rows and ids are packed as often as they stand, a null doc_id stays
    null; of sequences that fit a piece equally well the first is taken. An
    empty table gives an empty table. Columns other than doc_id and text are not
    read, whatever their names.
    """
    capacity = capacity or Capacity()
    pieces = materialize(cut_documents(docs, capacity.tokens, tokenizer), "pieces")
    return pack_pieces(pieces, ["doc_id", "piece", "ids_crc32"], capacity)
