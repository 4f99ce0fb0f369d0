"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

Texts are words in lower case without ASCII punctuation. A document is
contaminated by an item of L words if some stretch of it is within
floor(RATE * L) word edits of the item.

* Where windows are looked at: an item that far away still shares a number of
  q-grams of words with the item (q-gram lemma), so stretches with fewer hits
  are passed over without losing any.
* There, windows of the items' sizes are embedded by CGK random walks
  (Chakraborty, Goldenberg, Koucky, 2016) and looked up by sampled coordinates
  in as many tables as it takes to find edited items with probability TARGET,
  measured for each size on seeded edits of items of that size, at any offset
  to the windows. Where MOST_TABLES miss it, every stretch with as many q-grams
  of an item as the lemma asks for is a candidate instead (lossless).
* Each candidate is verified by the exact edit distance to its best stretch.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import chain, repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, materialize, slices_of, split_by

RATE = 0.2
TARGET = 0.99
SAMPLED = 3
MOST_TABLES = 96
#: Edited items of a size that the number of tables is measured on.
TRIALS = 100
ITEM_BLOCK = 4000
#: Blocks whose tables go to the executors together, for one pass over the corpus.
PASS_BLOCKS = 8
_U = np.uint64
# ASCII punctuation.
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_END = b"\x00"


def normal_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().translate(None, PUNCTUATION).split() if text else []


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def embed_keys(windows: np.ndarray, length: int, tables: int, seed: int = 7) -> np.ndarray:
    """LSH keys (windows, tables) of rows of word ids, -1 beyond a row's end.

    Each table has a CGK walk of its own over 3 * length steps, of which those
    up to the last sampled one are made: a step reads the symbol under the
    pointer and moves on if the walk's random bit of (step, symbol) is 1. The
    bits of a step are a 64-bit mask for the symbols' 64 hash classes. A key is
    made of SAMPLED coordinates of the first two thirds of the walk.
    """
    rng = np.random.default_rng([seed, length])
    n, reach = len(windows), 2 * length
    sampled = np.stack([np.sort(rng.choice(reach, size=min(SAMPLED, reach), replace=False)) for _ in range(MOST_TABLES)])[:tables]
    masks = rng.integers(0, 1 << 64, size=(MOST_TABLES, reach), dtype=_U)[:tables]
    salts = rng.integers(1, 1 << 64, size=MOST_TABLES, dtype=_U)[:tables]
    width = windows.shape[1] + reach
    padded = np.full((n, width), -1, dtype=np.int64)
    padded[:, : windows.shape[1]] = windows
    with np.errstate(over="ignore"):
        symbols = _scramble((padded.ravel() + 2).astype(_U) * _U(0x9E3779B97F4A7C15))
        kinds = (symbols >> _U(58)).astype(np.uint8)
        at = np.tile(np.arange(n, dtype=np.int32) * np.int32(width), (tables, 1))
        keys = np.repeat(salts[:, None], n, axis=1)
        for step in range(int(sampled.max()) + 1):
            here = np.flatnonzero((sampled == step).any(axis=1))
            if len(here):
                keys[here] = _scramble(keys[here] * _U(0x9E3779B97F4A7C15) + symbols[at[here]])
            at += ((masks[:, step, None] >> kinds[at]) & _U(1)).astype(np.int32)
    return keys.T


def stretch_distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """The least word edit distance of ``item`` to a stretch of ``text``, and the first end of such a stretch."""
    before = np.zeros(len(text) + 1, dtype=np.int64)
    steps = np.arange(len(text) + 1)
    for i, word in enumerate(item.tolist()):
        now = np.empty_like(before)
        now[0] = i + 1
        now[1:] = np.minimum(before[:-1] + (text != word), before[1:] + 1)
        before = np.minimum.accumulate(now - steps) + steps
    end = int(before.argmin())
    return int(before[end]), end


@dataclass
class Index:
    """The tables of a block of items; its size is bounded by ITEM_BLOCK."""

    items: list[tuple[int, np.ndarray, int]] = field(default_factory=list)
    vocabulary: dict[bytes, int] = field(default_factory=dict)
    q: int = 3
    grams: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    bits: np.ndarray = field(default_factory=lambda: np.zeros(1 << 20, bool))
    need: int = 1 << 30
    class_need: dict[int, tuple[int, int]] = field(default_factory=dict)
    reach: int = 0
    classes: list[int] = field(default_factory=list)
    keys: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    tables: dict[int, int] = field(default_factory=dict)
    recall: dict[int, float] = field(default_factory=dict)
    # of sizes whose tables miss the target: item numbers by q-gram, and the hits that each item keeps
    lists: tuple[np.ndarray, np.ndarray] = field(default_factory=lambda: (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    kept: list[int] = field(default_factory=list)


def _gram_keys(ids: np.ndarray, q: int) -> np.ndarray:
    """One key for each q consecutive ids, 0 where one of them is unknown."""
    n = max(0, len(ids) - q + 1)
    key, known = np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
    for i in range(q):
        part = ids[i : i + n]
        key = (key << 20) | part
        known &= part > 0
    return np.where(known, key, 0)


def _class_of(length: int, classes: list[int]) -> int:
    return min(classes, key=lambda c: (abs(c - length), c))


def build_index(items: list[tuple[int, str | None]], rate: float = RATE, target: float = TARGET) -> Index:
    """Index items (id, text); those without words are passed over."""
    out = Index()
    for item_id, text in items:
        words = normal_words(text)
        if words:
            ids = np.array([out.vocabulary.setdefault(w, len(out.vocabulary) + 1) for w in words], dtype=np.int64)
            out.items.append((item_id, ids, int(rate * len(ids) + 1e-9)))
    if not out.items:
        return out
    if len(out.vocabulary) >= 1 << 20:
        raise ValueError("a block of items has too many words; make ITEM_BLOCK smaller")
    lengths = sorted({len(ids) for _, ids, _ in out.items})
    for n in lengths:
        if not out.classes or n > 1.12 * out.classes[-1]:
            out.classes.append(n)
    # an item within its edits keeps a run of this many words
    out.q = min(max(1, min(3, (len(ids) - edits) // (edits + 1))) for _, ids, edits in out.items)
    grams = []
    for _, ids, edits in out.items:
        keys = _gram_keys(ids, out.q)
        grams.append(keys)
        spare = len(keys) - len(np.unique(keys))
        kept = max(1, len(keys) - out.q * edits - spare)
        out.kept.append(kept)
        c = _class_of(len(ids), out.classes)
        least, span = out.class_need.get(c, (1 << 30, 0))
        out.class_need[c] = (min(least, kept), max(span, len(ids) + 2 * edits + abs(len(ids) - c)))
        out.need = min(out.need, kept)
        out.reach = max(out.reach, len(ids) + edits)
    out.grams = np.unique(np.concatenate(grams))
    out.bits[_cells(out.grams)] = True
    # as many tables as find edited items of each class, at any offset to the windows
    rng = np.random.default_rng(11)
    members: dict[int, list[int]] = {}
    for k, (_, ids, _) in enumerate(out.items):
        members.setdefault(_class_of(len(ids), out.classes), []).append(k)
    _fill(out, dict.fromkeys(members, MOST_TABLES))
    shares, exact, need = {}, [], [8]
    for c, own in members.items():
        trials, owners = [], []
        for t in range(TRIALS):
            k = own[int(rng.integers(len(own)))] if len(own) > TRIALS else own[t % len(own)]
            margin = _stride(c) + int(rng.integers(_stride(c)))
            trials.append(np.concatenate([np.zeros(margin, np.int64), _edited(*out.items[k][1:], rng), np.zeros(_stride(c) + out.reach, np.int64)]))
            owners.append(k)
        found = np.zeros((TRIALS, MOST_TABLES), dtype=bool)
        _candidates(out, [(i, x, 0, len(x) - out.reach, _hits(out, x)) for i, x in enumerate(trials)], by_table=found, owners=owners, only=c)
        reached = np.logical_or.accumulate(found, axis=1).mean(axis=0)
        shares[c] = reached
        if reached[-1] >= target:
            need.append(int(np.argmax(reached >= target)) + 1)
        else:
            exact.extend(own)
            out.recall[c] = 1.0
    # no fewer for any class than all classes' trials together ask for
    pooled = np.mean([shares[c] for c in members for _ in members[c]], axis=0)
    need.append(int(np.argmax(pooled >= target)) + 1 if pooled[-1] >= target else MOST_TABLES)
    tables = max(need)
    out.recall.update({c: float(x[tables - 1]) for c, x in shares.items() if c not in out.recall})
    _fill(out, dict.fromkeys(members, tables))
    if exact:
        pairs = [(np.setdiff1d(grams[k], [0]), k) for k in exact]
        key, owner = np.concatenate([g for g, _ in pairs]), np.repeat([k for _, k in pairs], [len(g) for g, _ in pairs])
        order = np.argsort(key, kind="stable")
        out.lists = key[order], owner[order]
    return out


def _stride(c: int) -> int:
    return max(1, int(RATE * c) // 3)


def _edited(ids: np.ndarray, edits: int, rng) -> np.ndarray:
    """``ids`` after that many random word edits."""
    out = ids.tolist()
    for _ in range(edits):
        kind, at = rng.integers(3), int(rng.integers(max(1, len(out))))
        if kind == 0 and len(out) > 1:
            del out[at]
        elif kind == 1:
            out.insert(at, 0)
        elif out:
            out[at] = 0
    return np.array(out, dtype=np.int64)


def _fill(index: Index, tables: dict[int, int]) -> None:
    index.tables, index.keys = tables, {}
    for c in tables:
        own = [k for k, (_, ids, _) in enumerate(index.items) if _class_of(len(ids), index.classes) == c]
        if not own:
            continue
        rows = np.full((len(own), max(c, *(len(index.items[k][1]) for k in own))), -1, dtype=np.int64)
        for r, k in enumerate(own):
            rows[r, : len(index.items[k][1])] = index.items[k][1]
        keys = embed_keys(rows, c, tables[c])
        flat, owner = keys.ravel(), np.repeat(np.array(own), tables[c])
        order = np.argsort(flat, kind="stable")
        index.keys[c] = flat[order], owner[order]


def _candidates(index: Index, stretches: list[tuple[int, np.ndarray, int, int]], by_table=None, owners=None, only=None):
    """(stretch number, item number) that share a key; a stretch is (number, ids, first start, last start, q-gram hits).

    Only windows whose surroundings have as many hits as an item of their class keeps are embedded.
    """
    pairs: set[tuple[int, int]] = set()
    for c, (keys, items) in index.keys.items():
        if only not in (None, c):
            continue
        stride = _stride(c)
        rows, number = [], []
        least, span = index.class_need[c]
        for i, ids, first, last, hits in stretches:
            starts = np.arange(first, max(first + 1, min(last, len(ids))), stride)
            around = np.searchsorted(hits, starts + span) - np.searchsorted(hits, starts - (span - c))
            starts = starts[around >= least]
            if not len(starts):
                continue
            spots = starts[:, None] + np.arange(c)[None, :]
            rows.append(np.where(spots < len(ids), ids[np.minimum(spots, len(ids) - 1)], -1))
            number.append(np.full(len(starts), i))
        for k in range(0, len(rows), 64):
            windows, of = np.concatenate(rows[k : k + 64]), np.concatenate(number[k : k + 64])
            for s in range(0, len(windows), 1024):
                got = embed_keys(windows[s : s + 1024], c, index.tables[c])
                lo, hi = np.searchsorted(keys, got, "left"), np.searchsorted(keys, got, "right")
                for w, t in zip(*np.nonzero(hi > lo), strict=True):
                    for k2 in items[lo[w, t] : hi[w, t]].tolist():
                        i = int(of[s + w])
                        pairs.add((i, k2))
                        if by_table is not None and owners[i] == k2:
                            by_table[i, t] = True
    if only is None and len(index.lists[0]):
        for i, ids, _, _, hits in stretches:
            pairs.update((i, k) for k in _enough_hits(index, ids, hits))
    return sorted(pairs)


def _enough_hits(index: Index, ids: np.ndarray, hits: np.ndarray) -> list[int]:
    """Items without tables that have as many q-grams in a part of ``ids`` of their length and edits as they keep."""
    wanted, owner = index.lists
    own = _gram_keys(ids, index.q)
    hits = hits[hits < len(own)]
    lo, hi = np.searchsorted(wanted, own[hits], "left"), np.searchsorted(wanted, own[hits], "right")
    size = hi - lo
    at = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
    item, place = owner[at], np.repeat(hits, size)
    order = np.argsort(item, kind="stable")
    item, place = item[order], place[order]
    out = []
    for k, a, n in zip(*np.unique(item, return_index=True, return_counts=True), strict=True):
        kept, p = index.kept[k], place[a : a + n]
        if n >= kept and (p[kept - 1 :] - p[: n - kept + 1]).min() <= len(index.items[k][1]) + index.items[k][2]:
            out.append(int(k))
    return out


def _cells(keys: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((keys.astype(_U) * _U(0x9E3779B97F4A7C15)) >> _U(44)).astype(np.int64)


def _hits(index: Index, ids: np.ndarray) -> np.ndarray:
    """Where q-grams of the items stand; a repeated gram right behind itself counts once."""
    keys = _gram_keys(ids, index.q)
    maybe = np.flatnonzero(index.bits[_cells(keys)])
    if not len(maybe):
        return maybe
    place = np.minimum(np.searchsorted(index.grams, keys[maybe]), len(index.grams) - 1)
    hits = maybe[index.grams[place] == keys[maybe]]
    if len(hits) > 1:
        hits = hits[np.r_[True, (keys[hits[1:]] != keys[hits[:-1]]) | (np.diff(hits) > 1)]]
    return hits


def _stretches(index: Index, ids: np.ndarray, hits: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of ``ids`` with enough q-gram hits to hold an item within its edits."""
    n = index.need
    if len(hits) < n:
        return []
    close = np.flatnonzero(hits[n - 1 :] - hits[: len(hits) - n + 1] <= index.reach)
    merged: list[tuple[int, int]] = []
    for i in close.tolist():
        a, b = max(0, int(hits[i]) - index.reach), min(len(ids), int(hits[i + n - 1]) + index.reach)
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def search(index: Index, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
    """(text number, item id, edit distance, end word, item words) for each item that a text holds."""
    if not index.items:
        return []
    out: list[tuple[int, int, int, int, int]] = []
    group: list[tuple[int, list[bytes]]] = []
    size = 0

    def flush() -> None:
        gap = [_END]
        flat = np.fromiter(map(index.vocabulary.get, chain.from_iterable(chain(ws, gap) for _, ws in group), repeat(0)), dtype=np.int64, count=size)
        starts = np.cumsum([0, *(len(ws) + 1 for _, ws in group)])
        hits = _hits(index, flat)
        stretches: list[tuple[int, np.ndarray, int, int, np.ndarray]] = []
        where: list[tuple[int, int, np.ndarray]] = []
        for a, b in _stretches(index, flat, hits):
            for g in range(int(np.searchsorted(starts, a, "right")) - 1, len(group)):
                if int(starts[g]) >= b:
                    break
                lo, hi = max(a, int(starts[g])), min(b, int(starts[g + 1]) - 1)
                if hi > lo:
                    ids = flat[lo:hi]
                    own = hits[np.searchsorted(hits, lo) : np.searchsorted(hits, hi)] - lo
                    stretches.append((len(where), ids, 0, len(ids), own))
                    where.append((group[g][0], lo - int(starts[g]), ids))
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for s, k in _candidates(index, stretches) if stretches else []:
            number, offset, ids = where[s]
            item_id, words, edits = index.items[k]
            if np.isin(words, ids).sum() < len(words) - edits:
                continue
            distance, end = stretch_distance(words, ids)
            if distance <= edits:
                got = (distance, offset + end, len(words))
                if (number, item_id) not in best or got < best[number, item_id]:
                    best[number, item_id] = got
        out.extend((n, i, *rest) for (n, i), rest in best.items())

    for number, text in enumerate(texts):
        words = normal_words(text)
        group.append((number, words))
        size += len(words) + 1
        if size > 400_000:
            flush()
            group, size = [], 0
    if group:
        flush()
    return out


def _found(docs: DataFrame, benchmark: DataFrame, rate: float, target: float) -> DataFrame:
    """``contaminated`` with h, a hash of the document's text."""
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    schema = "doc_id long, h long, item_id long, distance int, item_words int, end_word int"
    blocks = max(1, -(-items.count() // ITEM_BLOCK))
    out = None
    for start in range(0, blocks, PASS_BLOCKS):
        indexes = []
        for b in range(start, min(blocks, start + PASS_BLOCKS)):
            part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
            indexes.append(build_index([(r["item_id"], r["text"]) for r in part], rate, target))
        shared = spark.sparkContext.broadcast(indexes)

        def scan(batches, shared=shared):
            import pyarrow as pa

            for batch in slices_of(batches):
                texts = batch["text"].to_pylist()
                hits = [h for index in shared.value for h in search(index, texts)]
                rows = pa.array([x[0] for x in hits], pa.int64())
                cols = [pa.array([x[i] for x in hits], k) for i, k in ((1, pa.int64()), (2, pa.int32()), (4, pa.int32()), (3, pa.int32()))]
                yield pa.RecordBatch.from_arrays([batch["doc_id"].take(rows), batch["h"].take(rows), *cols], names=["doc_id", "h", "item_id", "distance", "item_words", "end_word"])

        found = slim.mapInArrow(lean(scan), schema)
        out = found if out is None else out.unionByName(found)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, target: float = TARGET) -> DataFrame:
    """doc_id, item_id, distance, item_words, end_word: each item that a document holds within its edits, at its best stretch.

    Of stretches of one distance that of the first end is given. Items are
    taken in blocks of ITEM_BLOCK, PASS_BLOCKS of them in a pass, so what goes
    to the executors is bounded. Items and texts that are null or without words match nothing;
    repeated rows give repeated results, a null doc_id stays null; an empty
    benchmark or corpus gives no rows. A text is read whole by one task, at some
    100 bytes a word. Columns other than the ids and texts are not read,
    whatever their names.
    """
    return _found(docs, benchmark, rate, target).drop("h")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold an item; all columns stay, whatever their names.

    Decisions are by doc_id (null is one) and text, so a clean text under the
    id of a contaminated one stays, and repeated rows go or stay together.
    """
    gone = materialize(_found(docs, benchmark, RATE, TARGET).select("doc_id", "h").distinct(), "gone")
    packed = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_h"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    # most texts are not among them and need no shuffle
    some, rest = split_by(packed, "_h", gone, "h")
    some = some.join(gone, F.col("_id").eqNullSafe(gone["doc_id"]) & (F.col("_h") == gone["h"]), "left_anti")
    return rest.select("_row").unionByName(some.select("_row")).select("_row.*")
