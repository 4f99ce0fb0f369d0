"""Language-model scoring with a weighted backoff automaton.

The model is a trigram model with absolute discounting. Its states are contexts
(none, a word or the start of a text, two words); an arc carries the log of a
discounted probability, and a failure arc leads from a context to the next
shorter one with the log of its backoff weight:

    p(w)     = (c(w) + ADD) / (N + ADD (V + 1))
    p(w | h) = (c(hw) - DISCOUNT) / c(h)       on an arc
             = fail(h) p(w | shorter h)        without one
    fail(h)  = (1 - the sum of p(w | h) on h's arcs) / (1 - the sum of p(w | shorter h) for the same w)

so each state's probabilities sum to one. Every bigram that stands LEAST_COUNT
times or more in the training texts has an arc, and so has every such trigram,
however many there are. Both sums follow from three whole numbers of a context:
its arcs, their counts' sum, and the sum of the counts of what stays of them
without their first word.

No process holds the automaton. Documents are coded once, in chunks: a table of
a chunk's distinct words (hashes) and the texts as numbers in that table. Chunks
then send the keys of their words, bigrams and trigrams, with their own counts,
to ranges of a 64-bit hash, where they are summed, and get the sums for their
own keys back; one chunk of those that have an n-gram is its owner and adds its
arc to the sums of its context, which go the same way. So a chunk has the part
of the automaton that its texts can reach, and a task holds one chunk, or one
range of the keys of about RANGE_TOKENS tokens. The coded texts are dealt out by
chunk once; answers come to them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, id_remainder, lean, materialize, materialize_by, slices_of, trim
from .shingles import word_hashes, words_of

#: The least training count of a bigram or trigram with an arc.
LEAST_COUNT = 2
DISCOUNT = 0.5
ADD = 0.1
CHUNK_WORDS = 400_000
RANGE_TOKENS = 1 << 21
_U = np.uint64
#: Stands for the end of a text; no word has this hash but by a chance of 2**-64.
END_HASH = _U(0xE4D0E4D0E4D0E4D1)
START_HASH = _U(0x57A257A257A257A3)

CODED = "chunk long, size long, doc_ids array<long>, held array<boolean>, lengths array<int>, words binary, codes binary"
ASKED = "chunk long, kind int, range int, keys binary, one binary, two binary, three binary"
ANSWERED = "chunk long, kind int, range int, one binary, two binary, three binary, distinct long, total long"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

#: Kinds of keys: those that are counted, and contexts whose arcs are summed.
WORD, BIGRAM, TRIGRAM, WORD_ARCS, PAIR_ARCS = 1, 2, 3, 4, 5
COUNTED = (WORD, BIGRAM, TRIGRAM)
NUMBERS = ("one", "two", "three")


def _planes(values: np.ndarray) -> bytes:
    """Numbers with all first bytes first: small or sorted ones compress well."""
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def _from_planes(raw: bytes, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _steps(values: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as the steps between them."""
    return _planes(np.diff(values, prepend=_U(0)))


def _from_steps(raw: bytes) -> np.ndarray:
    return np.cumsum(_from_planes(raw, "<u8"), dtype=_U)


def code_documents(docs: DataFrame) -> DataFrame:
    """One row for each chunk: ids, held_out, token counts (with the end), distinct word hashes, and the texts' codes."""

    def code(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        ids, held, lengths, hashes, size = [], [], [], [], 0

        def row():
            nonlocal made
            words, codes = np.unique(np.concatenate(hashes), return_inverse=True)
            made += 1
            columns = [(part << 33) + made, size, ids, held, lengths, _steps(words), _planes(codes.astype("<u4"))]
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(columns, kinds, strict=True)], names=["chunk", "size", "doc_ids", "held", "lengths", "words", "codes"])

        for batch in slices_of(batches):
            for i, h, t in zip(batch["doc_id"].to_pylist(), batch["held"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids.append(i)
                held.append(h)
                hashes.append(np.append(word_hashes(words_of(t)), END_HASH))
                lengths.append(len(hashes[-1]))
                size += lengths[-1]
                if size >= CHUNK_WORDS:
                    yield row()
                    ids, held, lengths, hashes, size = [], [], [], [], 0
                    trim()
        if ids:
            yield row()

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (id_remainder(F.col("doc_id"), 10) == 0).alias("held"), "text")
    return materialize_by(slim.mapInArrow(lean(code), CODED), "chunk", "coded")


def _range_bits(coded: DataFrame) -> int:
    """Bits of the number of hash ranges: 64 ranges, or one for every RANGE_TOKENS tokens."""
    tokens = coded.agg(F.sum("size")).first()[0] or 0
    return max(6, int(np.ceil(np.log2(max(1, tokens / RANGE_TOKENS)))))


def _rows(batches):
    for batch in slices_of(batches):
        yield from batch.to_pylist()


def _extend(keys: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of n-grams from those of all words but the last, and of the last."""
    with np.errstate(over="ignore"):
        x = (keys ^ (keys >> _U(29))) * _U(0x9E3779B97F4A7C15) + words
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _ask(chunk: int, kind: int, keys: np.ndarray, bits: int, *numbers: np.ndarray):
    """Rows by hash range of a chunk's keys, sorted, with one or three numbers each."""
    import pyarrow as pa

    order = np.argsort(keys)
    keys = keys[order]
    cut = np.searchsorted(keys >> _U(64 - bits), np.arange((1 << bits) + 1, dtype=_U))
    some = np.flatnonzero(np.diff(cut)).tolist()
    part = lambda x, f=_planes: pa.array([f(x[cut[r] : cut[r + 1]]) for r in some], pa.binary())
    given = [part(x[order].astype("<i8")) for x in numbers]
    given += [pa.nulls(len(some), pa.binary())] * (3 - len(given))
    return pa.RecordBatch.from_arrays(
        [pa.array([chunk] * len(some), pa.int64()), pa.array([kind] * len(some), pa.int32()), pa.array(some, pa.int32()), part(keys, _steps), *given],
        names=["chunk", "kind", "range", "keys", *NUMBERS],
    )


def _sum_range(rows: list[dict]):
    """Answers to all rows of one kind and range, in the order of each row's keys.

    Of counted keys ``one`` is twice the sum, and 1 more for the first chunk,
    the owner; a further row of chunk -1 has the range's own number of keys with
    a count and their sum. Of contexts all three are sums.
    """
    import pyarrow as pa

    keys = [_from_steps(r["keys"]) for r in rows]
    cut = np.cumsum([len(k) for k in keys])[:-1]
    every, first, place = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)

    def total(column: str) -> np.ndarray:
        given = np.concatenate([_from_planes(r[column], "<i8") for r in rows])
        return np.bincount(place, weights=given, minlength=len(every)).astype("<i8")

    back = lambda x: [_planes(p) for p in np.split(x, cut)]
    chunk, kind, n = [r["chunk"] for r in rows], rows[0]["kind"], len(rows)
    own: list[list] = [[None] * n, [None] * n]
    if kind in COUNTED:
        count = total("one")
        one = 2 * count[place]
        one[first] += 1
        chunk, numbers = [*chunk, -1], [[*back(one), None]] + [[None] * (n + 1)] * 2
        own = [[*own[0], int(np.count_nonzero(count))], [*own[1], int(count.sum())]]
    else:
        numbers = [back(total(c)[place]) for c in NUMBERS]
    same = lambda k: pa.array([rows[0][k]] * len(chunk), pa.int32())
    return pa.RecordBatch.from_arrays(
        [pa.array(chunk, pa.int64()), same("kind"), same("range"), *(pa.array(x, pa.binary()) for x in numbers), *(pa.array(x, pa.int64()) for x in own)],
        names=["chunk", "kind", "range", *NUMBERS, "distinct", "total"],
    )


def _answer(asked: DataFrame, name: str) -> DataFrame:
    """What ``_sum_range`` says to each row of ``asked``."""

    def answer(batches):
        held: list[dict] = []
        for row in _rows(batches):
            if held and (held[0]["kind"], held[0]["range"]) != (row["kind"], row["range"]):
                yield _sum_range(held)
                held = []
                trim()
            held.append(row)
        if held:
            yield _sum_range(held)

    dealt = asked.repartition("kind", "range").sortWithinPartitions("kind", "range", "chunk")
    return materialize(dealt.mapInArrow(lean(answer), ANSWERED), name)


def _in_order_of(keys: np.ndarray, sorted_values: np.ndarray) -> np.ndarray:
    """Values that came by sorted keys, by the keys as they stand."""
    out = np.empty_like(sorted_values)
    out[np.argsort(keys)] = sorted_values
    return out


def _sums(context: np.ndarray, n: int, counts: np.ndarray, lower: np.ndarray) -> list[np.ndarray]:
    """By context: the number of arcs, the sum of their counts, and that of the counts without the first word."""
    return [np.bincount(context, minlength=n), *(np.bincount(context, weights=x, minlength=n) for x in (counts, lower))]


def _fail(used: np.ndarray, below: np.ndarray) -> np.ndarray:
    return np.maximum(1 - used, 1e-12) / np.maximum(1 - below, 1e-12)


class Part:
    """A chunk's part of the automaton, as far as the answers to its questions have come.

    States and arcs are places in tables: words by hash (the start of a text is
    one more), the chunk's bigrams with an arc, its trigrams with an arc.
    """

    def __init__(self, row: dict):
        self.chunk = row["chunk"]
        self.words = _from_steps(row["words"])
        self.codes = _from_planes(row["codes"], "<u4").astype(np.int64)
        self.lengths = np.array(row["lengths"], dtype=np.int64)
        self.first = np.cumsum(self.lengths) - self.lengths
        self.train = np.repeat(~np.array(row["held"], dtype=bool), self.lengths)
        self.start, wide = len(self.words), len(self.words) + 1
        before = np.empty_like(self.codes)
        before[1:] = self.codes[:-1]
        before[self.first] = self.start
        #: bigram of each token with the one before it
        keys, self.pair = np.unique(before * wide + self.codes, return_inverse=True)
        self.history, self.word = keys // wide, keys % wide
        self.pair_hash = _extend(np.append(self.words, START_HASH)[self.history], self.words[self.word])

    def ask_counts(self, bits: int):
        """Training counts of words and bigrams."""
        count = lambda at, n: np.bincount(at[self.train], minlength=n)
        yield _ask(self.chunk, WORD, self.words, bits, count(self.codes, len(self.words)))
        yield _ask(self.chunk, BIGRAM, self.pair_hash, bits, count(self.pair, len(self.pair_hash)))

    def take_counts(self, answers: dict, n: int, v: int) -> None:
        """Bigrams without an arc go."""
        self.count = answers[WORD][0] >> 1
        self.all_words = n + ADD * (v + 1)
        self.unigram = (self.count + ADD) / self.all_words
        # the start stands as often as the end
        self.of_context = np.append(self.count, self.count[np.searchsorted(self.words, END_HASH)])
        got = _in_order_of(self.pair_hash, answers[BIGRAM][0])
        kept = got >> 1 >= LEAST_COUNT
        self.pair = np.where(kept, np.cumsum(kept) - 1, -1)[self.pair]
        self.pair_hash, self.history, self.word = self.pair_hash[kept], self.history[kept], self.word[kept]
        self.pair_count, self.pair_owned = got[kept] >> 1, (got[kept] & 1).astype(bool)
        # contexts of one word that can have arcs
        self.context = np.flatnonzero(self.of_context >= LEAST_COUNT)
        self.context_hash = np.append(self.words, START_HASH)[self.context]
        # trigrams of two bigrams with arcs only: none is more frequent than its parts
        ahead = np.empty_like(self.pair)
        ahead[1:] = self.pair[:-1]
        ahead[self.first] = -1
        #: the two-word state before each token, or -1
        self.state = ahead
        some, wide = (ahead >= 0) & (self.pair >= 0), max(1, len(self.pair_hash))
        keys, at = np.unique(ahead[some] * wide + self.pair[some], return_inverse=True)
        self.triple = np.full(len(self.codes), -1, dtype=np.int64)
        self.triple[some] = at
        self.context3, self.lower = keys // wide, keys % wide
        self.triple_hash = _extend(self.pair_hash[self.context3], self.words[self.word[self.lower]])

    def ask_trigrams(self, bits: int):
        """Training counts of trigrams, and the sums over words' arcs."""
        own, n = self.pair_owned, len(self.words) + 1
        sums = _sums(self.history[own], n, self.pair_count[own], self.count[self.word[own]])
        yield _ask(self.chunk, WORD_ARCS, self.context_hash, bits, *(x[self.context] for x in sums))
        some = self.triple[self.train & (self.triple >= 0)]
        yield _ask(self.chunk, TRIGRAM, self.triple_hash, bits, np.bincount(some, minlength=len(self.triple_hash)))

    def take_trigrams(self, answers: dict) -> None:
        """Trigrams without an arc go; arcs and failure arcs of words."""
        arcs, sums, lower = (_in_order_of(self.context_hash, x) for x in answers[WORD_ARCS])
        self.word_fail = np.ones(len(self.words) + 1)
        self.word_fail[self.context] = _fail((sums - DISCOUNT * arcs) / self.of_context[self.context], (lower + ADD * arcs) / self.all_words)
        self.on_pair = (self.pair_count - DISCOUNT) / self.of_context[self.history]
        got = _in_order_of(self.triple_hash, answers[TRIGRAM][0])
        kept = got >> 1 >= LEAST_COUNT
        self.triple = np.append(np.where(kept, np.cumsum(kept) - 1, -1), -1)[self.triple]
        self.context3, self.lower = self.context3[kept], self.lower[kept]
        self.triple_count, self.triple_owned = got[kept] >> 1, (got[kept] & 1).astype(bool)

    def ask_pairs(self, bits: int):
        """The sums over bigrams' arcs."""
        own, n = self.triple_owned, len(self.pair_hash)
        yield _ask(self.chunk, PAIR_ARCS, self.pair_hash, bits, *_sums(self.context3[own], n, self.triple_count[own], self.pair_count[self.lower[own]]))

    def take_pairs(self, answers: dict) -> None:
        """Arcs and failure arcs of bigrams."""
        arcs, sums, lower = (_in_order_of(self.pair_hash, x) for x in answers[PAIR_ARCS])
        self.pair_fail = _fail((sums - DISCOUNT * arcs) / self.pair_count, (lower - DISCOUNT * arcs) / np.maximum(1, self.of_context[self.word]))
        self.on_triple = (self.triple_count - DISCOUNT) / self.pair_count[self.context3]

    def traverse(self) -> np.ndarray:
        """log10 probability of each text, from left to right.

        A token is read from the state that the arc before it led to: two words
        if their bigram has an arc, else one word. It takes that state's arc if
        there is one, else the failure arc, and tries again. As a state is known
        from the two words before, the steps of all texts are taken together.
        """
        before = np.empty_like(self.codes)
        before[1:] = self.codes[:-1]
        before[self.first] = self.start
        log = np.log10
        none = np.zeros(1)  # for places of -1
        by_pair, by_triple, pair_fail = (np.append(log(x), none) for x in (self.on_pair, self.on_triple, self.pair_fail))
        shorter = np.where(self.pair >= 0, by_pair[self.pair], log(self.word_fail)[before] + log(self.unigram)[self.codes])
        steps = np.where(self.triple >= 0, by_triple[self.triple], pair_fail[self.state] + shorter)
        return np.add.reduceat(steps, self.first)


def _with_answers(coded: DataFrame, answers: list[DataFrame], work, schema: str) -> DataFrame:
    """``work(part, answers by kind, the chunk's row)`` for each chunk, which gives Arrow batches."""
    rows = None
    for a in answers:
        own = a.filter("chunk >= 0").select("chunk", "kind", "range", *NUMBERS)
        rows = own if rows is None else rows.unionByName(own)

    def meet(chunk, given):
        import pyarrow as pa

        (row,) = chunk.to_pylist()
        by_kind: dict = {}
        for r in sorted(given.to_pylist(), key=lambda r: (r["kind"], r["range"])):
            by_kind.setdefault(r["kind"], []).append(r)
        found = {}
        for kind in (WORD, BIGRAM, TRIGRAM, WORD_ARCS, PAIR_ARCS):
            names = NUMBERS[:1] if kind in COUNTED else NUMBERS
            found[kind] = [np.concatenate([np.zeros(0, np.int64), *(_from_planes(r[c], "<i8") for r in by_kind.get(kind, []))]) for c in names]
        out = list(work(Part(row), found, row))
        trim()
        return pa.Table.from_batches(out)

    return coded.groupBy("chunk").cogroup(rows.groupBy("chunk")).applyInArrow(meet, schema)


def _answers(docs: DataFrame) -> tuple[DataFrame, list[DataFrame], int, int]:
    """Chunks, all answers to them, the number of training tokens, and that of distinct ones."""
    coded = code_documents(docs)
    bits = _range_bits(coded)

    def counts(batches):
        for row in _rows(batches):
            yield from Part(row).ask_counts(bits)
            trim()

    one = _answer(coded.mapInArrow(lean(counts), ASKED), "counts")
    own = one.filter(F.col("chunk") == -1).filter(F.col("kind") == WORD).agg(F.sum("total"), F.sum("distinct")).first()
    n, v = int(own[0] or 0), int(own[1] or 0)

    def trigrams(part, answers, _):
        part.take_counts(answers, n, v)
        yield from part.ask_trigrams(bits)

    two = _answer(_with_answers(coded, [one], trigrams, ASKED), "trigrams")

    def pairs(part, answers, _):
        part.take_counts(answers, n, v)
        part.take_trigrams(answers)
        yield from part.ask_pairs(bits)

    three = _answer(_with_answers(coded, [one, two], pairs, ASKED), "pairs")
    return coded, [one, two, three], n, v


def _completed(part: Part, answers: dict, n: int, v: int) -> Part:
    part.take_counts(answers, n, v)
    part.take_trigrams(answers)
    part.take_pairs(answers)
    return part


def whole_automaton(docs: DataFrame) -> tuple[Part, int, int]:
    """The automaton of a corpus of one chunk, the number of training tokens, and that of distinct ones; for looking into it."""
    coded, answers, n, v = _answers(docs)
    (row,) = (r.asDict() for r in coded.collect())
    found: dict = {}
    for a in answers:
        for r in sorted(a.filter("chunk >= 0").collect(), key=lambda r: (r["kind"], r["range"])):
            found.setdefault(r["kind"], [[] for _ in NUMBERS])
            for k, c in enumerate(NUMBERS):
                found[r["kind"]][k].append(_from_planes(r[c], "<i8") if r[c] is not None else np.zeros(0, np.int64))
    part = _completed(Part(row), {kind: [np.concatenate(x) for x in parts] for kind, parts in found.items()}, n, v)
    forget(coded, *answers)
    return part, n, v


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row.

    Learns from rows whose crc32 of doc_id is not divisible by 10 and scores
    all, whole. A null text counts as empty and has the end alone; a null
    doc_id counts as an empty id. Repeated rows are learned from as often as
    they stand. Without training tokens every token has the chance of an
    unknown one. An empty table gives an empty table. A text longer than
    CHUNK_WORDS is a chunk of its own, so the longest text must fit a task at
    about 200 bytes a word. Columns other than doc_id and text are not read,
    whatever their names.
    """
    coded, answers, n, v = _answers(docs)

    def score(part, found, row):
        import pyarrow as pa

        _completed(part, found, n, v)
        base = np.log10(part.unigram)[part.codes]
        known = (part.count > 0)[part.codes]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(row["doc_ids"], pa.int64()),
                pa.array(row["held"], pa.bool_()),
                pa.array(part.lengths),
                pa.array(np.add.reduceat(known.astype(np.int64), part.first)),
                pa.array(np.full(len(part.lengths), n, dtype=np.int64)),
                pa.array(np.add.reduceat(base, part.first)),
                pa.array(part.traverse()),
            ],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    scored = materialize(_with_answers(coded, answers, score, SCORED), "scores")
    forget(coded, *answers)
    return scored
