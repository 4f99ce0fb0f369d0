"""Nearest neighbours by score-aware (anisotropic) product quantisation with exact reranking.

Vectors are normalised, so the largest inner product is the largest cosine.
They are assigned to the cells of a coarse codebook; residuals are coded in
subspaces of two dimensions with 16 codewords each (four bits), and codewords
are fitted with a larger weight on the error parallel to the vector (Guo et al.,
2020). A query scans the codes of its nearest cells by table lookups. A score
is off by no more than the length of the vector's quantisation error, so all
candidates that may be among the best by that bound are reranked by the exact
cosine of the original vectors, and nothing in the probed cells is lost.

The codebooks are fitted on a bounded sample (SAMPLE); every vector is indexed.
How many cells a query probes is measured: the true neighbours of a bounded
sample of the queries are found by brute force over all vectors, and as many
cells are probed as hold the share TARGET of them, all cells if it takes that.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: The most vectors that codebooks are fitted on, those of least hash of their id.
SAMPLE = 20_000
#: Rows of a coarse cell on average, and the most cells.
CELL_ROWS = 512
MOST_CELLS = 1024
WORDS = 16
WEIGHT = 4.0
#: The least share of true neighbours in probed cells, and the most queries it is measured on.
TARGET = 0.95
TRIALS = 256
#: Candidates of a block that are reranked first for a query, for a bound on the others; pairs reranked at once.
RERANK = 24
PAIRS = 1 << 15
#: Added to the bound for the rounding of the scan's single precision.
ROUNDING = 1e-4
#: The most numbers in the vectors that a task holds, and the blocks of cells that a large table is cut into at least.
BLOCK_VALUES = 1 << 23
LEAST_BLOCKS = 32


@dataclass
class Codebook:
    cells: np.ndarray  # cells x dim, unit length
    words: np.ndarray  # subspaces x WORDS x width
    dim: int
    width: int = 2

    @property
    def subspaces(self) -> int:
        return len(self.words)


def _spread(x: np.ndarray, k: int, rng) -> np.ndarray:
    """Start centres, each drawn by its squared distance from those before."""
    centres = [x[rng.integers(len(x))]]
    far = ((x - centres[0]) ** 2).sum(axis=1)
    while len(centres) < k:
        total = far.sum()
        pick = int(rng.integers(len(x))) if total <= 0 else int(np.searchsorted(np.cumsum(far), rng.random() * total))
        centres.append(x[min(pick, len(x) - 1)])
        far = np.minimum(far, ((x - centres[-1]) ** 2).sum(axis=1))
    return np.array(centres)


def fit_codebook(x: np.ndarray, cells: int = 64, weight: float = WEIGHT, rounds: int = 8, seed: int = 3) -> Codebook:
    """Fit on unit vectors x. ``weight`` is that of the parallel error over the orthogonal one."""
    rng = np.random.default_rng(seed)
    dim = x.shape[1]
    cells = max(1, min(cells, len(x) // 8 or 1))
    centres = _spread(x, cells, rng)
    for _ in range(rounds):
        own = np.argmax(x @ centres.T, axis=1)
        for c in range(cells):
            mine = x[own == c]
            if len(mine):
                m = mine.mean(axis=0)
                centres[c] = m / max(np.linalg.norm(m), 1e-12)
    own = np.argmax(x @ centres.T, axis=1)
    residual = x - centres[own]
    width = 2
    subspaces = -(-dim // width)
    pad = subspaces * width - dim
    r = np.pad(residual, ((0, 0), (0, pad))).reshape(len(x), subspaces, width)
    u = np.pad(x, ((0, 0), (0, pad))).reshape(len(x), subspaces, width)
    words = np.zeros((subspaces, WORDS, width))
    for s in range(subspaces):
        rs, us = r[:, s], u[:, s]
        words[s] = _spread(rs, WORDS, rng)
        for _ in range(rounds):
            code = _assign(rs, us, words[s], weight)
            for k in range(WORDS):
                mine = code == k
                if mine.any():  # minimiser of the weighted error, whose matrix is I + (weight - 1) u u'
                    d = us[mine]
                    a = np.eye(width) * mine.sum() + (weight - 1) * (d.T @ d)
                    b = rs[mine].sum(axis=0) + (weight - 1) * (d * (d * rs[mine]).sum(axis=1, keepdims=True)).sum(axis=0)
                    words[s, k] = np.linalg.solve(a, b)
    return Codebook(centres, words, dim, width)


def _assign(r: np.ndarray, u: np.ndarray, words: np.ndarray, weight: float) -> np.ndarray:
    error = r[:, None, :] - words[None]
    parallel = (error * u[:, None, :]).sum(axis=2)
    return np.argmin((error**2).sum(axis=2) + (weight - 1) * parallel**2, axis=1)


def encode(book: Codebook, x: np.ndarray, weight: float = WEIGHT) -> tuple[np.ndarray, np.ndarray]:
    """Cell and four-bit codes (two in a byte) of unit vectors."""
    own = np.argmax(x @ book.cells.T, axis=1)
    pad = book.subspaces * book.width - book.dim
    r = np.pad(x - book.cells[own], ((0, 0), (0, pad))).reshape(len(x), book.subspaces, book.width)
    u = np.pad(x, ((0, 0), (0, pad))).reshape(len(x), book.subspaces, book.width)
    codes = np.stack([_assign(r[:, s], u[:, s], book.words[s], weight) for s in range(book.subspaces)], axis=1).astype(np.uint8)
    if book.subspaces % 2:
        codes = np.pad(codes, ((0, 0), (0, 1)))
    return own, codes[:, ::2] | codes[:, 1::2] << 4


def scan(book: Codebook, cell: np.ndarray, queries: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Approximate inner products (queries x codes, of a cell each) from tables of 256 sums, one for each byte of two codes."""
    pad = book.subspaces * book.width - book.dim
    q = np.pad(queries, ((0, 0), (0, pad))).reshape(len(queries), book.subspaces, book.width)
    table = np.einsum("qsw,skw->qsk", q, book.words).astype(np.float32)
    if book.subspaces % 2:
        table = np.pad(table, ((0, 0), (0, 1), (0, 0)))
    pairs = (table[:, 1::2, :, None] + table[:, ::2, None, :]).reshape(len(queries), packed.shape[1], 256)
    out = (queries @ book.cells.T).astype(np.float32)[:, cell]
    for b in range(packed.shape[1]):
        out += pairs[:, b][:, packed[:, b]]
    return out


def errors(book: Codebook, cell: np.ndarray, x: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Lengths of the quantisation errors of unit vectors x, which bound the error of their scanned scores for any unit query."""
    codes = np.stack([packed & 15, packed >> 4], axis=2).reshape(len(x), -1)[:, : book.subspaces]
    guess = np.concatenate([book.words[s][codes[:, s]] for s in range(book.subspaces)], axis=1)[:, : book.dim]
    return np.sqrt(((x - book.cells[cell] - guess) ** 2).sum(axis=1))


def usable(vectors: DataFrame, dim: int | None = None) -> DataFrame:
    """vec_id, v (doubles), h (a hash of v); null, zero, non-finite vectors and those not of length ``dim`` are left out."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter("vec_id is not null and v is not null")
    if dim is not None:
        rows = rows.filter(F.size("v") == dim)
    return rows.filter(F.forall("v", fine) & F.exists("v", lambda x: x != 0)).withColumn("h", F.xxhash64("v"))


def _matrix(column) -> np.ndarray:
    """An Arrow list column of equal lengths as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow of squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cells_for(rows: int) -> tuple[int, int]:
    """Number of cells, and the least of probed ones, for an index of so many rows."""
    cells = max(1, min(MOST_CELLS, rows // CELL_ROWS))
    return cells, min(cells, int(np.ceil(4 * np.sqrt(cells))))


def _cell_order(cells: np.ndarray, x: np.ndarray) -> np.ndarray:
    """All cells of each vector, the nearest first."""
    return np.argsort(-(x @ cells.T), axis=1, kind="stable")


def probes_for(indexed: DataFrame, asked: DataFrame, cells: np.ndarray, k: int, least: int) -> int:
    """The least number of probed cells, ``least`` at least, that hold the share TARGET of the true k neighbours of sampled queries."""
    if least >= len(cells):
        return len(cells)
    got = asked.orderBy(F.xxhash64("vec_id"), "vec_id").limit(TRIALS).select("vec_id", "v").toArrow()
    if not got.num_rows:
        return least
    own, q = got["vec_id"].to_numpy(), _unit(_matrix(got["v"].combine_chunks()))
    shared = indexed.sparkSession.sparkContext.broadcast((own, q, np.argsort(_cell_order(cells, q), axis=1)))

    def brute(batches):
        """The k best of a partition's rows for each sampled query, with the place of their cell in the query's order."""
        import pyarrow as pa

        own, q, place = shared.value
        best = [np.zeros((len(q), 0)), np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0), np.int64)]
        for batch in batches:
            if batch.num_rows:
                ids = batch["id"].to_numpy()
                score = q @ _unit(_matrix(batch["v"])).T
                score[own[:, None] == ids[None, :]] = -np.inf
                every = [score, np.broadcast_to(ids, score.shape), place[:, batch["cell"].to_numpy()]]
                every = [np.concatenate(x, axis=1) for x in zip(best, every, strict=True)]
                top = np.argpartition(-every[0], min(k, every[0].shape[1]) - 1, axis=1)[:, :k]
                best = [np.take_along_axis(x, top, axis=1) for x in every]
        keep = np.isfinite(best[0])
        name = np.broadcast_to(np.arange(len(q))[:, None], keep.shape)
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (name, *best)], names=["q", "score", "id", "place"])

    found = indexed.select("cell", "id", "v").mapInArrow(brute, "q long, score double, id long, place long")
    true = found.withColumn("_r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))).filter(F.col("_r") <= k)
    places = np.sort(true.select("place").toArrow()["place"].to_numpy())
    if not len(places):
        return least
    return max(least, int(places[int(np.ceil(TARGET * len(places))) - 1]) + 1)


def _blocks(counts: dict[int, int], rows: int) -> list[tuple[int, int, int]]:
    """(cell, first block, blocks): small cells share a block of about ``rows``, a larger one is cut."""
    out, at, size = [], 0, 0
    for cell, n in sorted(counts.items()):
        if size and size + n > rows:
            at, size = at + 1, 0
        cut = -(-n // rows)
        out.append((cell, at, cut))
        at, size = (at, size + n) if cut == 1 else (at + cut, 0)
    return out


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``queries`` (like ``vectors``) its k nearest found by cosine, itself left out.

    Of equal vectors only the k + 1 of least id are indexed, as no other can be
    among the k nearest of any query; equal queries are searched once. Ties go
    to the smaller id. Rows that take no part (see ``usable``) give no results.
    The vectors' most frequent length is that of the index; others are left out,
    as a cosine needs two vectors of one length. A vec_id that stands in several
    rows counts as often; one that is null takes no part. An empty table gives
    an empty table. Columns other than vec_id and embedding are not read,
    whatever their names.
    """
    spark = vectors.sparkSession
    sizes = vectors.filter("embedding is not null").groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not sizes:
        return empty
    copies = Window.partitionBy("h").orderBy("vec_id")
    base = materialize(usable(vectors, sizes[0]["n"]).withColumn("_c", F.row_number().over(copies)).filter(F.col("_c") <= k + 1).drop("_c"), "vectors")
    rows = base.count()
    got = base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toArrow()
    if not rows:
        return empty
    cells, least = cells_for(rows)
    book = spark.sparkContext.broadcast(fit_codebook(_unit(_matrix(got["v"].combine_chunks())), cells))

    def index(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                own, codes = encode(book.value, _unit(_matrix(batch["v"])))
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), batch["vec_id"], pa.array([c.tobytes() for c in codes], pa.binary()), batch["v"]], names=["cell", "id", "codes", "v"])

    indexed = materialize(base.mapInArrow(index, "cell int, id long, codes binary, v array<double>"), "index")
    asked = usable(queries, sizes[0]["n"])
    probes = probes_for(indexed, asked, book.value.cells, k, min(least, len(book.value.cells)))
    counts = {r["cell"]: r["count"] for r in indexed.groupBy("cell").count().collect()}  # MOST_CELLS rows at most
    size = max(1, min(BLOCK_VALUES // sizes[0]["n"], max(4 * CELL_ROWS, -(-rows // LEAST_BLOCKS))))
    blocks = _blocks(counts, size)
    among = np.zeros((len(book.value.cells), blocks[-1][1] + blocks[-1][2]), dtype=np.float32)
    for cell, first, n in blocks:
        among[cell, first : first + n] = 1

    def probe(batches):
        """Each query once for each block that has rows of a probed cell."""
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                x = _unit(_matrix(batch["v"]))
                probed = np.zeros((len(x), len(among)), dtype=np.float32)
                np.put_along_axis(probed, _cell_order(book.value.cells, x)[:, :probes], 1, axis=1)
                take, block = np.nonzero(probed @ among > 0)
                for s in range(0, len(take), 4096):
                    of = pa.array(take[s : s + 4096])
                    yield pa.RecordBatch.from_arrays([pa.array(block[s : s + 4096], pa.int32()), batch["h"].take(of), batch["v"].take(of)], names=["block", "id", "v"])

    once = asked.groupBy("h").agg(F.first("v").alias("v"))
    where = F.broadcast(spark.createDataFrame(blocks, "cell int, first int, blocks int"))
    data = indexed.join(where, "cell").select((F.col("first") + F.pmod(F.xxhash64("id"), F.col("blocks"))).cast("int").alias("block"), F.lit(0).alias("kind"), "cell", "id", "codes", "v")
    lookups = once.mapInArrow(probe, "block int, id long, v array<double>").select("block", F.lit(1).alias("kind"), F.lit(-1).alias("cell"), "id", F.lit(None).cast("binary").alias("codes"), "v")
    dealt = data.unionByName(lookups).repartition(min(among.shape[1], 1024), "block").sortWithinPartitions("block", "kind", "cell", "id")

    def search(batches):
        """Rows of a block come first (bounded by BLOCK_VALUES or so), then its queries, batch after batch."""
        import pyarrow as pa

        key, parts, held = None, [], None
        for batch in batches:
            where = np.stack([batch["block"].to_numpy(), batch["kind"].to_numpy()], axis=1)
            cut = [0, *(np.flatnonzero((where[1:] != where[:-1]).any(axis=1)) + 1).tolist(), len(where)]
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                if a == b:
                    continue
                block, kind = where[a].tolist()
                if block != key:
                    key, parts, held = block, [], None
                rows_ = batch.slice(a, b - a)
                if kind == 0:
                    parts.append((rows_["id"].to_numpy(), np.frombuffer(b"".join(rows_["codes"].to_pylist()), dtype=np.uint8).reshape(b - a, -1), rows_["cell"].to_numpy(), _unit(_matrix(rows_["v"]))))
                    continue
                if not parts:
                    continue
                if held is None:
                    held = [np.concatenate([p[i] for p in parts]) for i in range(4)]
                    parts = [()]
                    held.append((errors(book.value, held[2], held[3], held[1]) + ROUNDING).astype(np.float32))
                ids, codes, own, x, slack = held
                q_all, name_all = _unit(_matrix(rows_["v"])), rows_["id"].to_numpy()
                for s in range(0, len(q_all), 32):
                    q, name = q_all[s : s + 32], name_all[s : s + 32]
                    rough = scan(book.value, own, q, codes)
                    if probes < len(book.value.cells):
                        outside = np.ones((len(q), len(book.value.cells)), dtype=bool)
                        np.put_along_axis(outside, _cell_order(book.value.cells, q)[:, :probes], False, axis=1)
                        rough[outside[:, own]] = -np.inf
                    n = min(max(RERANK, k + 1), len(ids))
                    top = np.argpartition(-rough, n - 1, axis=1)[:, :n]
                    first = (x[top] * q[:, None, :]).sum(axis=2)
                    first[np.isneginf(np.take_along_axis(rough, top, axis=1))] = -np.inf
                    floor = np.sort(first, axis=1)[:, -(k + 1)] if n > k else np.full(len(q), -np.inf)
                    rough += slack
                    of, at = np.nonzero((rough >= floor[:, None]) & np.isfinite(rough))
                    exact = np.concatenate([np.zeros(0), *((x[at[p : p + PAIRS]] * q[of[p : p + PAIRS]]).sum(axis=1) for p in range(0, len(at), PAIRS))])
                    keep = exact >= floor[of] - 1e-9
                    of, at, exact = of[keep], at[keep], exact[keep]
                    order = np.lexsort((ids[at], -exact, of))
                    of, at, exact = of[order], at[order], exact[order]
                    keep = np.arange(len(of)) - np.searchsorted(of, of) <= k
                    yield pa.RecordBatch.from_arrays([pa.array(name[of[keep]]), pa.array(ids[at[keep]]), pa.array(exact[keep])], names=["h", "vec_id", "score"])

    found = dealt.mapInArrow(search, "h long, vec_id long, score double")
    ranked = Window.partitionBy("h").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("_r", F.row_number().over(ranked)).filter(F.col("_r") <= k + 1)
    mine = asked.select(F.col("vec_id").alias("query_id"), "h").join(best, "h").filter(F.col("query_id") != F.col("vec_id"))
    order = Window.partitionBy("query_id").orderBy("_r")
    return mine.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
