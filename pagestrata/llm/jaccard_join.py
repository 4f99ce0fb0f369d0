"""Exact n-gram Jaccard join of all documents, as components, with prefix trees over globally ordered shingle sets.

Equal sets are one node. Of n shingles a set can miss at most m = n - ceil(s n)
in any similar set.

1. Every document's shingles of hash below 2 (1 - s) (its sample) are dealt out
   by hash ranges and counted exactly, which orders them: rare first. Of a
   sample of t > m shingles a similar set has all but m, so its first m + 1
   shingles in that order hold a common one (prefix filter). Those that no other
   set has are dropped: a set with more than m of them is done. Sets with t <= m
   are dealt out whole, in a space of their own, besides.
2. Nodes that share a first shingle are compared by their sizes and by an upper
   bound of the overlap from 1024-bit images of the sets; what may be similar is
   connected. This loses no similar pair, and leaves small families.
3. Each family's whole sets meet in one task, in a prefix tree that is searched
   exactly. A family of more than FAMILY_TOKENS shingles is cut into blocks;
   each two blocks meet in a task, and the links found are connected again.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, lean, materialize, slices_of, split_by
from .components import components
from .prefix_tree import link_roots
from .shingles import mix, shingle_sets

IMAGE_WORDS = 16
RUN_BLOCK = 4096
FAMILY_TOKENS = 2_000_000
#: Nodes of more than a HOT-th of all rows are broadcast.
HOT = 1000
_U = np.uint64


def need(size: int, num: int, den: int) -> int:
    """The least overlap of a set of this size with any similar set."""
    return -(-num * size // den)


def image_of(hashes: np.ndarray) -> bytes:
    bits = np.zeros(IMAGE_WORDS * 64, dtype=np.uint8)
    bits[((hashes >> _U(7)) % _U(IMAGE_WORDS * 64)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def _maybe(n1, b1, n2, b2, num: int, den: int):
    """Whether sets of these sizes and images can be similar: an element whose bit the other lacks is not shared."""
    most = np.minimum(n1 - np.bitwise_count(b1 & ~b2).sum(axis=-1, dtype=np.int64), n2 - np.bitwise_count(b2 & ~b1).sum(axis=-1, dtype=np.int64))
    return (den * most >= num * (n1 + n2 - most)) & (den * np.minimum(n1, n2) >= num * np.maximum(n1, n2))


def _forest(nodes: np.ndarray, sizes: np.ndarray, images: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Edges that connect what may be similar: a breadth-first search that compares with unreached nodes only."""
    edges: list[tuple[int, int]] = []
    left = np.arange(len(nodes))
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            k = queue.pop()
            hit = _maybe(sizes[k], images[k], sizes[left], images[left], num, den)
            reached = left[hit]
            left = left[~hit]
            edges += [(int(nodes[k]), int(nodes[r])) for r in reached]
            queue += reached.tolist()
    return edges


def sample_of(hashes: np.ndarray, num: int, den: int) -> np.ndarray:
    """The shingles whose hash lies in the lowest 2 (1 - num / den) of all."""
    return hashes[hashes <= _U(min((1 << 64) - 1, (1 << 64) * 2 * (den - num) // den))]


def _node_of(hashes: np.ndarray) -> int | None:
    return xxhash.xxh64_intdigest(hashes.tobytes()) - (1 << 63) if len(hashes) else None


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")


def _describe(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """doc_id, h (a hash of the text), n, node (a hash of the set; null if empty), t (size of the sample), image."""

    def describe(batches):
        import pyarrow as pa

        for batch in slices_of(batches):
            n, node, t, image = [], [], [], []
            for s in shingle_sets(batch["text"].to_pylist(), k):
                n.append(len(s))
                node.append(_node_of(s))
                t.append(len(sample_of(s, num, den)))
                image.append(image_of(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["h"], pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(t, pa.int64()), pa.array(image, pa.binary())], names=["doc_id", "h", "n", "node", "t", "image"])

    return _slim(docs).mapInArrow(lean(describe), "doc_id long, h long, n long, node long, t long, image binary")


def _shared(docs: DataFrame, k: int, num: int, den: int, bits: int) -> DataFrame:
    """node, token, df, block, blocks: the sampled shingles that at least two nodes have.

    A token's lowest bit is 1 in the space of whole sets. The nodes of a token
    are numbered into blocks of RUN_BLOCK.
    """

    def spread(batches):
        """A row for each hash range: tokens and their nodes. A task sends a set once, however many copies it reads."""
        import pyarrow as pa

        seen: set[int] = set()
        for batch in slices_of(batches):
            tokens, nodes = [], []
            for s in shingle_sets(batch["text"].to_pylist(), k):
                node = _node_of(s)
                if node is None or node in seen:
                    continue
                seen.add(node)
                part = sample_of(s, num, den) & _U(0xFFFFFFFFFFFFFFFE)
                if len(part) <= len(s) - need(len(s), num, den):
                    part = np.concatenate([part, s | _U(1)])
                tokens.append(part)
                nodes.append(np.full(len(part), node, dtype=np.int64))
            if not tokens:
                continue
            token, node = np.concatenate(tokens), np.concatenate(nodes)
            ranges = (mix(token | _U(1)) >> _U(64 - bits)).astype(np.int64)
            order = np.argsort(ranges, kind="stable")
            token, node, ranges = token[order], node[order], ranges[order]
            cut = np.searchsorted(ranges, np.arange((1 << bits) + 1))
            some = np.flatnonzero(np.diff(cut)).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([token[cut[r] : cut[r + 1]].tobytes() for r in some], pa.binary()), pa.array([node[cut[r] : cut[r + 1]].tobytes() for r in some], pa.binary())], names=["range", "tokens", "nodes"])

    def count(batches):
        import pyarrow as pa

        def solve(parts):
            token, node = np.frombuffer(b"".join(p[0] for p in parts), dtype=np.int64), np.frombuffer(b"".join(p[1] for p in parts), dtype=np.int64)
            order = np.lexsort((node, token))
            token, node = token[order], node[order]
            fresh = np.r_[True, (token[1:] != token[:-1]) | (node[1:] != node[:-1])]
            token, node = token[fresh], node[fresh]
            start = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
            length = np.diff(np.r_[start, len(token)])
            df = np.repeat(length, length)
            block = (np.arange(len(token)) - np.repeat(start, length)) // RUN_BLOCK
            keep = df > 1
            df, block = df[keep], block[keep]
            return pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(token[keep]), pa.array(df, pa.int64()), pa.array(block, pa.int32()), pa.array(-(-df // RUN_BLOCK), pa.int32())], names=["node", "token", "df", "block", "blocks"])

        held, parts = None, []
        for batch in batches:
            for r, tokens, nodes in zip(batch["range"].to_pylist(), batch["tokens"].to_pylist(), batch["nodes"].to_pylist(), strict=True):
                if r != held and parts:
                    yield solve(parts)
                    parts = []
                held = r
                parts.append((tokens, nodes))
        if parts:
            yield solve(parts)

    spreaded = docs.filter("doc_id is not null").select("text").mapInArrow(lean(spread), "range int, tokens binary, nodes binary")
    return spreaded.repartition("range").sortWithinPartitions("range").mapInArrow(lean(count), "node long, token long, df long, block int, blocks int")


def _first_shared(shared: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """The rows of ``shared`` whose token is among its node's first m + 1, rare first; unshared ones come before all."""
    m = F.col("n") - F.floor((F.col("n") * num + (den - 1)) / F.lit(den)).cast("long")
    whole = F.col("token").bitwiseAND(F.lit(1).cast("long")) == 1
    every = Window.partitionBy("node", "whole")
    ranked = (
        shared.join(nodes.select("node", "n", "t"), "node")
        .withColumn("whole", whole)
        .withColumn("_shared", F.count("*").over(every))
        .withColumn("_place", F.row_number().over(every.orderBy("df", "token")))
    )
    alone = F.when(F.col("whole"), F.col("n")).otherwise(F.col("t")) - F.col("_shared")
    kept = (~F.col("whole") & (F.col("t") <= m)) | (F.col("_place") <= m + 1 - alone)
    # images only now, so that the sort does not carry them
    return ranked.filter(kept).select("token", "block", "blocks", "node", "n").join(nodes.select("node", "image"), "node")


def _pairs_of_blocks(df: DataFrame, blocks: str, block: str) -> DataFrame:
    """Rows of a group in one block as they are; else each row once for every two blocks with its own, as ``half1``, ``half2``."""
    own, n = F.col(block), F.col(blocks)
    other = F.when(n > 1, F.filter(F.sequence(F.lit(0), n - 1), lambda x: x != own)).otherwise(F.array(F.lit(0)))
    return df.withColumn("_other", F.explode(other)).withColumn("half1", F.least(own, "_other")).withColumn("half2", F.greatest(own, "_other")).drop("_other")


def _families(first: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): edges that connect all nodes that may be similar."""
    rows = _pairs_of_blocks(first, "blocks", "block").select("token", "half1", "half2", "node", "n", "image")

    def connect(batches):
        import pyarrow as pa

        pending: list = []
        held_key = None

        def solve(parts):
            key = np.concatenate([p[0] for p in parts])
            nodes_, sizes = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
            images = np.concatenate([p[3] for p in parts])
            start = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
            length = np.diff(np.r_[start, len(key)])
            edges: list[tuple[int, int]] = []
            two = start[length == 2]
            if len(two):
                ok = _maybe(sizes[two], images[two], sizes[two + 1], images[two + 1], num, den)
                edges += zip(nodes_[two[ok]].tolist(), nodes_[two[ok] + 1].tolist(), strict=True)
            for s, n in zip(start[length > 2].tolist(), length[length > 2].tolist(), strict=True):
                edges += _forest(nodes_[s : s + n], sizes[s : s + n], images[s : s + n], num, den)
            edges = list(dict.fromkeys(edges))
            return pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch["token"].to_numpy(), batch["half1"].to_numpy().astype(np.int64), batch["half2"].to_numpy().astype(np.int64)], axis=1)
            row = (key, batch["node"].to_numpy(), batch["n"].to_numpy(), np.frombuffer(b"".join(batch["image"].to_pylist()), dtype=_U).reshape(-1, IMAGE_WORDS))
            change = np.flatnonzero((key[1:] != key[:-1]).any(axis=1))
            if pending and (held_key != key[0]).any():
                yield solve(pending)
                pending = []
            if len(change):  # the last group may go on in the next batch
                cut = int(change[-1]) + 1
                yield solve([*pending, tuple(x[:cut] for x in row)])
                pending = [tuple(x[cut:] for x in row)]
            else:
                pending.append(row)
            held_key = key[-1]
        if pending:
            yield solve(pending)

    dealt = rows.repartition("token", "half1", "half2").sortWithinPartitions("token", "half1", "half2", "node")
    return dealt.mapInArrow(lean(connect), "a long, b long").distinct()


def _verified(docs: DataFrame, members: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """members(rep, node, family, n) -> (a, b): a node and the node that stands for its component in a task."""
    weight = members.groupBy("family").agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / F.lit(FAMILY_TOKENS))).cast("int").alias("blocks"))
    placed = members.join(weight, "family").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    wanted = placed.select("rep.doc_id", "rep.h", "node", "family", "blocks", "block")

    def sets(batches):
        import pyarrow as pa

        for batch in slices_of(batches, 500):
            found = [s.tobytes() for s in shingle_sets(batch["text"].to_pylist(), k)]
            rest = batch.select(["node", "family", "blocks", "block"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(found, pa.binary())], names=["node", "family", "blocks", "block", "tokens"])

    # of rows equal in id and text all come; the join below takes one
    slim, _ = split_by(_slim(docs), "h", wanted, "h")
    whole = slim.join(wanted, ["doc_id", "h"]).select("text", "node", "family", "blocks", "block").mapInArrow(lean(sets), "node long, family long, blocks int, block int, tokens binary")
    dealt = _pairs_of_blocks(whole, "blocks", "block").repartition("family", "half1", "half2").sortWithinPartitions("family", "half1", "half2", "node")

    def join(batches):
        import pyarrow as pa

        key, nodes, held = None, [], []

        def solve():
            root = link_roots(held, num, den)
            return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([nodes[r] for r in root], pa.int64())], names=["a", "b"])

        for batch in batches:
            for *at, node, tokens in zip(*(batch[c].to_pylist() for c in ("family", "half1", "half2", "node", "tokens")), strict=True):
                if at != key:
                    if nodes:
                        yield solve()
                    key, nodes, held = at, [], []
                if nodes and nodes[-1] == node:  # a repeated row
                    continue
                nodes.append(node)
                held.append(np.frombuffer(tokens, dtype=_U))
        if nodes:
            yield solve()

    return dealt.select("family", "half1", "half2", "node", "tokens").mapInArrow(lean(join), "a long, b long")


def _components(docs: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, h, n, node) for all of ``docs``, and of every node: node, copies, winner.

    The winner of a component is its least (doc_id, h).
    """
    rows = materialize(_describe(docs, k, num, den), "sets")
    real = rows.filter("node is not null and doc_id is not null")
    rep = F.min(F.struct("doc_id", "h")).alias("rep")
    nodes = materialize(real.groupBy("node").agg(rep, F.count("*").alias("copies"), F.first("n").alias("n"), F.first("t").alias("t"), F.first("image").alias("image")), "nodes")
    # a range has the sampled shingles of some thousand documents
    bits = int(max(6, np.ceil(np.log2(max(1, nodes.count() / 1000)))))
    shared = materialize(_shared(docs, k, num, den, bits), "shared")
    edges = materialize(_families(_first_shared(shared, nodes, num, den), num, den), "edges")
    forget(shared)
    families = components(edges).withColumnRenamed("root", "family")
    members = materialize(families.join(nodes.select(F.col("node").alias("vertex"), "rep", "n"), "vertex").withColumnRenamed("vertex", "node"), "members")
    forget(edges)
    linked = materialize(_verified(docs, members, k, num, den), "links")
    cut = members.groupBy("family").agg(F.sum("n").alias("n")).filter(F.col("n") > FAMILY_TOKENS)
    if cut.take(1):
        labels = components(linked).withColumnRenamed("vertex", "a").withColumnRenamed("root", "b")
    else:
        labels = linked
    known = labels.select(F.col("a").alias("node"), F.col("b").alias("root")).join(nodes.select("node", "rep"), "node")
    least = known.groupBy("root").agg(F.min("rep").alias("winner"))
    of_node = known.join(least, "root").select("node", "winner")
    every = nodes.select("node", "rep", "copies").join(of_node, "node", "left").select("node", "copies", F.coalesce("winner", "rep").alias("winner"))
    every = materialize(every, "winners")
    forget(nodes, members, linked)
    return rows, every


def _with_winners(rows: DataFrame, every: DataFrame) -> DataFrame:
    """``rows`` with their node's winner; rows without a node or doc_id get a null.

    The nodes of more than a HOT-th of all rows, fewer than HOT, are broadcast,
    so that no task gets all copies of one text; the rest meet by node.
    """
    total = rows.count()
    few = every.filter(F.col("copies") > total / HOT).select("node", F.col("winner").alias("hot"))
    alone = F.col("node").isNull() | F.col("doc_id").isNull()
    none = F.lit(None).cast(every.schema["winner"].dataType).alias("winner")
    marked = rows.filter(~alone).join(F.broadcast(few), "node", "left")
    plain = marked.filter("hot is null").drop("hot").join(every.filter(F.col("copies") <= total / HOT).select("node", "winner"), "node", "left")
    hot = marked.filter("hot is not null").withColumnRenamed("hot", "winner")
    return rows.filter(alone).withColumn("winner", none).unionByName(plain).unionByName(hot)


def jaccard_components(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """doc_id, n_shingles, component_id for every row: documents are linked when den * |A & B| >= num * |A | B|.

    The sets are distinct k-word shingles of the whole text in lower case A-Z
    (fewer words: the whole sequence as one). Null and empty texts, and those
    without words, have no shingles and are linked with nothing. A row with a
    null doc_id gets a null component and links nothing. Repeated rows stay;
    rows of one doc_id with different texts are documents of their own, and a
    component's id is the least of its doc_ids. A text's set is held whole by a
    task (8 bytes a word). An empty table gives an empty table. Columns other
    than doc_id and text are not read, whatever their names.
    """
    rows, every = _components(docs, k, num, den)
    out = _with_winners(rows.select("doc_id", "n", "node"), every)
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("winner.doc_id", "doc_id")).alias("component_id"),
    )


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one document of each component left; all columns stay.

    That of the least doc_id stays, and of rows of one doc_id that of the least
    hash of the text; of rows equal in both, any one. Decisions are by doc_id
    and text, so another text under the id of a copy stays. Rows with a null
    doc_id, and those whose text is null or has no words, all stay. An empty
    table gives an empty table.
    """
    rows, every = _components(docs, k, num, den)
    decided = _with_winners(rows.select("doc_id", "h", "node"), every).filter("winner is not null")
    lost = (F.col("winner.doc_id") != F.col("doc_id")) | (F.col("winner.h") != F.col("h"))
    decided = decided.groupBy("doc_id", "h").agg(F.first(lost).alias("_lost"), (F.count("*") > 1).alias("_again"))
    decided = materialize(decided.filter("_lost or _again"), "decided")
    packed = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_h"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    on = lambda t: (F.col("_id") == t["doc_id"]) & (F.col("_h") == t["h"])
    # most texts are not among the decided ones and need no shuffle
    some, rest = split_by(packed, "_h", decided, "h")
    few = decided.select("doc_id", "h")
    kept = rest.select("_row").unionByName(some.join(few, on(few), "left_anti").select("_row"))
    again = decided.filter("not _lost")
    if again.take(1):
        one = some.join(again, on(again), "left_semi").groupBy("_id", "_h").agg(F.first("_row").alias("_row"))
        kept = kept.unionByName(one.select("_row"))
    return kept.select("_row.*")
