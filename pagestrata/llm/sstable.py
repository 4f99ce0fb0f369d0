"""Token ids in sorted-string-table shards: prefix-compressed blocks, sparse index, Bloom filter, footer.

A file holds, in this order: data blocks, a Bloom filter, an index, a footer.

* Block: entries ``varint shared, varint unshared, varint value length, key
  suffix, value``; each RESTART-th entry has its whole key; then the restarts'
  offsets (u32 each), their number (u32) and a crc32 of all before (u32).
* Bloom filter: u32 number of hashes, then the bits.
* Index: for each block its last key (u16 length, bytes), offset (u64), length (u32).
* Footer: FOOTER (offsets and lengths of filter and index, entries, ids, id
  width, magic).

All integers are little-endian. A key is one byte (0: null id, 1: any other),
the id as a big-endian 64-bit integer with its sign bit turned, and a 32-bit
count that tells repeated ids apart, so byte order is id order.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, materialize, scratch_path, slices_of
from .tokens import END_ID, encoder, tokenizer_path

MAGIC = b"STRATA01"
FOOTER = struct.Struct("<QQQQQQI8s")
RESTART = 16
BLOCK_BYTES = 64 << 10
FILE_BYTES = 16 << 20


def make_key(doc_id: int | None, repeat: int) -> bytes:
    return b"\x00" + bytes(8) + struct.pack(">I", repeat) if doc_id is None else b"\x01" + struct.pack(">QI", doc_id + (1 << 63), repeat)


def read_key(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:9])[0] - (1 << 63) if key[0] else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _bloom_places(key: bytes, hashes: int, bits: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x9E3779B9) | 1
    return [(a + i * b) % bits for i in range(hashes)]


class Writer:
    """Builds one file in memory from keys in ascending order."""

    def __init__(self, width: int, block_bytes: int = BLOCK_BYTES):
        self.width, self.block_bytes = width, block_bytes
        self.out, self.block, self.restarts = bytearray(), bytearray(), [0]
        self.keys: list[bytes] = []
        self.index: list[tuple[bytes, int, int]] = []
        self.last, self.in_block, self.ids = b"", 0, 0

    def add(self, key: bytes, value: bytes) -> None:
        if self.keys and key <= self.last:
            raise ValueError("keys must ascend")
        shared = 0
        if self.in_block % RESTART:
            most = min(len(key), len(self.last))
            while shared < most and key[shared] == self.last[shared]:
                shared += 1
        elif self.in_block:
            self.restarts.append(len(self.block))
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last, self.in_block, self.ids = key, self.in_block + 1, self.ids + len(value) // self.width
        self.keys.append(key)
        if len(self.block) >= self.block_bytes:
            self._close_block()

    def _close_block(self) -> None:
        if not self.in_block:
            return
        self.block += struct.pack(f"<{len(self.restarts)}II", *self.restarts, len(self.restarts))
        self.block += struct.pack("<I", zlib.crc32(self.block))
        self.index.append((self.last, len(self.out), len(self.block)))
        self.out += self.block
        self.block, self.restarts, self.in_block = bytearray(), [0], 0

    def __len__(self) -> int:
        return len(self.out) + len(self.block)

    def finish(self) -> bytes:
        self._close_block()
        hashes, bits = 7, max(64, 10 * len(self.keys))
        bloom = np.zeros((bits + 7) // 8, dtype=np.uint8)
        for key in self.keys:
            for p in _bloom_places(key[:9], hashes, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        filter_at = len(self.out)
        self.out += struct.pack("<IQ", hashes, bits) + bloom.tobytes()
        index_at = len(self.out)
        for key, at, n in self.index:
            self.out += struct.pack("<H", len(key)) + key + struct.pack("<QI", at, n)
        end = len(self.out)
        self.out += FOOTER.pack(filter_at, index_at - filter_at, index_at, end - index_at, len(self.keys), self.ids, self.width, MAGIC)
        return bytes(self.out)


class Table:
    """Reads one file: lookups by binary search, or all entries in order."""

    def __init__(self, data: bytes):
        self.data = data
        *where, self.entries, self.ids, self.width, magic = FOOTER.unpack(data[-FOOTER.size :])
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        filter_at, filter_len, at, index_len = where
        self.hashes, self.bits = struct.unpack_from("<IQ", data, filter_at)
        self.bloom = memoryview(data)[filter_at + 12 : filter_at + filter_len]
        self.last_keys: list[bytes] = []
        self.blocks: list[tuple[int, int]] = []
        end = at + index_len
        while at < end:
            (n,) = struct.unpack_from("<H", data, at)
            self.last_keys.append(data[at + 2 : at + 2 + n])
            self.blocks.append(struct.unpack_from("<QI", data, at + 2 + n))
            at += 14 + n

    def _entries(self, which: int, begin: int = 0) -> Iterator[tuple[bytes, bytes]]:
        at, n = self.blocks[which]
        block = self.data[at : at + n]
        if zlib.crc32(block[:-4]) != struct.unpack("<I", block[-4:])[0]:
            raise ValueError("damaged block")
        (restarts,) = struct.unpack("<I", block[-8:-4])
        end, key, at = n - 8 - 4 * restarts, b"", begin
        while at < end:
            shared, at = _read_varint(block, at)
            unshared, at = _read_varint(block, at)
            size, at = _read_varint(block, at)
            key = key[:shared] + block[at : at + unshared]
            yield key, block[at + unshared : at + unshared + size]
            at += unshared + size

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for k in range(len(self.blocks)):
            yield from self._entries(k)

    def get(self, doc_id: int | None, repeat: int = 0) -> np.ndarray | None:
        """The ids of a document, or None."""
        key = make_key(doc_id, repeat)
        if any(not self.bloom[p >> 3] >> (p & 7) & 1 for p in _bloom_places(key[:9], self.hashes, self.bits)):
            return None
        which = bisect_left(self.last_keys, key)
        if which == len(self.last_keys):
            return None
        at, n = self.blocks[which]
        (restarts,) = struct.unpack_from("<I", self.data, at + n - 8)
        starts = struct.unpack_from(f"<{restarts}I", self.data, at + n - 8 - 4 * restarts)
        lo, hi = 0, restarts
        while hi - lo > 1:  # the last restart whose key is not beyond the one sought
            mid = (lo + hi) // 2
            first = next(self._entries(which, starts[mid]))[0]
            lo, hi = (mid, hi) if first <= key else (lo, mid)
        for found, value in self._entries(which, starts[lo]):
            if found == key:
                return np.frombuffer(value, dtype=f"<u{self.width}")
            if found > key:
                return None
        return None


def _store(folder: str, name: str, data: bytes) -> None:
    """Write whole under another name, then rename: a lost or repeated task leaves a whole file or none."""
    from pyarrow import fs

    # Hadoop's names of the same store
    to, path = fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", folder))
    to.create_dir(path, recursive=True)
    draft = f"{path}/_{uuid.uuid4().hex}"
    with to.open_output_stream(draft) as f:
        f.write(data)
    to.move(draft, f"{path}/{name}")


MANIFEST = "file string, first_null boolean, first_id long, part int, seq int, entries long, ids long"


def write_shards(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID, file_bytes: int = FILE_BYTES, partitions: int | None = None) -> DataFrame:
    """Encode every whole text and write files in ascending doc_id order to ``folder``; returns the manifest, one row a file.

    A null text gives the end id alone; null doc_ids stand first; repeated
    doc_ids are kept, told apart by a count in their key. An empty table writes
    no file. Rows of one id stand in the order of their texts. ``file_bytes``
    and the longest text bound what a task holds. Columns other than doc_id and
    text are not read, whatever their names.
    """
    path = tokenizer or tokenizer_path()

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        enc = encoder(path)
        width = enc.dtype.itemsize
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        part = TaskContext.get().partitionId()
        rows: list[tuple] = []
        writer, first, before, repeat = None, None, (), 0

        def close():
            name = f"part-{part:06d}-{len(rows):05d}.sst"
            entries, ids = len(writer.keys), writer.ids
            _store(folder, name, writer.finish())
            rows.append((name, first is None, first, part, len(rows), entries, ids))

        for batch in slices_of(batches):
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), enc.encode(batch["text"].to_pylist()), strict=True):
                repeat = repeat + 1 if (doc_id,) == before else 0
                before = (doc_id,)
                if writer is None:
                    writer, first = Writer(width), doc_id
                writer.add(make_key(doc_id, repeat), ids + end)
                if len(writer) >= file_bytes:
                    close()
                    writer = None
        if writer is not None:
            close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*[(r[0], r[1], r[2], r[3], r[4], r[5], r[6]) for r in rows], strict=True)][:3] + [pa.array([r[3] for r in rows], pa.int32()), pa.array([r[4] for r in rows], pa.int32()), pa.array([r[5] for r in rows], pa.int64()), pa.array([r[6] for r in rows], pa.int64())], names=["file", "first_null", "first_id", "part", "seq", "entries", "ids"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt = slim.repartitionByRange(partitions, "doc_id") if partitions else slim.repartitionByRange("doc_id")
    return materialize(dealt.sortWithinPartitions("doc_id", "text").mapInArrow(lean(write), MANIFEST), "manifest")


def read_shards(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Every document of the files: doc_id, start (ids before it), n_tokens, ids_crc32, from the files' bytes."""

    def parse(batches):
        import pyarrow as pa

        for batch in batches:
            for name, data in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                table = Table(data.as_py())
                ids, n, crc = [], [], []
                for key, value in table:
                    ids.append(read_key(key))
                    n.append(len(value) // table.width)
                    crc.append(zlib.crc32(np.frombuffer(value, dtype=f"<u{table.width}").astype("<u4").tobytes()))
                at = np.cumsum([0, *n[:-1]])
                yield pa.RecordBatch.from_arrays([pa.array([name.rsplit("/", 1)[-1]] * len(ids)), pa.array(ids, pa.int64()), pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], names=["file", "doc_id", "at", "n_tokens", "ids_crc32"])

    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    base = manifest.select("file", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    if not manifest.take(1):
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.sst").load(folder).select("path", "content")
    rows = files.mapInArrow(lean(parse), "file string, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(base, "file").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def roundtrip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write ``docs`` as shards into a fresh shared folder and return what the files say of each document."""
    folder = scratch_path(docs.sparkSession, "sst")
    return read_shards(docs.sparkSession, folder, write_shards(docs, folder, tokenizer))
