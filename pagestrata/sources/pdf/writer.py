"""Texts as page files: one glyph a cell of a fixed pitch, in several kinds of files, so that readers can be held against plain columns.

Line j of a text stands on page j div 64 + 1 with its top at 12 (j mod 64),
character i of a line at 6 i to 6 i + 6, the box 10 high: the model of
sources.glyphs. Characters are two bytes a code, which a map in the file gives
back. The kinds differ in filters, cross-references and encryption only.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import security

ADVANCE, LEADING, HEIGHT, LINES = 6, 12, 10, 64
KINDS = ("plain", "flate", "a85", "hex", "run", "predicted", "packed", "broken", "rc4", "aes128", "aes256", "form")
#: The same as aes256 with the slow key derivation of its later revision.
SLOW = "aes256r6"
PASSWORD = "open sesame"


def _stream(data: bytes, filters: str, attrs: bytes = b"") -> tuple[bytes, bytes]:
    """The head and data of a stream."""
    if filters == "flate":
        data, name = zlib.compress(data), b"/Filter /FlateDecode"
    elif filters == "a85":
        data, name = base64.a85encode(data) + b"~>", b"/Filter /A85"
    elif filters == "hex":
        data, name = data.hex().encode() + b">", b"/Filter [/ASCIIHexDecode]"
    elif filters == "run":
        parts = [data[i : i + 128] for i in range(0, len(data), 128)]
        data, name = b"".join(bytes([len(p) - 1]) + p for p in parts) + b"\x80", b"/Filter /RunLengthDecode"
    elif filters == "predicted":
        rows = [data[i : i + 32].ljust(32, b" ") for i in range(0, len(data), 32)]
        coded = bytearray()
        for k, row in enumerate(rows):
            above = rows[k - 1] if k else bytes(32)
            coded += b"\x02" + bytes((a - b) & 255 for a, b in zip(row, above, strict=True))
        data, name = zlib.compress(bytes(coded)), b"/Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 32 >>"
    else:
        name = b""
    return attrs + b" " + name, data


def _codes(texts: list[str]) -> dict[str, int]:
    return {c: k for k, c in enumerate(sorted({c for t in texts for c in t}), 1)}


def _page(lines: list[str], codes: dict[str, int]) -> bytes:
    high = LINES * LEADING
    shown = [b"1 0 0 1 0 %d Tm <%s> Tj" % (high - LEADING * j - HEIGHT, "".join(f"{codes[c]:04x}" for c in line).encode()) for j, line in enumerate(lines) if line]
    return b"BT /F1 10 Tf\n" + b"\n".join(shown) + b"\nET"


def _to_unicode(codes: dict[str, int]) -> bytes:
    pairs = [b"<%04x> <%s>" % (k, c.encode("utf-16-be").hex().encode()) for c, k in codes.items()]
    blocks = [b"%d beginbfchar\n" % len(p) + b"\n".join(p) + b"\nendbfchar" for p in (pairs[i : i + 100] for i in range(0, len(pairs), 100))]
    return b"1 begincodespacerange <0000> <ffff> endcodespacerange\n" + b"\n".join(blocks)


class _Locked:
    """Keys and the dictionary of an encrypted file; the user's password is empty, the owner's is PASSWORD."""

    def __init__(self, kind: str, file_id: bytes):
        self.kind, self.file_id = kind, file_id
        owner = security._old_password(PASSWORD)
        if kind in ("aes256", SLOW):
            digest, revision = (security.hash_r6, 6) if kind == SLOW else (security.hash_r5, 5)
            self.key = hashlib.sha256(b"file key" + file_id).digest()
            salts = hashlib.sha512(file_id).digest()
            u = digest(b"", salts[:8], b"") + salts[:16]
            o = digest(PASSWORD.encode(), salts[16:24], u) + salts[16:32]
            ue = security.aes_encrypt(digest(b"", salts[8:16], b""), bytes(16), self.key)
            oe = security.aes_encrypt(digest(PASSWORD.encode(), salts[24:32], u), bytes(16), self.key)
            crypt = b"/V 5 /R %d /Length 256 /CF << /StdCF << /CFM /AESV3 /AuthEvent /DocOpen /Length 32 >> >> /StmF /StdCF /StrF /StdCF" % revision
            self.entry = b"<< /Filter /Standard %s /P -44 /O <%s> /U <%s> /OE <%s> /UE <%s> >>" % (crypt, *[x.hex().encode() for x in (o, u, oe, ue)])
            return
        key = hashlib.md5(owner).digest()
        for _ in range(50):
            key = hashlib.md5(key).digest()
        o = security.PADDING
        for i in range(20):
            o = security.rc4(bytes(b ^ i for b in key), o)
        more = b"/V 4 /R 4 /Length 128 /CF << /StdCF << /CFM /AESV2 /Length 16 >> >> /StmF /StdCF /StrF /StdCF" if kind == "aes128" else b"/V 2 /R 3 /Length 128"
        k = hashlib.md5(security.PADDING + o + (-44 & 0xFFFFFFFF).to_bytes(4, "little") + file_id).digest()
        for _ in range(50):
            k = hashlib.md5(k).digest()
        self.key = k
        u = hashlib.md5(security.PADDING + file_id).digest()
        for i in range(20):
            u = security.rc4(bytes(b ^ i for b in k), u)
        self.entry = b"<< /Filter /Standard %s /P -44 /O <%s> /U <%s> >>" % (more, o.hex().encode(), u.ljust(32, b"\0").hex().encode())

    def seal(self, data: bytes, number: int) -> bytes:
        iv = hashlib.md5(self.file_id + number.to_bytes(4, "big")).digest()
        if self.kind in ("aes256", SLOW):
            return iv + security.aes_encrypt(self.key, iv, security.pad(data))
        key = hashlib.md5(self.key + number.to_bytes(3, "little") + b"\0\0" + (b"sAlT" if self.kind == "aes128" else b"")).digest()
        return iv + security.aes_encrypt(key, iv, security.pad(data)) if self.kind == "aes128" else security.rc4(key, data)


def document(text: str, kind: str = "plain") -> bytes:
    """A file of a text; ``kind`` is one of KINDS, or SLOW."""
    lines = text.split("\n")
    codes = _codes(lines)
    parts = [lines[i : i + LINES] for i in range(0, len(lines), LINES)]
    wide = max(1, *map(len, lines)) * ADVANCE
    box = b"[0 0 %d %d]" % (wide, LINES * LEADING)
    kids = b" ".join(b"%d 0 R" % (10 + 3 * i) for i in range(len(parts)))
    plain: dict[int, bytes] = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>",
        2: b"<< /Type /Pages /Kids [" + kids + b"] /Count %d /MediaBox " % len(parts) + box + b" /Resources << /Font << /F1 3 0 R >> >> >>",
        3: b"<< /Type /Font /Subtype /Type0 /BaseFont /Fixed /Encoding /Identity-H /DescendantFonts [4 0 R] /ToUnicode 6 0 R >>",
        4: b"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /Fixed /CIDSystemInfo << /Registry (Adobe) /Ordering (Identity) /Supplement 0 >> /DW 600 /FontDescriptor 5 0 R >>",
        5: b"<< /Type /FontDescriptor /FontName /Fixed /Ascent 1000 /Descent 0 /Flags 1 >>",
    }
    filters = kind if kind in ("flate", "a85", "hex", "run", "predicted") else "flate" if kind in ("packed", "aes256", SLOW) else "plain"
    streams = {6: _stream(_to_unicode(codes), filters)}
    for i, p in enumerate(parts):
        page, number = _page(p, codes), 10 + 3 * i
        if kind == "form":
            streams[number + 2] = _stream(page, filters, b"/Type /XObject /Subtype /Form /BBox " + box + b" /Resources << /Font << /F1 3 0 R >> >>")
            plain[number] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R /Resources << /XObject << /X %d 0 R >> >> >>" % (number + 1, number + 2)
            page = b"q /X Do Q"
        else:
            plain[number] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (number + 1)
        streams[number + 1] = _stream(page, filters)
    file_id = hashlib.md5(text.encode("utf-8", "surrogatepass")).digest()
    locked = _Locked(kind, file_id) if kind in ("rc4", "aes128", "aes256", SLOW) else None
    out, at = bytearray(b"%PDF-1.7\n"), {}

    def add(number: int, body: bytes) -> None:
        at[number] = len(out)
        out.extend(b"%d 0 obj\n" % number + body + b"\nendobj\n")

    if kind != "packed":
        for number, body in plain.items():
            if locked and number == 4:  # its strings are sealed too
                for word in (b"Adobe", b"Identity"):
                    body = body.replace(b"(" + word + b")", b"<" + locked.seal(word, number).hex().encode() + b">")
            add(number, body)
    for number, (attrs, data) in streams.items():
        data = locked.seal(data, number) if locked else data
        add(number, b"<< /Length %d %s >>\nstream\n" % (len(data), attrs) + data + b"\nendstream")
    last = max([*plain, *streams]) + 1
    if kind == "packed":
        heads, bodies = b"", b""
        for number, body in plain.items():
            heads += b"%d %d " % (number, len(bodies))
            bodies += body + b" "
        packed = zlib.compress(heads + bodies)
        add(last, b"<< /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >>\nstream\n" % (len(plain), len(heads), len(packed)) + packed + b"\nendstream")
        place = {n: (2, last, k) for k, n in enumerate(plain)} | {n: (1, a, 0) for n, a in at.items()}
        place[last + 1] = (1, len(out), 0)
        rows = b"".join(bytes([a]) + b.to_bytes(4, "big") + c.to_bytes(2, "big") for a, b, c in (place.get(n, (0, 0, 0)) for n in range(last + 2)))
        table, start = zlib.compress(rows), len(out)
        add(last + 1, b"<< /Type /XRef /Size %d /W [1 4 2] /Root 1 0 R /Filter /FlateDecode /Length %d >>\nstream\n" % (last + 2, len(table)) + table + b"\nendstream")
        return bytes(out + b"startxref\n%d\n%%%%EOF\n" % start)
    if locked:
        add(last, locked.entry)
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (last + 1)
    for number in range(1, last + 1):
        out += b"%010d 00000 %s \n" % (at.get(number, 0), b"n" if number in at else b"f")
    more = b" /Encrypt %d 0 R" % last if locked else b""
    ids = file_id.hex().encode()
    out += b"trailer\n<< /Size %d /Root 1 0 R /ID [<%s> <%s>]%s >>\nstartxref\n%d\n%%%%EOF\n" % (last + 1, ids, ids, more, 3 if kind == "broken" else start)
    return bytes(out)


def table_document(rows: list[list[str]], cell_width: int = 120, cell_height: int = 16) -> bytes:
    """A file of one page with a ruled grid, a text in each cell."""
    codes = _codes([c for r in rows for c in r])
    wide, high = cell_width * max(1, *map(len, rows)), cell_height * len(rows)
    sides = [b"0 %d m %d %d l S" % (y, wide, y) for y in range(0, high + 1, cell_height)] + [b"%d 0 m %d %d l S" % (x, x, high) for x in range(0, wide + 1, cell_width)]
    shown = [b"1 0 0 1 %d %d Tm <%s> Tj" % (cell_width * c + 2, high - cell_height * r - 3 - HEIGHT, "".join(f"{codes[x]:04x}" for x in text).encode()) for r, row in enumerate(rows) for c, text in enumerate(row) if text]
    content = b"\n".join(sides) + b"\nBT /F1 10 Tf\n" + b"\n".join(shown) + b"\nET"
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>",
        2: b"<< /Type /Pages /Kids [10 0 R] /Count 1 /MediaBox [0 0 %d %d] /Resources << /Font << /F1 3 0 R >> >> >>" % (wide, high),
        3: b"<< /Type /Font /Subtype /Type0 /BaseFont /Fixed /Encoding /Identity-H /DescendantFonts [4 0 R] /ToUnicode 6 0 R >>",
        4: b"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /Fixed /DW 600 /FontDescriptor 5 0 R >>",
        5: b"<< /Type /FontDescriptor /FontName /Fixed /Ascent 1000 /Descent 0 /Flags 1 >>",
        10: b"<< /Type /Page /Parent 2 0 R /Contents 11 0 R >>",
    }
    for number, data in ((6, _to_unicode(codes)), (11, content)):
        attrs, coded = _stream(data, "flate")
        objects[number] = b"<< /Length %d %s >>\nstream\n" % (len(coded), attrs) + coded + b"\nendstream"
    out, at = bytearray(b"%PDF-1.7\n"), {}
    for number, body in objects.items():
        at[number] = len(out)
        out += b"%d 0 obj\n" % number + body + b"\nendobj\n"
    start = len(out)
    out += b"xref\n0 12\n0000000000 65535 f \n" + b"".join(b"%010d 00000 %s \n" % (at.get(n, 0), b"n" if n in at else b"f") for n in range(1, 12))
    return bytes(out + b"trailer\n<< /Size 12 /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % start)


def rich_document(key: int, count: int) -> bytes:
    """A file with everything beside plain text, all of it following from a number and a number of pages.

    Page i (from 0) shows "part KEY page I" as marked content 0 of a structure
    element P, a gray image of 2 by 2, a form with a line, and a link; the file
    has an outline (one entry above one for each page), named destinations
    p0, p1 and so on, an attachment, page labels (i, then A-5, A-6), metadata,
    and pages turned by 90 degrees as often as the number says.
    """
    objects: dict[int, bytes] = {}
    kids, names, items, elements = [], [], [], []

    def stream(data: bytes, attrs: bytes = b"") -> bytes:
        more, coded = _stream(data, "flate")
        return b"<< /Length %d %s %s >>\nstream\n" % (len(coded), attrs, more) + coded + b"\nendstream"

    for i in range(count):
        n = 30 + 8 * i
        kids.append(b"%d 0 R" % n)
        names.append(b"(p%d) [%d 0 R /Fit]" % (i, n))
        shown = b"part %d page %d" % (key, i)
        content = b"/P << /MCID 0 >> BDC BT /F1 10 Tf 10 60 Td (" + shown + b") Tj ET EMC q 20 0 0 10 100 40 cm /Im Do Q q 1 0 0 1 5 5 cm /Fm Do Q"
        objects[n] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R /Annots [%d 0 R] /Rotate %d /StructParents %d >>" % (n + 1, n + 2, 90 * (key % 4), i)
        objects[n + 1] = stream(content)
        objects[n + 2] = b"<< /Type /Annot /Subtype /Link /Rect [10 20 60 40] /T (tip %d) /A << /S /URI /URI (http://example.org/%d/%d) >> >>" % (i, key, i)
        after = b" /Next %d 0 R" % (n + 11) if i + 1 < count else b""
        objects[n + 3] = b"<< /Title (Page %d) /Parent 12 0 R /Dest (p%d)%s >>" % (i + 1, i, after)
        objects[n + 4] = b"<< /Type /StructElem /S /Para /P 15 0 R /Pg %d 0 R /K 0 /Lang (en) /ActualText (text %d) >>" % (n, i)
        items.append(n + 3)
        elements.append(b"%d 0 R" % (n + 4))
    objects |= {
        1: b"<< /Type /Catalog /Pages 2 0 R /Outlines 11 0 R /Metadata 10 0 R /Names << /Dests << /Names [" + b" ".join(names) + b"] >> /EmbeddedFiles << /Names [(note) 13 0 R] >> >> /StructTreeRoot 16 0 R /PageLabels << /Nums [0 << /S /r >> 1 << /S /D /P (A-) /St 5 >>] >> >>",
        2: b"<< /Type /Pages /Kids [" + b" ".join(kids) + b"] /Count %d /MediaBox [0 0 200 100] /Resources << /Font << /F1 3 0 R >> /XObject << /Im 7 0 R /Fm 8 0 R >> >> >>" % count,
        3: b"<< /Type /Font /Subtype /Type1 /BaseFont /Courier /Encoding /WinAnsiEncoding >>",
        7: stream(bytes([key % 256, 0, 255, 128]), b"/Type /XObject /Subtype /Image /Width 2 /Height 2 /BitsPerComponent 8 /ColorSpace /DeviceGray"),
        8: stream(b"0 0 m 30 0 l S", b"/Type /XObject /Subtype /Form /BBox [0 0 30 10]"),
        9: b"<< /Title (part %d) /Producer (tables) >>" % key,
        10: stream(b"<x:xmpmeta>%d</x:xmpmeta>" % key, b"/Type /Metadata /Subtype /XML"),
        11: b"<< /Type /Outlines /First 12 0 R /Last 12 0 R >>",
        12: b"<< /Title (Part %d) /Parent 11 0 R /First %d 0 R >>" % (key, items[0]),
        13: b"<< /Type /Filespec /F (%d.txt) /EF << /F 14 0 R >> >>" % key,
        14: stream(b"attached to %d" % key),
        15: b"<< /Type /StructElem /S /Document /P 16 0 R /K [" + b" ".join(elements) + b"] >>",
        16: b"<< /Type /StructTreeRoot /K 15 0 R /RoleMap << /Para /P >> >>",
    }
    out, at = bytearray(b"%PDF-1.6\n"), {}
    for number in sorted(objects):
        at[number] = len(out)
        out += b"%d 0 obj\n" % number + objects[number] + b"\nendobj\n"
    start, size = len(out), max(objects) + 1
    out += b"xref\n0 %d\n0000000000 65535 f \n" % size
    for number in range(1, size):
        out += b"%010d 00000 %s \n" % (at.get(number, 0), b"n" if number in at else b"f")
    return bytes(out + b"trailer\n<< /Size %d /Root 1 0 R /Info 9 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (size, start))


def _dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt out by key to all tasks: a table that is small on disk comes in one part, but its files are work for all.

    The number is given, as adaptive execution would else put small rows together again.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def rich_files(df: DataFrame, key: str, count: Column) -> DataFrame:
    """doc_id, content: a ``rich_document`` for each row."""
    slim = _dealt(df.select(F.col(key).cast("long").alias("key"), count.cast("int").alias("n")), "key")

    def write(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                keys, sizes = part["key"].to_pylist(), part["n"].to_pylist()
                made = [rich_document(k, n) for k, n in zip(keys, sizes, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([str(k) for k in keys]), pa.array(made, pa.binary())], names=["doc_id", "content"])

    return slim.mapInArrow(write, "doc_id string, content binary")


def page_files(df: DataFrame, text: str = "text", key: str = "doc_id", kind: Column | None = None) -> DataFrame:
    """doc_id, kind, content: a file of each text that is not null; ``kind`` counts into KINDS (by a hash of the key, if not given)."""
    at = kind if kind is not None else F.pmod(F.xxhash64(F.col(key)), F.lit(len(KINDS)))
    slim = df.filter(F.col(text).isNotNull()).select(F.col(key).cast("string").alias("doc_id"), F.element_at(F.array(*[F.lit(k) for k in KINDS]), (at + 1).cast("int")).alias("kind"), F.col(text).alias("text"))
    slim = _dealt(slim, "doc_id")

    def write(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                made = [document(t, k) for t, k in zip(part["text"].to_pylist(), part["kind"].to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["kind"], pa.array(made, pa.binary())], names=["doc_id", "kind", "content"])

    return slim.mapInArrow(write, "doc_id string, kind string, content binary")


def table_files(df: DataFrame, key: str, columns: list[str], order: list[str]) -> DataFrame:
    """doc_id, content: a ruled table for each group of ``key``, a row a table row, a column an attribute."""
    cells = F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    rows = df.select(F.col(key).cast("string").alias("doc_id"), F.struct(*order, cells.alias("cells")).alias("r")).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["cells"]).alias("rows"))

    def write(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([table_document(r) for r in batch["rows"].to_pylist()], pa.binary())], names=["doc_id", "content"])

    return rows.mapInArrow(write, "doc_id string, content binary")
