"""A tiny writer of test files."""

from __future__ import annotations

import zlib


def build(objects: dict[int, bytes], broken: bool = False) -> bytes:
    out = bytearray(b"%PDF-1.7\n")
    at = {}
    for n, body in objects.items():
        at[n] = len(out)
        out += b"%d 0 obj\n" % n + body + b"\nendobj\n"
    start = len(out)
    size = max(objects) + 1
    out += b"xref\n0 %d\n0000000000 65535 f \n" % size
    for n in range(1, size):
        out += b"%010d 00000 n \n" % at.get(n, 0)
    out += b"trailer\n<< /Size %d /Root 1 0 R /Info 9 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (size, 7 if broken else start)
    return bytes(out)


def stream(data: bytes, kind: str = "plain") -> bytes:
    if kind == "flate":
        data = zlib.compress(data)
        return b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(data) + data + b"\nendstream"
    if kind == "hex":
        data = data.hex().encode() + b">"
        return b"<< /Length %d /Filter [/ASCIIHexDecode] >>\nstream\n" % len(data) + data + b"\nendstream"
    if kind == "a85":
        import base64

        data = base64.a85encode(data) + b"~>"
        return b"<< /Length %d /Filter /ASCII85Decode >>\nstream\n" % len(data) + data + b"\nendstream"
    return b"<< /Length %d >>\nstream\n" % len(data) + data + b"\nendstream"


def document(contents: list[bytes], kind: str = "plain", rotate: int = 0, broken: bool = False) -> bytes:
    n = len(contents)
    kids = b" ".join(b"%d 0 R" % (20 + 2 * i) for i in range(n))
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R /PageLabels << /Nums [0 << /S /r >> 1 << /S /D /P (A-) /St 5 >>] >> /Outlines 5 0 R >>",
        2: b"<< /Type /Pages /Kids [" + kids + b"] /Count %d /MediaBox [0 0 200 100] /Resources << /Font << /F1 3 0 R >> >> >>" % n,
        3: b"<< /Type /Font /Subtype /Type1 /BaseFont /Courier /Encoding /WinAnsiEncoding >>",
        5: b"<< /First 6 0 R >>",
        6: b"<< /Title (One) /Next 7 0 R >>",
        7: b"<< /Title <FEFF00540077006F> >>",
        9: b"<< /Title (A \\(test\\)) /CreationDate (D:20240102030405+01'00') >>",
    }
    for i, c in enumerate(contents):
        objects[20 + 2 * i] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R /Rotate %d >>" % (21 + 2 * i, rotate)
        objects[21 + 2 * i] = stream(c, kind)
    return build(objects, broken)


TEXT = b"BT /F1 10 Tf 10 80 Td (Hello, World) Tj 0 -12 Td [(sec) -100 (ond)] TJ ET"
GRID = b"0 0 m 200 0 l S 0 50 m 200 50 l S 0 100 m 200 100 l S 0 0 m 0 100 l S 100 0 m 100 100 l S 200 0 m 200 100 l S BT /F1 10 Tf 40 75 Td (A) Tj 100 0 Td (B) Tj -100 -50 Td (C) Tj 100 0 Td (D) Tj ET"
