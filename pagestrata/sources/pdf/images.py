"""Images: group 4 fax decoding, JBIG2 segments, bitmaps, and what file an image stream is exported as."""

from __future__ import annotations

import re
import struct
from functools import lru_cache
from typing import Any

from .syntax import File, Name, Stream

#: Images that would be larger decoded are given out as their raw bytes.
MOST_BYTES = 256 << 20

# Codes of runs (ITU-T T.4), in the order of the run lengths 0 to 63 and 64, 128 to 1728.
_WHITE = "00110101 000111 0111 1000 1011 1100 1110 1111 10011 10100 00111 01000 001000 000011 110100 110101 101010 101011 0100111 0001100 0001000 0010111 0000011 0000100 0101000 0101011 0010011 0100100 0011000 00000010 00000011 00011010 00011011 00010010 00010011 00010100 00010101 00010110 00010111 00101000 00101001 00101010 00101011 00101100 00101101 00000100 00000101 00001010 00001011 01010010 01010011 01010100 01010101 00100100 00100101 01011000 01011001 01011010 01011011 01001010 01001011 00110010 00110011 00110100 11011 10010 010111 0110111 00110110 00110111 01100100 01100101 01101000 01100111 011001100 011001101 011010010 011010011 011010100 011010101 011010110 011010111 011011000 011011001 011011010 011011011 010011000 010011001 010011010 011000 010011011"
_BLACK = "0000110111 010 11 10 011 0011 0010 00011 000101 000100 0000100 0000101 0000111 00000100 00000111 000011000 0000010111 0000011000 0000001000 00001100111 00001101000 00001101100 00000110111 00000101000 00000010111 00000011000 000011001010 000011001011 000011001100 000011001101 000001101000 000001101001 000001101010 000001101011 000011010010 000011010011 000011010100 000011010101 000011010110 000011010111 000001101100 000001101101 000011011010 000011011011 000001010100 000001010101 000001010110 000001010111 000001100100 000001100101 000001010010 000001010011 000000100100 000000110111 000000111000 000000100111 000000101000 000001011000 000001011001 000000101011 000000101100 000001011010 000001100110 000001100111 0000001111 000011001000 000011001001 000001011011 000000110011 000000110100 000000110101 0000001101100 0000001101101 0000001001010 0000001001011 0000001001100 0000001001101 0000001110010 0000001110011 0000001110100 0000001110101 0000001110110 0000001110111 0000001010010 0000001010011 0000001010100 0000001010101 0000001011010 0000001011011 0000001100100 0000001100101"
# Codes of the runs 1792, 1856 to 2560 of both colours.
_LONG = "00000001000 00000001100 00000001101 000000010010 000000010011 000000010100 000000010101 000000010110 000000010111 000000011100 000000011101 000000011110 000000011111"
# Two-dimensional modes (ITU-T T.6): how far a change lies from the one above, or P and H.
_MODES = {"1": 0, "011": 1, "000011": 2, "0000011": 3, "010": -1, "000010": -2, "0000010": -3, "0001": "P", "001": "H"}


@lru_cache(maxsize=2)
def run_codes(black: bool) -> dict[str, int]:
    codes = (_BLACK if black else _WHITE).split()
    lengths = [*range(64), *range(64, 1729, 64)]
    return dict(zip(codes, lengths, strict=True)) | dict(zip(_LONG.split(), range(1792, 2561, 64), strict=True))


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, 8 * len(data)

    def code(self, table: dict[str, Any], longest: int) -> Any:
        """The value of the next code, or None at the end or where there is none."""
        word = ""
        for i in range(self.at, min(self.end, self.at + longest)):
            word += "1" if self.data[i >> 3] >> (7 - (i & 7)) & 1 else "0"
            if word in table:
                self.at = i + 1
                return table[word]
        return None

    def align(self) -> None:
        self.at = -(-self.at // 8) * 8


def _run(bits: _Bits, black: bool) -> int | None:
    total = 0
    while True:
        n = bits.code(run_codes(black), 13)
        if n is None:
            return None
        total += n
        if n < 64:
            return total


def fax_rows(data: bytes, columns: int, align: bool = False) -> list[list[int]]:
    """Rows of group 4 data as the places where the colour changes, beginning with white; as far as the data are sound."""
    bits, rows, above = _Bits(data), [], []
    while True:
        if align:
            bits.align()
        row: list[int] = []
        a0, black = -1, False
        while a0 < columns:
            # the first change above to the right of a0 that begins the other colour
            b = next((i for i, x in enumerate(above) if x > a0 and (i % 2 == 1) == black), len(above))
            b1 = above[b] if b < len(above) else columns
            mode = bits.code(_MODES, 7)
            if mode is None:
                return rows
            if mode == "P":
                a0 = above[b + 1] if b + 1 < len(above) else columns
            elif mode == "H":
                first, second = _run(bits, black), None
                if first is not None:
                    second = _run(bits, not black)
                if first is None or second is None:
                    return rows
                a1 = min(columns, max(a0, 0) + first)
                a0 = min(columns, a1 + second)
                row += [a1, a0]
            else:
                a0 = max(0, min(columns, b1 + mode))
                row.append(a0)
                black = not black
            if a0 >= columns:
                break
        above = [x for x in row if x < columns]
        rows.append(above)


def fax_decode(data: bytes, params: dict[str, Any]) -> bytes:
    """Group 4 fax data (K = -1) as packed rows, white 1 unless BlackIs1."""
    if params.get("K", 0) != -1:
        raise ValueError("fax data other than group 4")
    columns = int(params.get("Columns", 1728))
    reverse = params.get("BlackIs1") is True
    out = bytearray()
    for changes in fax_rows(data, columns, params.get("EncodedByteAlign") is True):
        row, edges = 0, [0, *changes, columns]
        for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            if (i % 2 == 0) != reverse and b > a:
                row |= ((1 << (b - a)) - 1) << (columns - b)
        spare = -columns % 8
        out += (row << spare).to_bytes((columns + spare) // 8, "big")
    return bytes(out)


# JBIG2


def jbig2_segments(data: bytes) -> list[dict[str, Any]]:
    """Segments of an embedded stream: number, type, page, and all their bytes."""
    out, at = [], 0
    while at + 11 <= len(data):
        number, flags = struct.unpack_from(">IB", data, at)
        spot = at + 5
        count = data[spot] >> 5
        if count == 7:
            count = struct.unpack_from(">I", data, spot)[0] & 0x1FFFFFFF
            spot += 4 + (count + 8) // 8
        else:
            spot += 1
        spot += count * (1 if number <= 256 else 2 if number <= 65536 else 4)
        wide = 4 if flags & 64 else 1
        page = int.from_bytes(data[spot : spot + wide], "big")
        spot += wide
        size = int.from_bytes(data[spot : spot + 4], "big")
        spot += 4
        end = len(data) if size == 0xFFFFFFFF else min(len(data), spot + size)
        out.append({"number": number, "type": flags & 63, "page": page, "raw": data[at:end]})
        at = end
    return out


def jbig2_file(segments: list[dict[str, Any]]) -> bytes:
    """Segments as a file of one page, which ends if they do not end it."""
    page, last = None, 0
    out = bytearray(b"\x97JB2\r\n\x1a\n\x01" + struct.pack(">I", 1))
    for s in segments:
        out += s["raw"]
        last = s["number"]
        page = None if s["type"] == 49 else s["page"] or page
    # type 49 ends a page, 51 the file
    if page:
        out += struct.pack(">IBBBI", last + 1, 49, 0, page, 0)
    return bytes(out + struct.pack(">IBBBI", last + 2, 51, 0, 0, 0))


# Bitmaps


def bitmap(bits: int, width: int, height: int, data: bytes) -> bytes:
    """A BMP file of 1, 8 or 24 bits a pixel; rows from the bottom, each filled up to four bytes."""
    colors = {1: 2, 8: 256, 24: 0}[bits]
    row = (width * bits + 7) // 8
    line = -(-row // 4) * 4
    start = 54 + 4 * colors
    head = b"BM" + struct.pack("<IHHI", start + line * height, 0, 0, start) + struct.pack("<IiiHHIIIIII", 40, width, height, 1, bits, 0, line * height, 0, 0, colors, 0)
    palette = b"".join(bytes([v, v, v, 0]) for v in ((0, 255) if bits == 1 else range(colors)))
    rows = [data[y * row : (y + 1) * row].ljust(line, b"\0") for y in range(height)]
    return head + palette + b"".join(reversed(rows))


def _colour_space(file: File, attrs: dict[str, Any]) -> list[str]:
    space = file.deep(attrs.get("ColorSpace", attrs.get("CS")), 3)
    return [str(s) for s in (space if isinstance(space, list) else [space]) if isinstance(s, Name)]


def describe(file: File, s: Stream) -> dict[str, Any]:
    """Size in pixels, bits, colour spaces, mask and filters of an image stream; inline names count too."""
    get = lambda long, short: file.get(s.attrs.get(long, s.attrs.get(short)))
    whole = lambda v: v if isinstance(v, int) and not isinstance(v, bool) else None
    mask = get("ImageMask", "IM") is True
    return {
        "pixel_width": whole(get("Width", "W")),
        "pixel_height": whole(get("Height", "H")),
        "bits": whole(get("BitsPerComponent", "BPC")) or 1,
        "colorspace": _colour_space(file, s.attrs),
        "imagemask": mask,
        "filters": [name for name, _ in file.filters(s)],
    }


def _is(name: str, *names: str) -> bool:
    return name.lower() in {n.lower() for n in names}


def export(file: File, s: Stream) -> tuple[str, bytes]:
    """The extension and bytes of the file that an image becomes."""
    about = describe(file, s)
    last = about["filters"][-1] if about["filters"] else ""
    width, height, bits, spaces = about["pixel_width"], about["pixel_height"], about["bits"], about["colorspace"]
    kept = {"jpg": _is(last, "DCTDecode", "DCT"), "jp2": _is(last, "JPXDecode", "JPX"), "jb2": _is(last, "JBIG2Decode")}
    parts = 3 if any(_is(c, "DeviceRGB", "RGB") for c in spaces) else 4 if any(_is(c, "DeviceCMYK", "CMYK") for c in spaces) else 1
    if not any(kept.values()) and (width or 0) > 0 and (height or 0) > 0 and ((width * bits * parts + 7) // 8) * height > MOST_BYTES:
        return "bin", file.raw(s)
    data = file.decode(s)
    if kept["jb2"]:
        params = file.filters(s)[-1][1]
        shared = params.get("JBIG2Globals")
        whole = file.decode(shared).rstrip(b"\n") if isinstance(shared, Stream) else b""
        return "jb2", jbig2_file(jbig2_segments(whole + data))
    for extension, this in kept.items():
        if this:
            return extension, data
    if (width or 0) <= 0 or (height or 0) <= 0:
        return "bin", data
    if bits == 8 and any(_is(c, "DeviceGray", "G") for c in spaces):
        return "bmp", bitmap(8, width, height, data)
    if bits == 8 and any(_is(c, "DeviceRGB", "RGB") for c in spaces):
        return "bmp", bitmap(24, width, height, data)
    return ("bmp", bitmap(1, width, height, data)) if bits == 1 else ("bin", data)


def file_name(page_no: int, name: str, number: int, extension: str) -> str:
    """Names that do not depend on the order in which pages are done."""
    base = re.sub(r"[^A-Za-z0-9]", "_", name) or "image"
    return f"page-{page_no:04d}-{base}_{number}.{extension}"
