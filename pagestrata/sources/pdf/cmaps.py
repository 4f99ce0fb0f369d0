"""Codes of composite fonts: code maps in files, predefined ones by rule, and the character tables of TrueType fonts."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

from .syntax import Lexer, Name, Word

# Legacy character sets of predefined maps, by a part of their names, and Python's name for each.
CHARSETS = {"RKSJ": "cp932", "GBK": "gbk", "GB-EUC": "gb2312", "GBpc": "gb2312", "B5": "big5", "ETen": "big5", "HKscs": "big5hkscs", "KSCms": "cp949", "KSC-EUC": "euc_kr", "KSCpc": "euc_kr", "EUC-H": "euc_jp", "EUC-V": "euc_jp"}
MOST_IN_RANGE = 65536


@dataclass
class CodeMap:
    """Code space ranges (bytes, low, high), characters by code, and texts by code."""

    spaces: list[tuple[int, int, int]] = field(default_factory=list)
    cids: dict[int, int] = field(default_factory=dict)
    texts: dict[int, str] = field(default_factory=dict)
    vertical: bool = False
    charset: str | None = None

    def codes(self, raw: bytes) -> Iterator[tuple[int, int]]:
        """(code, bytes): the shortest code whose space holds it, else the bytes of the shortest space."""
        at, sizes = 0, sorted({n for n, _, _ in self.spaces}) or [2]
        while at < len(raw):
            for n in sizes:
                part = raw[at : at + n]
                if len(part) == n and any(n == m and self._within(part, low, high, n) for m, low, high in self.spaces):
                    break
            else:
                n = min(sizes[0], len(raw) - at)
                part = raw[at : at + n]
                if n < sizes[0]:
                    return
            yield int.from_bytes(part, "big"), n
            at += n

    @staticmethod
    def _within(part: bytes, low: int, high: int, n: int) -> bool:
        """Each byte lies between those of the ends."""
        return all(a <= b <= c for a, b, c in zip(low.to_bytes(n, "big"), part, high.to_bytes(n, "big"), strict=True))

    def cid(self, code: int) -> int:
        return self.cids.get(code, code if not self.cids else 0)

    def text(self, code: int, size: int) -> str | None:
        if code in self.texts:
            return self.texts[code]
        if self.charset == "jis":
            return (b"\x1b$B" + code.to_bytes(2, "big")).decode("iso2022_jp", "ignore") or None
        if self.charset:
            try:
                return code.to_bytes(size, "big").decode(self.charset)
            except UnicodeDecodeError:
                return None
        return None


def _utf16(raw: bytes) -> str:
    return raw.decode("utf-16-be", "ignore")


def parse_cmap(data: bytes) -> CodeMap:
    """The code spaces, cid ranges and texts of a map in a file; damaged entries are passed over."""
    out = CodeMap()
    lex, stack = Lexer(data), []
    number = lambda b: int.from_bytes(b, "big")
    while (x := lex.object()) is not None:
        if not isinstance(x, Word):
            stack.append(x)
            continue
        items = [s for s in stack if isinstance(s, (bytes, list, int))]
        if x == b"endcodespacerange":
            out.spaces += [(len(a), number(a), number(b)) for a, b in zip(items[::2], items[1::2], strict=False) if isinstance(a, bytes) and isinstance(b, bytes)]
        elif x == b"endbfchar":
            out.texts |= {number(a): _utf16(b) for a, b in zip(items[::2], items[1::2], strict=False) if isinstance(a, bytes) and isinstance(b, bytes)}
        elif x == b"endcidchar":
            out.cids |= {number(a): b for a, b in zip(items[::2], items[1::2], strict=False) if isinstance(a, bytes) and isinstance(b, int)}
        elif x in (b"endbfrange", b"endcidrange"):
            for a, b, to in zip(items[::3], items[1::3], items[2::3], strict=False):
                if not isinstance(a, bytes) or not isinstance(b, bytes):
                    continue
                low = number(a)
                for k in range(low, min(number(b), low + MOST_IN_RANGE - 1) + 1):
                    if isinstance(to, int):
                        out.cids[k] = to + k - low
                    elif isinstance(to, list):
                        if k - low < len(to) and isinstance(to[k - low], bytes):
                            out.texts[k] = _utf16(to[k - low])
                    elif to:
                        last = number(to[-2:]) + k - low
                        out.texts[k] = _utf16(to[:-2] + (last & 65535).to_bytes(2, "big"))
        elif x == b"def" and len(stack) >= 2 and stack[-2] == "WMode" and isinstance(stack[-2], Name):
            out.vertical = stack[-1] == 1
        if x.startswith(b"begin") or x.startswith(b"end") or x == b"def":
            stack = []
    return out


def predefined(name: str) -> CodeMap:
    """A map by its name: Identity and Unicode ones are two bytes a code, legacy ones follow their character set.

    Texts of legacy and Unicode maps come from the codes themselves, so the
    collections' own numbering is not needed for them.
    """
    out = CodeMap(vertical=name.endswith("-V") or name == "V")
    if name.startswith("Identity"):
        out.spaces = [(2, 0, 0xFFFF)]
    elif name in ("H", "V"):
        out.charset, out.spaces = "jis", [(2, 0x2121, 0x7E7E)]
    elif "UTF16" in name or "UCS2" in name:
        out.charset = "utf-16-be"
        out.spaces = [(2, 0, 0xD7FF), (2, 0xE000, 0xFFFF)] + ([(4, 0xD800DC00, 0xDBFFDFFF)] if "UTF16" in name else [])
    elif "UTF32" in name:
        out.charset, out.spaces = "utf-32-be", [(4, 0, 0x10FFFF)]
    elif found := next((codec for part, codec in CHARSETS.items() if part in name), None):
        out.charset = found
        first = {"cp932": [(0x81, 0x9F), (0xE0, 0xFC)], "euc_jp": [(0x8E, 0x8E), (0xA1, 0xFE)]}.get(found, [(0x81, 0xFE)])
        single = [(0, 0x80)] + ([(0xA0, 0xDF)] if found == "cp932" else [])
        out.spaces = [(1, a, b) for a, b in single] + [(2, a << 8 | 0x40, b << 8 | 0xFE) for a, b in first]
    else:
        out.spaces = [(2, 0, 0xFFFF)]
    return out


# TrueType


def _tables(data: bytes) -> dict[bytes, tuple[int, int]]:
    n = struct.unpack_from(">H", data, 4)[0]
    return {data[12 + 16 * i : 16 + 16 * i]: struct.unpack_from(">II", data, 20 + 16 * i) for i in range(n)}


def _format_4(data: bytes, at: int) -> Iterator[tuple[int, int]]:
    count = struct.unpack_from(">H", data, at + 6)[0] // 2
    field = lambda k: struct.unpack_from(f">{count}H", data, at + 14 + 2 * count * k + (2 if k else 0))
    ends, starts, deltas, offsets = field(0), field(1), field(2), field(3)
    base = at + 16 + 6 * count
    for i in range(count):
        for code in range(starts[i], min(ends[i], 0xFFFE) + 1):
            if not offsets[i]:
                yield code, (code + deltas[i]) & 65535
                continue
            where = base + 2 * i + offsets[i] + 2 * (code - starts[i])
            if where + 2 <= len(data):
                glyph = struct.unpack_from(">H", data, where)[0]
                if glyph:
                    yield code, (glyph + deltas[i]) & 65535


def _format_2(data: bytes, at: int) -> Iterator[tuple[int, int]]:
    keys = struct.unpack_from(">256H", data, at + 6)
    heads = at + 518
    single = next((high for high, key in enumerate(keys) if key == 0), None)
    for high, key in enumerate(keys):
        if key == 0 and high != single:  # codes of one byte share the first table
            continue
        head = heads + key
        first, count, delta, offset = struct.unpack_from(">HHhH", data, head)
        for k in range(count):
            where = head + 6 + offset + 2 * k
            if where + 2 > len(data):
                break
            glyph = struct.unpack_from(">H", data, where)[0]
            if glyph:
                yield (high << 8 | first + k) if key else first + k, (glyph + delta) & 65535


def truetype_texts(data: bytes) -> dict[int, str]:
    """The text of each glyph by the font's Unicode tables (formats 0, 2, 4, 6 and 12); empty if there are none or the font is damaged."""
    out: dict[int, str] = {}
    try:
        start, _ = _tables(data)[b"cmap"]
        for i in range(struct.unpack_from(">H", data, start + 2)[0]):
            platform, encoding, offset = struct.unpack_from(">HHI", data, start + 4 + 8 * i)
            if (platform, encoding) not in ((3, 1), (3, 10)) and platform != 0:
                continue
            at = start + offset
            kind = struct.unpack_from(">H", data, at)[0]
            if kind == 0:
                pairs = list(enumerate(data[at + 6 : at + 262]))
            elif kind == 2:
                pairs = list(_format_2(data, at))
            elif kind == 4:
                pairs = list(_format_4(data, at))
            elif kind == 6:
                first, count = struct.unpack_from(">HH", data, at + 6)
                pairs = list(enumerate(struct.unpack_from(f">{count}H", data, at + 10), first))
            elif kind == 12:
                groups = struct.unpack_from(">I", data, at + 12)[0]
                ranges = [struct.unpack_from(">III", data, at + 16 + 12 * g) for g in range(groups)]
                pairs = [(c, g + c - a) for a, b, g in ranges for c in range(a, min(b, a + MOST_IN_RANGE) + 1)]
            else:
                continue
            for code, glyph in pairs:
                if glyph and not 0xD800 <= code < 0xE000:
                    out.setdefault(glyph, chr(code))
    except (KeyError, IndexError, struct.error, ValueError):
        pass
    return out
