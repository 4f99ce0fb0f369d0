"""Page contents to characters and shapes."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

from . import images, metrics
from .cmaps import CodeMap, parse_cmap, predefined, truetype_texts
from .syntax import PDF_DOC, File, Lexer, Name, Ref, Stream, Word, numbers

Matrix = tuple[float, float, float, float, float, float]
IDENTITY: Matrix = (1, 0, 0, 1, 0, 0)


def times(m: Matrix, n: Matrix) -> Matrix:
    """First m, then n."""
    a, b, c, d, e, f = m
    return (a * n[0] + b * n[2], a * n[1] + b * n[3], c * n[0] + d * n[2], c * n[1] + d * n[3], e * n[0] + f * n[2] + n[4], e * n[1] + f * n[3] + n[5])


def at(m: Matrix, x: float, y: float) -> tuple[float, float]:
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


# The codes of StandardEncoding that differ from ASCII, and those above it; None has no character.
_STANDARD = {39: "’", 96: "‘", **dict(enumerate("¡¢£⁄¥ƒ§¤'“«‹›ﬁﬂ", 161)), **dict(enumerate("–†‡·", 177)), **dict(enumerate("¶•‚„”»…‰", 182)), 191: "¿", **dict(enumerate("`´ˆ˜¯˘˙¨", 193)), 202: "˚", 203: "¸", 205: "˝", 206: "˛", 207: "ˇ", 208: "—", 225: "Æ", 227: "ª", 232: "Ł", 233: "Ø", 234: "Œ", 235: "º", 241: "æ", 245: "ı", 248: "ł", 249: "ø", 250: "œ", 251: "ß"}


@lru_cache(maxsize=None)
def _encoding(name: str) -> dict[int, str]:
    """The characters of codes in one of the four base encodings."""
    if name in ("WinAnsiEncoding", "MacRomanEncoding"):
        codec = {"WinAnsiEncoding": "cp1252", "MacRomanEncoding": "mac_roman"}[name]
        pairs = {c: bytes([c]).decode(codec, "ignore") for c in range(32, 256)}
    elif name == "PDFDocEncoding":
        pairs = {c: PDF_DOC.get(c, chr(c)) for c in range(24, 256)}
    else:
        pairs = {c: chr(c) for c in range(32, 127)} | _STANDARD
    return {c: t for c, t in pairs.items() if t and not unicodedata.category(t).startswith("C")}


def encoding(name: str) -> dict[int, str]:
    """The same, as a dictionary of the caller's own."""
    return dict(_encoding(name if name in ("WinAnsiEncoding", "MacRomanEncoding", "PDFDocEncoding") else ""))


# Glyph names that are not what Unicode calls their characters.
_GLYPHS = {"hyphen": "-", "period": ".", "bullet": "•", "endash": "–", "emdash": "—", "quoteright": "’", "quoteleft": "‘", "quotedblleft": "“", "quotedblright": "”", "quotesingle": "'", "quotedbl": '"', "quotesinglbase": "‚", "quotedblbase": "„", "guillemotleft": "«", "guillemotright": "»", "guilsinglleft": "‹", "guilsinglright": "›", "parenleft": "(", "parenright": ")", "bracketleft": "[", "bracketright": "]", "braceleft": "{", "braceright": "}", "slash": "/", "fraction": "⁄", "plus": "+", "minus": "−", "equal": "=", "less": "<", "greater": ">", "at": "@", "ampersand": "&", "percent": "%", "dollar": "$", "numbersign": "#", "exclam": "!", "exclamdown": "¡", "question": "?", "questiondown": "¿", "asterisk": "*", "backslash": "\\", "bar": "|", "brokenbar": "¦", "underscore": "_", "grave": "`", "acute": "´", "dieresis": "¨", "macron": "¯", "cedilla": "¸", "circumflex": "ˆ", "tilde": "˜", "caron": "ˇ", "breve": "˘", "dotaccent": "˙", "ring": "˚", "ogonek": "˛", "hungarumlaut": "˝", "asciicircum": "^", "asciitilde": "~", "fi": "ﬁ", "fl": "ﬂ", "ff": "ﬀ", "ffi": "ﬃ", "ffl": "ﬄ", "germandbls": "ß", "AE": "Æ", "ae": "æ", "OE": "Œ", "oe": "œ", "Oslash": "Ø", "oslash": "ø", "Lslash": "Ł", "lslash": "ł", "dotlessi": "ı", "Eth": "Ð", "eth": "ð", "Thorn": "Þ", "thorn": "þ", "mu": "µ", "ellipsis": "…", "dagger": "†", "daggerdbl": "‡", "perthousand": "‰", "trademark": "™", "copyright": "©", "registered": "®", "degree": "°", "section": "§", "paragraph": "¶", "periodcentered": "·", "cent": "¢", "sterling": "£", "yen": "¥", "currency": "¤", "florin": "ƒ", "Euro": "€", "ordfeminine": "ª", "ordmasculine": "º", "onesuperior": "¹", "twosuperior": "²", "threesuperior": "³", "onehalf": "½", "onequarter": "¼", "threequarters": "¾", "multiply": "×", "divide": "÷", "plusminus": "±", "logicalnot": "¬", "nbspace": "\u00a0", "sfthyphen": "\u00ad"}
# Accents in glyph names, as Unicode calls them.
_ACCENTS = {"acute": "ACUTE", "grave": "GRAVE", "circumflex": "CIRCUMFLEX", "dieresis": "DIAERESIS", "tilde": "TILDE", "cedilla": "CEDILLA", "ring": "RING ABOVE", "caron": "CARON", "breve": "BREVE", "macron": "MACRON", "ogonek": "OGONEK", "dotaccent": "DOT ABOVE", "hungarumlaut": "DOUBLE ACUTE"}


def glyph_text(name: str) -> str | None:
    """A glyph's text by its name, without what follows a period; of names joined by underscores, all of theirs."""
    parts = [_component(p) for p in name.split(".")[0].split("_")]
    return None if None in parts or not name.split(".")[0] else "".join(parts)  # type: ignore[arg-type]


def _component(base: str) -> str | None:
    """uniXXXX, uXXXXX, single letters, accented letters, and names that Unicode uses too."""
    if m := re.fullmatch(r"uni((?:[0-9A-F]{4})+)|u([0-9A-F]{4,6})", base):
        codes = [int(m[1][i : i + 4], 16) for i in range(0, len(m[1]), 4)] if m[1] else [int(m[2], 16)]
        return None if any(0xD800 <= c < 0xE000 or c > 0x10FFFF for c in codes) else "".join(map(chr, codes))
    if len(base) == 1:
        return base
    if base in _GLYPHS:
        return _GLYPHS[base]
    tries = [base, f"digit {base}", f"{base} sign", f"{base} mark", f"greek {'capital' if base[:1].isupper() else 'small'} letter {base}"]
    if accent := re.fullmatch(rf"([A-Za-z])({'|'.join(_ACCENTS)})", base):
        tries = [f"latin {'capital' if accent[1].isupper() else 'small'} letter {accent[1]} with {_ACCENTS[accent[2]]}"]
    for t in tries:
        try:
            return unicodedata.lookup(t.upper())
        except KeyError:
            pass
    return None


class Font:
    """Codes, widths (of 1) and texts of a font."""

    def __init__(self, file: File, spec: dict[str, Any]):
        get = file.get
        self.kind = str(get(spec.get("Subtype")))
        self.name = str(get(spec.get("BaseFont")) or "unknown")
        self.plain_name = metrics.standard_name(self.name)
        self.two = self.kind == "Type0"
        inner = get((get(spec.get("DescendantFonts")) or [None])[0]) or {} if self.two else spec
        about = get(inner.get("FontDescriptor")) or {}
        self.descent = self._descent(get(about.get("Descent")))
        self.map = self._code_map(file, spec)
        self.known: dict[tuple[int, int], tuple[int, str, bool]] = {}  # glyphs of codes met before
        self.texts: dict[int, str] = {}
        self.same = False
        given = get(spec.get("ToUnicode"))
        if isinstance(given, Stream):
            self.texts = parse_cmap(file.decode(given)).texts
        elif isinstance(given, Name):
            self.same = "Identity" in given
        self.widths: dict[int, float] = {}
        self.encoding: dict[int, str] = {}
        self.vertical = self.two and self.map.vertical
        self.places: dict[int, tuple[float, float]] = {}
        self.place: tuple[float | None, float] = (None, 0.88)
        if self.two:
            self.default = float(get(inner.get("DW")) or 1000) / 1000
            self._cid_widths(file.deep(inner.get("W")) or [])
            if self.vertical:
                self._vertical(file, inner)
            if not self.texts and not self.same:
                self._embedded_texts(file, inner, about)
        else:
            self.default = float(get(about.get("MissingWidth")) or 0) / 1000
            first = get(spec.get("FirstChar")) or 0
            scale = 0.001
            if self.kind == "Type3":
                scale = (numbers(file.deep(spec.get("FontMatrix")), 6) or [0.001])[0]
            self.widths = {first + i: w * scale for i, w in enumerate(file.deep(spec.get("Widths")) or []) if isinstance(w, (int, float))}
            self._encode(file, spec)

    def _descent(self, given: Any) -> float:
        if isinstance(given, (int, float)):
            return -abs(given) / 1000
        return metrics.heights(self.plain_name)[1] if self.plain_name else metrics.PLAIN_DESCENT

    def _code_map(self, file: File, spec: dict[str, Any]) -> CodeMap:
        given = file.get(spec.get("Encoding"))
        if not self.two:
            return CodeMap(spaces=[(1, 0, 255)])
        if isinstance(given, Stream):
            out = parse_cmap(file.decode(given))
            out.vertical = out.vertical or file.get(given.attrs.get("WMode")) == 1
            base = file.get(given.attrs.get("UseCMap"))
            if isinstance(base, Name) and not out.spaces:
                out.spaces = predefined(str(base)).spaces
            return out
        return predefined(str(given or "Identity-H"))

    def _cid_widths(self, w: list[Any]) -> None:
        i = 0
        while i + 1 < len(w):
            if isinstance(w[i + 1], list):
                self.widths |= {w[i] + k: x / 1000 for k, x in enumerate(w[i + 1])}
                i += 2
            elif i + 2 < len(w):
                self.widths |= dict.fromkeys(range(w[i], min(w[i + 1], w[i] + 65535) + 1), w[i + 2] / 1000)
                i += 3
            else:
                return

    def _vertical(self, file: File, inner: dict[str, Any]) -> None:
        """Advances downwards and where a glyph's origin lies, from DW2 and W2."""
        plain = numbers(file.deep(inner.get("DW2")), 2) or [880.0, -1000.0]
        self.default, self.place, self.widths = plain[1] / 1000, (None, plain[0] / 1000), {}
        w, i = file.deep(inner.get("W2")) or [], 0
        while i + 1 < len(w):
            if isinstance(w[i + 1], list):
                triples = [(w[i] + k // 3, w[i + 1][k : k + 3]) for k in range(0, len(w[i + 1]) - 2, 3)]
                i += 2
            elif i + 4 < len(w):
                triples = [(c, w[i + 2 : i + 5]) for c in range(w[i], min(w[i + 1], w[i] + 65535) + 1)]
                i += 5
            else:
                return
            for cid, (advance, x, y) in triples:
                self.widths[cid], self.places[cid] = advance / 1000, (x / 1000, y / 1000)

    def _embedded_texts(self, file: File, inner: dict[str, Any], about: dict[str, Any]) -> None:
        """Texts from an embedded TrueType font, where the characters are its own."""
        info = file.deep(inner.get("CIDSystemInfo"), 2) or {}
        ordering = info.get("Ordering")
        program = file.get(about.get("FontFile2"))
        if ordering not in (b"Identity", b"UCS") or not isinstance(program, Stream):
            return
        by_glyph = truetype_texts(file.decode(program))
        glyphs = file.get(inner.get("CIDToGIDMap"))
        if isinstance(glyphs, Stream):
            data = file.decode(glyphs)
            self.texts = {cid: by_glyph[g] for cid in range(len(data) // 2) if (g := int.from_bytes(data[2 * cid : 2 * cid + 2], "big")) in by_glyph}
        else:
            self.texts = by_glyph

    def _encode(self, file: File, spec: dict[str, Any]) -> None:
        e = file.deep(spec.get("Encoding"))
        base = e.get("BaseEncoding") if isinstance(e, dict) else e
        self.encoding = encoding(str(base or "StandardEncoding"))
        code = 0
        for x in e.get("Differences", []) if isinstance(e, dict) else []:
            if isinstance(x, int):
                code = x
            elif isinstance(x, Name):
                if (t := glyph_text(x)) is not None:
                    self.encoding[code] = t
                code += 1

    def glyphs(self, raw: bytes) -> Iterator[tuple[int, str, bool]]:
        """Character numbers, their texts, and whether each is a space of one byte."""
        if not self.two:
            for code in raw:
                yield code, self.texts.get(code) or (chr(code) if self.same else None) or self.encoding.get(code) or f"(cid:{code})", code == 32
            return
        for code, size in self.map.codes(raw):
            known = self.known.get((code, size))
            if known is not None:
                yield known
                continue
            cid = self.map.cid(code)
            text = self.texts.get(code) or self.texts.get(cid) or (chr(cid) if self.same and 0 < cid < 0xD800 else None) or self.map.text(code, size)
            self.known[code, size] = known = (cid, text or f"(cid:{cid})", size == 1 and code == 32)
            yield known

    def width(self, cid: int) -> float:
        found = self.widths.get(cid)
        if found is None and self.plain_name and cid < 0x110000:
            found = metrics.width(self.plain_name, chr(cid))
        return self.default if found is None else found


STATE = {"ctm": IDENTITY, "width": 1.0, "font": None, "size": 0.0, "tc": 0.0, "tw": 0.0, "th": 1.0, "tl": 0.0, "rise": 0.0, "fill": (0.0,), "stroke": (0.0,), "mode": 0, "dash": ()}


class _Found(Exception):
    """A painted path, while probing."""


class Page:
    """Runs a page's contents; chars, shapes, images and figures are its results, in content order. ``turn`` adds to the page's rotation."""

    probing = False

    def __init__(self, file: File, page: dict[str, Any], turn: int = 0):
        self.file, self.page = file, page
        self.chars: list[dict[str, Any]] = []
        self.shapes: list[dict[str, Any]] = []
        self.images: list[dict[str, Any]] = []
        self.figures: list[dict[str, Any]] = []
        self.seq = 0
        self.inside: list[Any] = []
        box = numbers(file.deep(page.get("MediaBox")), 4) or [0.0, 0.0, 612.0, 792.0]
        self.mediabox = [min(box[0], box[2]), min(box[1], box[3]), max(box[0], box[2]), max(box[1], box[3])]
        self.cropbox = numbers(file.deep(page.get("CropBox")), 4) or self.mediabox
        own = file.get(page.get("Rotate"))
        self.rotate = ((own if isinstance(own, int) else 0) + turn) % 360
        x0, y0, x1, y1 = self.mediabox
        start = {90: (0, -1, 1, 0, -y0, x1), 180: (-1, 0, 0, -1, x1, y1), 270: (0, 1, -1, 0, y1, -x0)}.get(self.rotate, (1, 0, 0, 1, -x0, -y0))
        unit = file.get(page.get("UserUnit"))
        unit = float(unit) if isinstance(unit, (int, float)) and unit > 0 else 1.0
        self.start: Matrix = tuple(v * unit for v in start)  # type: ignore[assignment]
        w, h = x1 - x0, y1 - y0
        self.width, self.height = ((h, w) if self.rotate in (90, 270) else (w, h))
        self.width, self.height = self.width * unit, self.height * unit

    def run(self) -> Page:
        contents = self.file.get(self.page.get("Contents"))
        parts = contents if isinstance(contents, list) else [contents]
        data = b"\n".join(self.file.decode(s) for s in map(self.file.get, parts) if isinstance(s, Stream))
        self._run(data, self.file.get(self.page.get("Resources")) or {}, dict(STATE, ctm=self.start))
        return self

    def has_edges(self) -> bool:
        """Whether the page paints a line, rectangle or curve; reads no further than the first."""
        self.probing = True
        try:
            self.run()
        except _Found:
            return True
        return bool(self.shapes)

    def _run(self, data: bytes, resources: dict[str, Any], state: dict[str, Any]) -> None:
        lex, stack, saved, s = Lexer(data), [], [], state
        path: list[tuple[str, list[tuple[float, float]]]] = []
        marks: list[tuple[str | None, int | None]] = []
        tm = tlm = IDENTITY

        def floats(n: int) -> list[float]:
            got = [float(v) for v in stack if isinstance(v, (int, float)) and not isinstance(v, bool)][-n:]
            return [0.0] * (n - len(got)) + got

        while (x := lex.object()) is not None:
            if not isinstance(x, Word):
                stack.append(x)
                continue
            op = bytes(x)
            if op == b"q":
                saved.append(dict(s))
            elif op == b"Q":
                if saved:
                    s = saved.pop()
            elif op == b"cm":
                s["ctm"] = times(tuple(floats(6)), s["ctm"])  # type: ignore[arg-type]
            elif op == b"w":
                s["width"] = floats(1)[0]
            elif op == b"d":
                s["dash"] = tuple(v for v in next((i for i in stack if isinstance(i, list)), []) if isinstance(v, (int, float)))
            elif op in (b"g", b"rg", b"k", b"sc", b"scn"):
                s["fill"] = tuple(float(v) for v in stack if isinstance(v, (int, float)))
            elif op in (b"G", b"RG", b"K", b"SC", b"SCN"):
                s["stroke"] = tuple(float(v) for v in stack if isinstance(v, (int, float)))
            elif op in (b"m", b"l"):
                path.append((op.decode(), [tuple(floats(2))]))  # type: ignore[list-item]
            elif op in (b"c", b"v", b"y"):
                v = floats(6 if op == b"c" else 4)
                path.append(("c", [tuple(v[i : i + 2]) for i in range(0, len(v), 2)]))  # type: ignore[misc]
            elif op == b"h":
                path.append(("h", []))
            elif op == b"re":
                a, b, w, h = floats(4)
                path += [("m", [(a, b)]), ("l", [(a + w, b)]), ("l", [(a + w, b + h)]), ("l", [(a, b + h)]), ("h", [])]
            elif op in (b"S", b"s", b"f", b"F", b"f*", b"B", b"B*", b"b", b"b*", b"n"):
                if op in (b"s", b"b", b"b*"):
                    path.append(("h", []))
                if op != b"n":
                    self._paint(path, s, op in (b"S", b"s", b"B", b"B*", b"b", b"b*"), op not in (b"S", b"s"), b"*" in op, marks)
                path = []
            elif op == b"BT":
                tm = tlm = IDENTITY
            elif op == b"Tf":
                name = next((v for v in reversed(stack) if isinstance(v, Name)), None)
                s["font"], s["size"] = self._font(resources, name), floats(1)[0]
            elif op in (b"Tc", b"Tw", b"TL", b"Ts"):
                s[{b"Tc": "tc", b"Tw": "tw", b"TL": "tl", b"Ts": "rise"}[op]] = floats(1)[0]
            elif op == b"Tz":
                s["th"] = floats(1)[0] / 100
            elif op == b"Tr":
                s["mode"] = int(floats(1)[0])
            elif op in (b"Td", b"TD"):
                a, b = floats(2)
                if op == b"TD":
                    s["tl"] = -b
                tm = tlm = times((1, 0, 0, 1, a, b), tlm)
            elif op == b"Tm":
                tm = tlm = tuple(floats(6))  # type: ignore[assignment]
            elif op == b"T*":
                tm = tlm = times((1, 0, 0, 1, 0, -s["tl"]), tlm)
            elif op in (b"Tj", b"TJ", b"'", b'"'):
                if op in (b"'", b'"'):
                    if op == b'"':
                        s["tw"], s["tc"] = floats(2)
                    tm = tlm = times((1, 0, 0, 1, 0, -s["tl"]), tlm)
                items = stack[-1] if stack and isinstance(stack[-1], list) else stack[-1:]
                tm = self._show(items, s, tm, marks)
            elif op in (b"BMC", b"BDC"):
                tag = next((str(v) for v in stack if isinstance(v, Name)), None)
                props = stack[-1] if stack else None
                if isinstance(props, Name) and op == b"BDC":
                    props = self.file.get((self.file.get(resources.get("Properties")) or {}).get(props))
                mcid = self.file.get(props.get("MCID")) if isinstance(props, dict) else None
                marks.append((tag, mcid if isinstance(mcid, int) else None))
            elif op == b"EMC":
                if marks:
                    marks.pop()
            elif op == b"Do":
                name = next((v for v in reversed(stack) if isinstance(v, Name)), None)
                ref = (self.file.get(resources.get("XObject")) or {}).get(name) if name else None
                form = self.file.get(ref)
                known = ref.number if isinstance(ref, Ref) else id(form)
                if isinstance(form, Stream) and form.attrs.get("Subtype") == "Form" and known not in self.inside:
                    m = numbers(self.file.deep(form.attrs.get("Matrix")), 6) or IDENTITY
                    ctm = times(tuple(m), s["ctm"])  # type: ignore[arg-type]
                    self._figure(str(name), ctm, numbers(self.file.deep(form.attrs.get("BBox")), 4))
                    self.inside.append(known)
                    self._run(self.file.decode(form), self.file.get(form.attrs.get("Resources")) or resources, dict(s, ctm=ctm))
                    self.inside.pop()
                elif isinstance(form, Stream) and form.attrs.get("Subtype") == "Image":
                    self._image(str(name), form, s, marks)
            elif op == b"ID":
                attrs = {str(k): v for k, v in zip(stack[::2], stack[1::2], strict=False) if isinstance(k, Name)}
                lex.at += 1
                end = re.compile(rb"\sEI(?=[\s]|$)").search(data, lex.at)
                stop = end.start() if end else len(data)
                self._image(f"inline{len(self.images)}", Stream(attrs, data[lex.at : stop]), s, marks)
                lex.at = end.end() if end else len(data)
            stack = []

    @staticmethod
    def _box(m: Matrix, x0: float, y0: float, x1: float, y1: float) -> dict[str, float]:
        """The box around a mapped one: each coordinate is a sum of two parts, which are least and greatest by themselves."""
        p, q, r, s = m[0] * x0, m[0] * x1, m[2] * y0, m[2] * y1
        t, u, v, w = m[1] * x0, m[1] * x1, m[3] * y0, m[3] * y1
        return {"x0": min(p, q) + min(r, s) + m[4], "y0": min(t, u) + min(v, w) + m[5], "x1": max(p, q) + max(r, s) + m[4], "y1": max(t, u) + max(v, w) + m[5]}

    def _figure(self, name: str, m: Matrix, box: list[float] | None) -> None:
        if box:
            self.figures.append({"seq": self.seq, "name": name, "depth": len(self.inside), **self._box(m, *box)})
            self.seq += 1

    def _image(self, name: str, stream: Stream, s: dict[str, Any], marks: list) -> None:
        """An image fills the unit square."""
        tag, mcid = self._mark(marks)
        self.images.append({"seq": self.seq, "name": name, **self._box(s["ctm"], 0, 0, 1, 1), **images.describe(self.file, stream), "mcid": mcid, "tag": tag, "stream": stream})
        self.seq += 1

    def _font(self, resources: dict[str, Any], name: Name | None) -> Font | None:
        spec = self.file.get((self.file.get(resources.get("Font")) or {}).get(name)) if name else None
        if not isinstance(spec, dict):
            return None
        fonts = self.file.fonts  # of all pages
        if id(spec) not in fonts:
            fonts[id(spec)] = spec, Font(self.file, spec)
        return fonts[id(spec)][1]

    @staticmethod
    def _mark(marks: list[tuple[str | None, int | None]]) -> tuple[str | None, int | None]:
        return (marks[-1][0] if marks else None, next((m for _, m in reversed(marks) if m is not None), None))

    def _show(self, items: list[Any], s: dict[str, Any], tm: Matrix, marks: list) -> Matrix:
        """Characters of shown strings; text that is not drawn (modes 3 and 7) gives none."""
        font, size = s["font"], s["size"]
        if s["mode"] in (3, 7):
            return tm
        tag, mcid = self._mark(marks)
        down = font is not None and font.vertical
        ctm, stretch = s["ctm"], s["th"]
        # only the place moves from one character to the next
        turn = times(tm[:4] + (0.0, 0.0), ctm[:4] + (0.0, 0.0))[:4]  # type: ignore[operator]
        upright = turn[0] * turn[3] * stretch > 0 and turn[1] * turn[2] <= 0
        x, y = tm[4], tm[5]
        color = list(s["fill"])
        low = 0.0 if font is None else font.descent * size + s["rise"]
        widths: dict[int, tuple[float, float, float, float, float]] = {}  # advances, and boxes around the origin
        for item in items:
            if isinstance(item, (int, float)) and not isinstance(item, bool):
                by = -item / 1000 * size
                x, y = (x + by * tm[2], y + by * tm[3]) if down else (x + by * stretch * tm[0], y + by * stretch * tm[1])
            elif isinstance(item, bytes) and font is not None:
                for cid, text, spaced in font.glyphs(item):
                    if (spot := widths.get(cid)) is None:
                        advance = font.width(cid) * size * stretch
                        around = self._box((*turn, 0.0, 0.0), 0.0, low, advance, low + size)
                        widths[cid] = spot = (advance, around["x0"], around["y0"], around["x1"], around["y1"])
                    advance = spot[0]
                    m = (*turn, x * ctm[0] + y * ctm[2] + ctm[4], x * ctm[1] + y * ctm[3] + ctm[5])
                    if down:
                        dx, dy = font.places.get(cid, font.place)
                        left, high = -(0.5 * size if dx is None else dx * size), (1 - dy) * size + s["rise"]
                        box = self._box(m, left, high + advance, left + size, high)
                        extent = box["x1"] - box["x0"]
                    else:
                        box = {"x0": spot[1] + m[4], "y0": spot[2] + m[5], "x1": spot[3] + m[4], "y1": spot[4] + m[5]}
                        extent = box["y1"] - box["y0"] if upright else box["x1"] - box["x0"]
                    self.chars.append({"seq": self.seq, "text": text, **box, "size": extent, "upright": upright, "adv": advance, "fontname": font.name, "mcid": mcid, "tag": tag, "matrix": list(m), "color": color})
                    self.seq += 1
                    more = advance + (s["tc"] + (s["tw"] if spaced else 0.0)) * (1 if down else stretch)
                    x, y = (x + more * tm[2], y + more * tm[3]) if down else (x + more * tm[0], y + more * tm[1])
        return (*tm[:4], x, y)

    def _paint(self, path: list, s: dict[str, Any], stroke: bool, fill: bool, evenodd: bool, marks: list) -> None:
        """A shape for each subpath: a line, a rectangle along the axes, or a curve."""
        if self.probing and any(op in "lc" for op, _ in path):
            raise _Found
        parts: list[list] = []
        for op, points in path:
            if op == "m" or not parts:
                parts.append([])
            parts[-1].append((op, [at(s["ctm"], *p) for p in points]))
        tag, mcid = self._mark(marks)
        for part in parts:
            ops = "".join(o for o, _ in part)
            if not ops.startswith("m"):
                continue
            pts = [p[-1] if p else part[0][1][0] for o, p in part]
            if len(ops) > 3 and ops.endswith("lh") and pts[-2] == pts[0]:  # closed twice
                ops, pts = ops[:-2] + "h", pts[:-1]
            if len(pts) < 2:
                continue
            corners = pts[:-1] if len(pts) == 5 and pts[0] == pts[-1] else pts
            square = len(corners) == 4 and ops in ("mlllh", "mllll") and all(a[0] == b[0] or a[1] == b[1] for a, b in zip(corners, corners[1:] + corners[:1], strict=True))
            kind = "line" if ops in ("ml", "mlh") else "rect" if square else "curve"
            xs, ys = [p[0] for p in pts], [p[1] for p in pts]
            self.shapes.append({"seq": self.seq, "object_type": kind, "x0": min(xs), "y0": min(ys), "x1": max(xs), "y1": max(ys), "linewidth": s["width"], "stroke": stroke, "fill": fill, "evenodd": evenodd, "pts": [{"x": a, "y": b} for a, b in pts], "mcid": mcid, "tag": tag, "stroking_color": list(s["stroke"]), "non_stroking_color": list(s["fill"])})
            self.seq += 1
