"""Widths of the standard fonts, which files may use without giving them."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

# Widths of the characters from space to tilde, in thousandths of the size (Adobe Core 14 AFM).
_PRINTABLE = {
    "Helvetica": "278 278 355 556 556 889 667 191 333 333 389 584 278 333 278 278 556 556 556 556 556 556 556 556 556 556 278 278 584 584 584 556 1015 667 667 722 722 667 611 778 722 278 500 667 556 833 722 778 667 778 722 667 611 722 667 944 667 667 611 278 278 278 469 556 333 556 556 500 556 556 278 556 556 222 222 500 222 833 556 556 556 556 333 500 278 556 500 722 500 500 500 334 260 334 584",
    "Helvetica-Bold": "278 333 474 556 556 889 722 238 333 333 389 584 278 333 278 278 556 556 556 556 556 556 556 556 556 556 333 333 584 584 584 611 975 722 722 722 722 667 611 778 722 278 556 722 611 833 722 778 667 778 722 667 611 722 667 944 667 667 611 333 278 333 584 556 333 556 611 556 611 556 333 611 611 278 278 556 278 889 611 611 611 611 389 556 333 611 556 778 556 556 500 389 280 389 584",
    "Times-Roman": "250 333 408 500 500 833 778 180 333 333 500 564 250 333 250 278 500 500 500 500 500 500 500 500 500 500 278 278 564 564 564 444 921 722 667 667 722 611 556 722 722 333 389 722 611 889 722 722 556 722 667 556 611 722 722 944 722 722 611 333 278 333 469 500 333 444 500 444 500 444 333 500 500 278 278 500 278 778 500 500 500 500 333 389 278 500 500 722 500 500 444 480 200 480 541",
    "Times-Bold": "250 333 555 500 500 1000 833 278 333 333 500 570 250 333 250 278 500 500 500 500 500 500 500 500 500 500 333 333 570 570 570 500 930 722 667 722 722 667 611 778 778 389 500 778 667 944 722 778 611 778 722 556 667 722 722 1000 722 722 667 333 278 333 581 500 333 500 556 444 556 444 333 500 556 278 333 556 278 833 556 500 556 556 444 389 333 556 500 722 500 500 444 394 220 394 520",
    "Times-Italic": "250 333 420 500 500 833 778 214 333 333 500 675 250 333 250 278 500 500 500 500 500 500 500 500 500 500 333 333 675 675 675 500 920 611 611 667 722 611 611 722 722 333 444 667 556 833 667 722 611 722 611 500 556 722 611 833 611 556 556 389 278 389 422 500 333 500 500 444 500 444 278 500 500 278 278 444 278 722 500 500 500 500 389 389 278 500 444 667 444 444 389 400 275 400 541",
    "Times-BoldItalic": "250 389 555 500 500 833 778 278 333 333 500 570 250 333 250 278 500 500 500 500 500 500 500 500 500 500 333 333 570 570 570 500 832 667 667 667 722 667 667 722 778 389 500 667 611 889 722 722 611 722 667 556 611 722 667 889 667 611 611 333 278 333 570 500 333 500 500 444 500 444 333 500 556 278 278 500 278 778 556 500 500 500 389 389 278 556 444 667 500 444 389 348 220 348 570",
}
# Widths of further characters, in this order.
_FURTHER = "–—•‘’“”…ﬁﬂßÆæŒœØø°©§¶"
_FURTHER_WIDTHS = {
    "Helvetica": "556 1000 350 222 222 333 333 1000 500 500 611 1000 889 1000 944 778 611 400 737 556 537",
    "Helvetica-Bold": "556 1000 350 278 278 500 500 1000 611 611 611 1000 889 1000 944 778 611 400 737 556 556",
    "Times-Roman": "500 1000 350 333 333 444 444 1000 556 556 500 889 667 889 722 722 500 400 760 500 453",
    "Times-Bold": "500 1000 350 333 333 500 500 1000 556 556 556 1000 722 1000 722 778 500 400 747 500 540",
    "Times-Italic": "500 889 350 333 333 556 556 889 500 500 500 889 667 944 667 722 500 400 760 500 523",
    "Times-BoldItalic": "500 1000 350 333 333 500 500 1000 556 556 500 944 722 944 722 722 500 400 747 500 500",
}
# Ascent and descent of the families.
_HEIGHTS = {"Courier": (627, -194), "Helvetica": (718, -207), "Times": (683, -217)}
#: Without a descriptor, a font reaches a quarter of its size below the base line.
PLAIN_DESCENT = -0.25
_ACCENTED_I = 278


def standard_name(name: str) -> str | None:
    """The standard font that a name means (also Arial, CourierNew and TimesNewRoman with a style), or None."""
    family, _, style = name.partition("-" if "-" in name else ",")
    other = {"Arial": "Helvetica", "CourierNew": "Courier", "TimesNewRoman": "Times"}
    if family not in ("Helvetica", "Courier", "Times", *other) or (family in other) != ("-" not in name and family in other):
        return None
    bold, slanted = "Bold" in style, "Italic" in style or "Oblique" in style
    if style not in ("", "Roman") and not (bold or slanted):
        return None
    family = other.get(family, family)
    if family == "Times":
        return {(False, False): "Times-Roman", (True, False): "Times-Bold", (False, True): "Times-Italic", (True, True): "Times-BoldItalic"}[bold, slanted]
    # slanted ones are as wide as upright ones
    return "Courier" if family == "Courier" else "Helvetica-Bold" if bold else "Helvetica"


@lru_cache(maxsize=16)
def _table(name: str) -> dict[str, int]:
    out = {chr(32 + i): int(w) for i, w in enumerate(_PRINTABLE[name].split())}
    return out | {c: int(w) for c, w in zip(_FURTHER, _FURTHER_WIDTHS[name].split(), strict=True)}


def width(name: str, char: str) -> float | None:
    """A character's width of 1, by its base letter if it has an accent; None if the font or character is not standard."""
    if name == "Courier":
        return 0.6
    if name not in _PRINTABLE or len(char) != 1:
        return None
    table = _table(name)
    if char not in table:
        base = unicodedata.normalize("NFD", char)[0]
        if base == char:
            return None
        if base == "i":
            return _ACCENTED_I / 1000
        char = base
    return table[char] / 1000 if char in table else None


def heights(name: str) -> tuple[float, float]:
    """Ascent and descent of a standard font, of 1."""
    up, down = _HEIGHTS[name.partition("-")[0]]
    return up / 1000, down / 1000
