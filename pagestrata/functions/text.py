"""Scalar functions of texts, numbers and dates as columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The ligatures of Unicode's Latin presentation forms.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
# Ranges of right-to-left scripts.
RTL = "֐-ࣿיִ-﷿ﹰ-﻿"


def expand_ligature(char: Column) -> Column:
    """A character that is a ligature as its letters; anything else stays."""
    table = F.create_map(*[F.lit(x) for pair in LIGATURES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, char), char)


# Code points that Unicode calls white space.
BLANKS = [chr(c) for c in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def is_blank(text: Column) -> Column:
    """Whether a text has nothing but white space. A single character, the common case, is looked up in a set."""
    return F.when(F.length(text) == 1, text.isin(*BLANKS)).otherwise(F.length(F.translate(text, "".join(BLANKS), "")) == 0)


def contains_rtl(text: Column) -> Column:
    return text.rlike(f"[{RTL}]")


def is_arabic(char: Column) -> Column:
    return char.rlike("[؀-ۿݐ-ݿࢠ-ࣿﭐ-﷿ﹰ-﻿]")


def normalize(form: str):
    """A vectorised function that gives a text's normal form (NFC, NFKC, NFD, NFKD); Spark has none built in."""

    @F.pandas_udf("string")
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else unicodedata.normalize(form, t))

    return run


def roman(n: Column) -> Column:
    """Lower-case roman numerals of 1 to 3999, else null."""
    places = []
    for unit, (one, five, ten) in ((1000, ("m", "", "")), (100, ("c", "d", "m")), (10, ("x", "l", "c")), (1, ("i", "v", "x"))):
        digits = ["", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten]
        places.append(F.element_at(F.array(*[F.lit(d) for d in digits]), (F.pmod(F.floor(n / unit), F.lit(10)) + 1).cast("int")))
    return F.when((n > 0) & (n < 4000), F.concat(*places))


def letters(n: Column) -> Column:
    """a to z, aa to zz, aaa and so on by bijective base 26; null below 1."""
    start = F.struct(n.cast("long").alias("n"), F.lit("").alias("s"))

    def step(acc: Column, _: Column) -> Column:
        here = F.struct(F.floor((acc["n"] - 1) / 26).cast("long").alias("n"), F.concat(F.char(F.lit(97) + F.pmod(acc["n"] - 1, F.lit(26))), acc["s"]).alias("s"))
        return F.when(acc["n"] > 0, here).otherwise(acc)

    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, step)["s"])


def page_label(style: Column, prefix: Column, number: Column) -> Column:
    """A page label in style D, R, r, A, a, or the prefix alone."""
    shown = F.when(style == "D", number.cast("string")).when(style == "R", F.upper(roman(number))).when(style == "r", roman(number)).when(style == "A", F.upper(letters(number))).when(style == "a", letters(number)).otherwise("")
    return F.concat(F.coalesce(prefix, F.lit("")), F.coalesce(shown, F.lit("")))


def shorten(text: Column, size: int) -> Column:
    """At most ``size`` characters, the middle left out by ' ... '."""
    if size < 7:
        return F.substring(text, 1, size)
    n = (size - 5) // 2
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, n), F.lit(" ... "), F.substring(text, F.length(text) - n + 1, F.lit(n)))).otherwise(text)


def box_text(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.format_string("%.3f,%.3f,%.3f,%.3f", x0, y0, x1, y1)


def matrix_text(m: Column) -> Column:
    return F.format_string("[%.2f,%.2f,%.2f,%.2f, (%.2f,%.2f)]", *[m[c] for c in "abcdef"])


def escape_html(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for a, b in ((">", "&gt;"), ("<", "&lt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def escape_csv(text: Column) -> Column:
    """Quoted only where it has a comma, quote or line end."""
    text = F.coalesce(text, F.lit(""))
    return F.when(text.rlike('[,"\\r\\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def big_endian(data: Column) -> Column:
    """Up to seven bytes as an unsigned number; 0 for none."""
    return F.coalesce(F.conv(F.hex(data), 16, 10).cast("long"), F.lit(0).cast("long"))


def date_to_iso(text: Column) -> Column:
    """D:YYYYMMDDHHmmSS with Z or +HH'mm' as ISO 8601, as far as its parts are given; null without a year."""
    p = r"^(?:D:)?(\d{4})(?:(\d{2})(?:(\d{2})(?:(\d{2})(?:(\d{2})(\d{2})?)?)?)?)?(.*)$"
    part = lambda k: F.regexp_extract(text, p, k)
    more = [F.when(part(k) != "", F.concat(F.lit(mark), part(k))).otherwise("") for k, mark in ((2, "-"), (3, "-"), (4, "T"), (5, ":"), (6, ":"))]
    sign, digits = F.substring(part(7), 1, 1), F.regexp_replace(part(7), r"\D", "")
    offset = F.concat(sign, F.substring(digits, 1, 2), F.lit(":"), F.when(F.length(digits) >= 4, F.substring(digits, 3, 2)).otherwise("00"))
    zone = F.when(sign == "Z", "Z").when(sign.isin("+", "-") & (F.length(digits) >= 2), offset).otherwise("")
    return F.when(text.rlike(r"^(?:D:)?\d{4}"), F.concat(part(1), *more, zone))


def points_text(points: Column) -> Column:
    return F.array_join(F.transform(points, lambda p: F.format_string("%.3f,%.3f", p["x"], p["y"])), ",")


def safe_number(text: Column, kind: str = "double") -> Column:
    return text.try_cast(kind)


def is_number(text: Column) -> Column:
    """Whether a text is a number as files write them: digits with a sign and a period."""
    return text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$")


def nearly(a: Column, b: Column, tolerance: float = 1e-9) -> Column:
    return F.abs(a - b) <= tolerance


def upper_bound(values: Column, x: Column) -> Column:
    """How many of a sorted array's values are no greater than ``x``: where it would be inserted behind equals."""
    return F.size(F.filter(values, lambda v: v <= x))


def fixed_fontname(raw: Column) -> Column:
    """A font's name from its bytes: a subset's prefix goes, names in the CP936 character set are read as such."""
    known = F.when(F.is_valid_utf8(raw), F.decode(raw, "UTF-8")).otherwise(F.decode(raw, "GBK"))
    return F.regexp_replace(known, "^[A-Z]{6}[+]", "")


def whole_number(text: Column) -> Column:
    """A whole number, cut off behind the period; null if it is none."""
    return text.try_cast("double").cast("long")


def numbers_of(values: Column, size: int) -> Column:
    """An array of so many finite numbers, else null (matrices of 6, boxes and CMYK of 4, RGB of 3)."""
    cast = F.transform(values, lambda v: v.try_cast("double"))
    good = (F.size(cast) == size) & ~F.exists(cast, lambda v: v.isNull() | F.isnan(v))
    return F.when(good, cast)


def chunks(values: Column, size: int) -> Column:
    """An array cut into arrays of ``size``, the last one shorter."""
    starts = F.when(F.size(values) > 0, F.sequence(F.lit(1), F.size(values), F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(values, i, F.lit(size)))


def compatible_text(value: Column) -> Column:
    """Bytes as text: UTF-8 if they are, else one character a byte."""
    return F.when(F.is_valid_utf8(value), F.decode(value, "UTF-8")).otherwise(F.decode(value, "ISO-8859-1"))
