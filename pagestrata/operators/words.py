"""Characters to words, lines and texts.

Characters have doc_id, page_no, seq, text, x0, x1, top, bottom, doctop, size,
upright. Windows run in a page, so a page is the most that a task holds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import expand_ligature, is_blank
from . import page_arrays
from .cluster import cluster_1d

PAGE = ["doc_id", "page_no"]
# ASCII punctuation.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


@dataclass(frozen=True)
class TextSettings:
    """How words and lines are formed. Directions: ltr, rtl, ttb, btt; lines and characters must not run in parallel."""

    x_tolerance: float = 3.0
    y_tolerance: float = 3.0
    x_tolerance_ratio: float | None = None
    y_tolerance_ratio: float | None = None
    keep_blank_chars: bool = False
    use_text_flow: bool = False
    line_dir: str = "ttb"
    char_dir: str = "ltr"
    line_dir_rotated: str = "ltr"
    char_dir_rotated: str = "ttb"
    split_at_punctuation: str | bool = False
    expand_ligatures: bool = True
    extra_attrs: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        flat, tall = {"ltr", "rtl"}, {"ttb", "btt"}
        for a, b in ((self.line_dir, self.char_dir), (self.line_dir_rotated, self.char_dir_rotated)):
            if a not in flat | tall or b not in flat | tall:
                raise ValueError(f"no such direction: {a}, {b}")
            if (a in flat) == (b in flat):
                raise ValueError(f"lines and characters run in parallel: {a}, {b}")

    @property
    def punctuation(self) -> str:
        return PUNCTUATION if self.split_at_punctuation is True else self.split_at_punctuation or ""


def line_key(direction: str) -> Column:
    return {"ttb": F.col("top"), "btt": -F.col("bottom"), "ltr": F.col("x0"), "rtl": -F.col("x1")}[direction]


def char_keys(direction: str) -> list[Column]:
    """The order of characters in a line."""
    return {"ltr": [F.col("x0"), F.col("x1")], "rtl": [-F.col("x1"), -F.col("x0")], "ttb": [F.col("top"), F.col("bottom")], "btt": [-F.col("bottom"), -F.col("top")]}[direction]


def _ends(direction: str, row: Column | None = None) -> tuple[Column, Column, Column]:
    """Start and end along the writing direction, and the place across it."""
    c = (lambda n: F.col(n)) if row is None else (lambda n: row[n])
    return {
        "ltr": (c("x0"), c("x1"), c("top")),
        "rtl": (-c("x1"), -c("x0"), c("top")),
        "ttb": (c("top"), c("bottom"), c("x0")),
        "btt": (-c("bottom"), -c("top"), c("x0")),
    }[direction]


def _either(a: Column, b: Column) -> Column:
    """The first for upright characters, the second for turned ones."""
    return F.when(F.col("upright"), a).otherwise(b)


def _numbered(chars: DataFrame, s: TextSettings) -> DataFrame:
    """Characters with ``_at`` (their order in the group) and ``_word``; dropped ones are gone.

    A group has characters of one direction only, so one pass serves both.
    """
    group = [*PAGE, "_group"]
    ways = [(s.line_dir, s.char_dir), (s.line_dir_rotated, s.char_dir_rotated)]
    if s.use_text_flow:
        rows = chars.withColumn("_line", F.lit(0))
        keys: list[Column] = [F.col("seq")]
    else:
        tolerance = _either(*[F.lit(float(s.y_tolerance if line in ("ttb", "btt") else s.x_tolerance)) for line, _ in ways])
        rows = cluster_1d(chars, group, _either(*[line_key(line) for line, _ in ways]), tolerance, "_line")
        pairs = [char_keys(c) for _, c in ways]
        keys = [F.col("_line"), *[_either(x, y) for x, y in zip(*pairs, strict=True)], F.col("seq")]
    order = Window.partitionBy(*group).orderBy(*keys)
    ends = [_ends(c) for _, c in ways]
    start, end, across = (_either(x, y) for x, y in zip(*ends, strict=True))
    before = lambda c: F.lag(c).over(order)

    def reach(char_dir: str, along: bool) -> Column:
        flat = (char_dir in ("ltr", "rtl")) == along
        ratio, plain = (s.x_tolerance_ratio, s.x_tolerance) if flat else (s.y_tolerance_ratio, s.y_tolerance)
        return before(F.col("size")) * ratio if ratio is not None else F.lit(float(plain))

    along, sideways = (_either(*[reach(c, k) for _, c in ways]) for k in (True, False))
    blank = is_blank(F.col("text")) if not s.keep_blank_chars else F.lit(False)
    mark = F.instr(F.lit(s.punctuation), F.col("text")) > 0 if s.punctuation else F.lit(False)
    apart = (start < before(start)) | (start > before(end) + along) | (F.abs(across - before(across)) > sideways)
    rows = rows.withColumn("_blank", blank).withColumn("_mark", mark)
    brk = F.col("_blank") | F.col("_mark") | before(F.col("_blank")) | before(F.col("_mark")) | (F.col("_line") != before(F.col("_line"))) | apart
    rows = rows.withColumn("_brk", F.when(F.coalesce(brk, F.lit(True)), 1).otherwise(0)).withColumn("_at", F.row_number().over(order))
    number = F.sum("_brk").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_word", number).filter(~F.col("_blank")).withColumn("direction", _either(F.lit(s.char_dir), F.lit(s.char_dir_rotated)))


def _grouped(chars: DataFrame, s: TextSettings) -> DataFrame:
    """Runs of equal upright and extra attributes, in content order, are treated apart."""
    order = Window.partitionBy(*PAGE).orderBy("seq")
    change = F.lit(False)
    for c in ("upright", *s.extra_attrs):
        change = change | ~F.col(c).eqNullSafe(F.lag(c).over(order))
    return chars.withColumn("_turn", F.when(change, 1).otherwise(0)).withColumn("_group", F.sum("_turn").over(order)).drop("_turn")


def word_chars(chars: DataFrame, settings: TextSettings | None = None) -> DataFrame:
    """Characters of words, with _group, _word, _at (order in the group) and direction."""
    s = settings or TextSettings()
    return _numbered(_grouped(chars, s), s)


def extract_words(chars: DataFrame | page_arrays.PageChars, settings: TextSettings | None = None) -> DataFrame:
    """doc_id, page_no, word (from 0 in a page), text, box, doctop, upright, direction, extra attributes."""
    s = settings or TextSettings()
    if isinstance(chars, page_arrays.PageChars):
        return page_arrays.extract_words(chars, s)
    text = expand_ligature(F.col("text")) if s.expand_ligatures else F.col("text")
    # windows carry what words are made of, and no more
    sized = ["size"] if s.x_tolerance_ratio is not None or s.y_tolerance_ratio is not None else []
    needed = dict.fromkeys([*PAGE, "seq", "text", "x0", "x1", "top", "bottom", "doctop", "upright", *sized, *s.extra_attrs])
    rows = word_chars(chars.select(*needed), s).withColumn("_t", text)
    first = lambda c: F.min_by(c, "_at")
    words = rows.groupBy(*PAGE, "_group", "_word").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_t"))), lambda c: c["_t"]), "").alias("text"),
        F.min("x0").alias("x0"),
        F.max("x1").alias("x1"),
        F.min("top").alias("top"),
        F.max("bottom").alias("bottom"),
        (first(F.col("doctop") - F.col("top")) + F.min("top")).alias("doctop"),
        first("upright").alias("upright"),
        first("direction").alias("direction"),
        *[first(c).alias(c) for c in s.extra_attrs],
    )
    order = Window.partitionBy(*PAGE).orderBy("_group", "_word")
    return words.withColumn("word", (F.row_number().over(order) - 1).cast("int")).drop("_group", "_word")


def word_lines(words: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """Words with ``line``, their cluster of tops in a page."""
    return cluster_1d(words, PAGE, F.col("top"), tolerance, "line")


def _joined(order: str, text: str, by: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda w: w[text]), by)


def text_lines(chars: DataFrame, settings: TextSettings | None = None) -> DataFrame:
    """doc_id, page_no, line, text (words joined by one space), box of each visual line."""
    s = settings or TextSettings()
    words = word_lines(extract_words(chars, s), s.y_tolerance)
    place = Window.partitionBy(*PAGE, "line").orderBy("x0", "word")
    return (
        words.withColumn("_k", F.row_number().over(place))
        .groupBy(*PAGE, "line")
        .agg(_joined("_k", "text", " ").alias("text"), F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"))
    )


def extract_text(chars: DataFrame | page_arrays.PageChars, settings: TextSettings | None = None) -> DataFrame:
    """doc_id, page_no, text: lines joined by line feeds."""
    if isinstance(chars, page_arrays.PageChars):
        return page_arrays.extract_text(chars, settings or TextSettings())
    return text_lines(chars, settings).groupBy(*PAGE).agg(_joined("line", "text", "\n").alias("text"))


def extract_text_simple(chars: DataFrame, x_tolerance: float = 3.0, y_tolerance: float = 3.0) -> DataFrame:
    """Lines by doctop; a space where a character begins beyond the end before by more than the tolerance."""
    rows = cluster_1d(chars, PAGE, F.col("doctop"), y_tolerance, "line")
    order = Window.partitionBy(*PAGE, "line").orderBy("x0", "seq")
    gap = F.col("x0") > F.lag("x1").over(order) + x_tolerance
    rows = rows.withColumn("_t", F.concat(F.when(gap, " ").otherwise(""), F.col("text"))).withColumn("_k", F.row_number().over(order))
    lines = rows.groupBy(*PAGE, "line").agg(_joined("_k", "_t", "").alias("_text"))
    return lines.groupBy(*PAGE).agg(_joined("line", "_text", "\n").alias("text"))


def layout_text(chars: DataFrame | page_arrays.PageChars, pages: DataFrame, settings: TextSettings | None = None, x_density: float = 7.25, y_density: float = 13.0, bankers: bool = True) -> DataFrame:
    """doc_id, page_no, text that keeps the page's geometry by spaces and empty lines.

    A line begins at max(own row, one below the last) rows, a word at max(own
    column, one beyond the last) columns; lines are padded to the page's width
    in characters, the text to its height. ``bankers``: how halves are rounded.
    """
    s = settings or TextSettings()
    if isinstance(chars, page_arrays.PageChars):
        return page_arrays.layout_text(chars, pages, s, x_density, y_density, bankers)
    near = F.bround if bankers else F.round
    cells = lambda c, d: near(c / d).cast("int")
    words = word_lines(extract_words(chars, s), s.y_tolerance).join(pages.select(*PAGE, F.col("width").alias("_w"), F.col("height").alias("_h")), PAGE)
    spot = F.struct(F.col("x0").alias("x"), "word", cells(F.col("x0"), x_density).alias("col"), F.col("text").alias("t"))
    lines = words.groupBy(*PAGE, "line", "_w", "_h").agg(F.array_sort(F.collect_list(spot)).alias("_words"), F.min("top").alias("_top"))
    wide = cells(F.col("_w"), x_density)
    text = F.aggregate("_words", F.lit(""), lambda a, w: F.concat(a, F.repeat(F.lit(" "), F.greatest(F.least(F.lit(1), F.length(a)), w["col"] - F.length(a))), w["t"]))
    padded = F.rpad(F.col("_text"), F.greatest(wide, F.length("_text")), " ")
    lines = lines.withColumn("_text", text).withColumn("_text", padded).withColumn("_row", cells(F.col("_top"), y_density)).withColumn("_blank", F.repeat(F.lit(" "), wide))
    page = lines.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("line", "_row", "_text"))).alias("_lines"), F.first("_blank").alias("_blank"), F.first(cells(F.col("_h"), y_density)).alias("_rows"))
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        more = F.greatest(F.when(F.size(a["out"]) > 0, 1).otherwise(0), x["_row"] - a["n"])
        fill = F.when(F.size(a["out"]) > 0, more - 1).otherwise(more)
        return F.struct((a["n"] + more).alias("n"), F.concat(a["out"], F.array_repeat(F.col("_blank"), fill), F.array(x["_text"])).alias("out"))

    done = page.withColumn("_end", F.aggregate("_lines", start, step))
    tail = F.array_repeat(F.col("_blank"), F.greatest(F.lit(0), F.col("_rows") - (F.col("_end.n") + 1)))
    return done.select(*PAGE, F.array_join(F.concat(F.col("_end.out"), tail), "\n").alias("text"))


def search_lines(lines: DataFrame, pattern: str, regex: bool = True, case: bool = True) -> DataFrame:
    """doc_id, page_no, line, match (from 0), text, start: matches of a pattern in line texts, blank ones left out."""
    rx = pattern if regex else "\\Q" + pattern + "\\E"
    rx = rx if case else "(?i)" + rx
    found = F.regexp_extract_all("text", F.lit(rx), F.lit(0))
    gaps = F.split("text", rx, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<t:string,s:int>>").alias("out"))
    pairs = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, g: F.struct(m.alias("m"), g.alias("g")))
    walked = F.aggregate(pairs, start, lambda a, p: F.struct((a["at"] + F.length(p["g"]) + F.length(p["m"])).cast("int").alias("at"), F.concat(a["out"], F.array(F.struct(p["m"].alias("t"), (a["at"] + F.length(p["g"])).cast("int").alias("s")))).alias("out")))
    rows = lines.filter(F.col("text").rlike(rx)).select(*PAGE, "line", F.posexplode(walked["out"]).alias("match", "_m"))
    return rows.select(*PAGE, "line", "match", F.col("_m.t").alias("text"), F.col("_m.s").alias("start")).filter(~is_blank(F.col("text")))


def dedupe_chars(chars: DataFrame, tolerance: float = 1.0, extra_attrs: tuple[str, ...] = ("fontname", "size")) -> DataFrame:
    """Of equal characters within the tolerance in doctop and x0 the first by (doctop, x0)."""
    by = [*PAGE, "upright", "text", *extra_attrs]
    rows = cluster_1d(chars, by, F.col("doctop"), tolerance, "_dy")
    rows = cluster_1d(rows, [*by, "_dy"], F.col("x0"), tolerance, "_dx")
    order = Window.partitionBy(*by, "_dy", "_dx").orderBy("doctop", "x0", "seq")
    return rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n", "_dx", "_dy")
