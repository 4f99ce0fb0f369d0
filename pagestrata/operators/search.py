"""Page texts with their characters: a map from text positions to characters, matches with groups, characters and boxes, rendering directions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import expand_ligature
from . import page_arrays
from .words import PAGE, TextSettings, word_chars, word_lines

_MATCH = "array<struct<start:int,stop:int,text:string,groups:array<string>>>"


def _placed_words(chars: DataFrame, s: TextSettings) -> DataFrame:
    """Words with their characters in order and ``start``, where they begin in the page's text."""
    text = expand_ligature(F.col("text")) if s.expand_ligatures else F.col("text")
    spot = F.struct("_at", text.alias("t"), "seq", "x0", "top", "x1", "bottom")
    words = word_chars(chars, s).groupBy(*PAGE, "_group", "_word").agg(F.array_sort(F.collect_list(spot)).alias("chars"), F.min("x0").alias("x0"), F.min("top").alias("top"))
    words = words.withColumn("text", F.array_join(F.transform("chars", lambda c: c["t"]), ""))
    lines = word_lines(words, s.y_tolerance)
    order = Window.partitionBy(*PAGE).orderBy("line", "x0", "_group", "_word")
    before = F.sum(F.length("text") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return lines.withColumn("start", F.coalesce(before, F.lit(0)).cast("int")).withColumn("_behind", F.lag("line").over(order))


def _texts(words: DataFrame) -> DataFrame:
    """doc_id, page_no, text: words of a line joined by a space, lines by a line feed."""
    joint = F.when(F.col("_behind").isNull(), "").when(F.col("_behind") == F.col("line"), " ").otherwise("\n")
    parts = F.array_sort(F.collect_list(F.struct("start", F.concat(joint, "text").alias("t"))))
    return words.groupBy(*PAGE).agg(F.array_join(F.transform(parts, lambda p: p["t"]), "").alias("text"))


def _positions(words: DataFrame) -> DataFrame:
    """A row for each position of the page's text that a character stands for: offset, seq and box; a ligature stands for several."""
    chars = words.select(*PAGE, "start", F.posexplode("chars").alias("_k", "c"), "chars")
    own = F.col("start") + F.aggregate(F.slice("chars", 1, F.col("_k")), F.lit(0), lambda a, c: a + F.length(c["t"]))
    rows = chars.select(*PAGE, own.alias("_from"), "c").filter(F.length("c.t") > 0)
    return rows.select(*PAGE, F.explode(F.sequence(F.col("_from"), F.col("_from") + F.length("c.t") - 1)).alias("offset"), "c.seq", "c.x0", "c.top", "c.x1", "c.bottom", F.col("c.t").alias("char"))


def text_map(chars: DataFrame, settings: TextSettings | None = None) -> tuple[DataFrame, DataFrame]:
    """(texts by page, positions): the pages' texts, and the character behind each of their positions that has one."""
    words = _placed_words(chars, settings or TextSettings())
    return _texts(words), _positions(words)


def search(chars: DataFrame | page_arrays.PageChars, pattern: str | re.Pattern[str], regex: bool = True, case: bool = True, main_group: int = 0, settings: TextSettings | None = None) -> DataFrame:
    """doc_id, page_no, match (from 0), start, stop, text, groups, x0, top, x1, bottom, chars (seq of each) of matches in page texts.

    Patterns are Python's. Matches of nothing but white space are left out. A
    compiled pattern goes with neither regex=False nor case=False.
    """
    if isinstance(pattern, re.Pattern):
        if not regex or not case:
            raise ValueError("a compiled pattern has its own settings")
        source, flags = pattern.pattern, pattern.flags
    else:
        source, flags = (pattern if regex else re.escape(pattern)), (0 if case else re.IGNORECASE)
    re.compile(source, flags)
    if isinstance(chars, page_arrays.PageChars):
        return page_arrays.search(chars, source, flags, main_group, settings or TextSettings())

    @F.pandas_udf(_MATCH)
    def found(texts: pd.Series) -> pd.Series:
        rx = re.compile(source, flags)

        def of(t: str | None) -> list[dict]:
            got = (m for m in rx.finditer(t or "") if (m.group(main_group) or "").strip())
            return [{"start": m.start(main_group), "stop": m.end(main_group), "text": m.group(main_group), "groups": list(m.groups())} for m in got]

        return texts.map(of)

    texts, positions = text_map(chars, settings)
    rows = texts.select(*PAGE, F.posexplode(found("text")).alias("match", "m")).select(*PAGE, "match", "m.*")
    spots = rows.select(*PAGE, "match", F.explode(F.sequence("start", F.col("stop") - 1)).alias("offset"))
    boxes = spots.join(positions, [*PAGE, "offset"]).groupBy(*PAGE, "match").agg(
        F.min("x0").alias("x0"),
        F.min("top").alias("top"),
        F.max("x1").alias("x1"),
        F.max("bottom").alias("bottom"),
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("offset", "seq"))), lambda p: p["seq"])).alias("chars"),
    )
    return rows.join(boxes, [*PAGE, "match"], "left")


def render(text: Column, line_dir: str = "ttb", char_dir: str = "ltr") -> Column:
    """A text whose lines and characters run in other directions: lines reversed, characters reversed, or lines as columns (filled up with spaces)."""
    flat, tall = ("ltr", "rtl"), ("ttb", "btt")
    if line_dir not in flat + tall or char_dir not in flat + tall or (line_dir in flat) == (char_dir in flat):
        raise ValueError(f"no such directions: {line_dir}, {char_dir}")
    lines = F.split(text, "\n", -1)
    if line_dir in ("btt", "rtl"):
        lines = F.reverse(lines)
    if char_dir == "rtl":
        lines = F.transform(lines, lambda x: F.reverse(x))
    if line_dir in flat:
        wide = F.array_max(F.transform(lines, lambda x: F.length(x)))
        fill = lambda x: F.repeat(F.lit(" "), wide - F.length(x))
        even = F.transform(lines, lambda x: F.concat(fill(x), x) if char_dir == "btt" else F.concat(x, fill(x)))
        columns = F.transform(F.sequence(F.lit(1), wide), lambda i: F.array_join(F.transform(even, lambda x: F.substring(x, i, F.lit(1))), ""))
        return F.when(wide > 0, F.array_join(columns, "\n")).otherwise(F.lit(""))
    return F.array_join(lines, "\n")
