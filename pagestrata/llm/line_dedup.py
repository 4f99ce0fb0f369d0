"""Removal of repeated runs of lines by winnowing over line hashes, DataFrame functions only.

A window is a shortest run of lines with at least MIN_WORDS words, one that
begins at a line or one that ends at it.

1. Each window selects its line of the least hash, the rightmost of equals. Two
   equal runs of MIN_WORDS words have equal windows, so they have a selected line
   in common: the fingerprints are the selected lines, each once however many
   windows select it.
2. Positions are joined by their line's hash. Most fingerprints stand once in the
   corpus and go here, with their windows.
3. A match of positions is extended both ways by the windows that selected them:
   those that begin at a line reach right, those that end at one reach left. A
   window counts as repeated if its lines (compared by a hash of all of them)
   stand earlier, in whichever text has them first; so a position is extended
   against every earlier text that has its lines without all pairs of a common
   line's positions being formed. Their union is the union of all maximal repeated
   runs: a line of such a run is in the window that begins at it, or else in the
   one that ends where the run does.
4. The lines so covered are deleted; the first occurrence stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, materialize

MIN_WORDS = 20
WORD = r"[^\x20\x09-\x0D]+"


def _key() -> Column:
    """Stands for a row: its doc_id and text. Rows equal in both are one document."""
    return F.xxhash64("doc_id", "text")


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _shortest(words: Column, most: int) -> Column:
    """The number of leading elements that sum up to ``most`` at least, or null."""
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("len"))
    step = lambda a, x: F.when(a["sum"] >= most, a).otherwise(F.struct((a["sum"] + x).alias("sum"), (a["len"] + 1).alias("len")))
    end = F.aggregate(words, start, step)
    return F.when(end["sum"] >= most, end["len"])


def _lines_of(docs: DataFrame) -> DataFrame:
    """key, doc_id, i, h, w: for each different document the places, hashes and word counts of its lines with words."""
    line = F.transform(_lines(F.col("text")), lambda x, i: F.struct(i.alias("i"), F.xxhash64(x).alias("h"), F.regexp_count(x, F.lit(WORD)).alias("w")))
    rows = docs.filter("text is not null").select(_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.filter(line, lambda x: x["w"] > 0).alias("line"))
    once = rows.filter(F.size("line") > 0).groupBy("key").agg(F.first(F.struct("doc_id", "line")).alias("d"))
    return once.select("key", "d.doc_id", F.col("d.line.i").alias("i"), F.col("d.line.h").alias("h"), F.col("d.line.w").alias("w"))


def _selected(min_words: int) -> Column:
    """An array of windows (a, b, at): first and last line and the selected one, counted from 1 among a document's lines with words."""
    h, w, size = F.col("h"), F.col("w"), F.size("h")
    wide = F.lit(1 << 32)

    def ahead(i: Column) -> Column:
        return i * wide + i + _shortest(F.slice(w, i, min_words), min_words) - 1

    def behind(j: Column) -> Column:
        return (j - _shortest(F.reverse(F.slice(w, F.greatest(j - (min_words - 1), F.lit(1)), F.least(j, F.lit(min_words)))), min_words) + 1) * wide + j

    every = F.sequence(F.lit(1).cast("long"), size.cast("long"))
    # as numbers, which a set of windows is made of in one pass
    spans = F.array_distinct(F.array_compact(F.concat(F.transform(every, ahead), F.transform(every, behind))))

    def select(s: Column) -> Column:
        a, b = F.shiftright(s, 32).cast("int"), s.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
        run = F.slice(h, a, b - a + 1)
        return F.struct(a.alias("a"), b.alias("b"), (b + 1 - F.array_position(F.reverse(run), F.array_min(run)).cast("int")).alias("at"))

    return F.transform(spans, select)


def fingerprints(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """fingerprint (a line's hash), key, at: the selected positions of all documents, each once."""
    places = F.array_distinct(F.transform(_selected(min_words), lambda s: s["at"]))
    return lines.select("key", "h", F.explode(places).alias("at")).select(F.element_at("h", F.col("at")).alias("fingerprint"), "key", "at")


def matched_windows(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """key, doc_id, start and stop (line numbers from 0), fingerprint, content (a hash of its lines): windows whose selected line is selected elsewhere too."""
    places = materialize(fingerprints(lines, min_words), "fingerprints")
    shared = places.groupBy("fingerprint").agg(F.count("*").alias("n")).filter("n > 1").select("fingerprint")
    # by document, so that only its own places come back to it
    mine = places.join(shared, "fingerprint", "left_semi").groupBy("key").agg(F.collect_set("at").alias("places"))

    def describe(s: Column) -> Column:
        return F.struct(
            F.element_at("i", s["a"]).alias("start"),
            F.element_at("i", s["b"]).alias("stop"),
            F.element_at("h", s["at"]).alias("fingerprint"),
            F.xxhash64(F.slice("h", s["a"], s["b"] - s["a"] + 1)).alias("content"),
        )

    kept = F.filter(_selected(min_words), lambda s: F.array_contains("places", s["at"]))
    found = lines.join(mine, "key").select("key", "doc_id", F.explode(F.transform(kept, describe)).alias("s"))
    found = materialize(found.select("key", "doc_id", "s.start", "s.stop", "s.fingerprint", "s.content"), "windows")
    forget(places)
    return found


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """key, first, last: for each document the maximal runs of line numbers to delete, none touching another."""
    lines = materialize(_lines_of(docs), "lines")
    windows = matched_windows(lines, min_words)
    forget(lines)
    here = F.struct("doc_id", "key", "start", "stop")
    # a table of its own, so that Spark can split a window that stands very often when it meets its source
    firsts = materialize(windows.groupBy("fingerprint", "content").agg(F.min(here).alias("source"), F.count("*").alias("n")).filter("n > 1").drop("n"), "firsts")
    matched = windows.join(firsts, ["fingerprint", "content"])
    # of overlapping windows of one document the source is not deleted
    later = (F.col("key") != F.col("source.key")) | (F.col("start") > F.col("source.stop"))
    hits = matched.filter(later & (here > F.col("source"))).select("key", "start", "stop")
    order = Window.partitionBy("key").orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = hits.withColumn("new", F.when(F.col("start") <= reach + 1, 0).otherwise(1)).withColumn("island", F.sum("new").over(order))
    runs = materialize(islands.groupBy("key", "island").agg(F.min("start").alias("first"), F.max("stop").alias("last")).drop("island"), "runs")
    forget(windows, firsts)
    return runs


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later repeated runs of lines cut from ``text``; adds n_lines and removed_lines (int).

    "Later" is by doc_id, then a hash of the text, then line number. Runs of at
    least ``min_words`` words in whole lines count; shorter ones stay. A document
    all of whose lines go keeps its row with an empty text; a null text stays
    null with 0 lines, an empty one has one line. Rows equal in doc_id and text
    get the same result, as one document. Null doc_ids come first. A text is
    read whole by one task, at some 100 bytes a line. An empty table gives an
    empty table. Columns named n_lines or removed_lines are replaced, all others
    pass through, whatever their names.
    """
    taken = {"n_lines", "removed_lines"}
    columns = [c for c in docs.columns if c.lower() not in taken]
    runs = repeated_runs(docs, min_words)
    cuts = runs.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("cuts"))
    packed = docs.select(_key().alias("own"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"))
    # cuts grow with the corpus, so the plan is the same at every size: none of them is sent to all
    joined = packed.join(cuts.hint("merge"), F.col("own") == F.col("key"), "left")
    text = F.col("row.text")
    lines = _lines(text)
    n = F.when(text.isNull(), 0).otherwise(F.size(lines))
    # what lies between one cut and the next
    begins = F.concat(F.array(F.lit(0)), F.transform("cuts", lambda c: c["last"] + 1))
    ends = F.concat(F.transform("cuts", lambda c: c["first"]), F.array(n))
    parts = F.zip_with(begins, ends, lambda a, b: F.slice(lines, a + 1, b - a))
    cut = F.array_join(F.flatten(parts), "\n")
    removed = F.aggregate("cuts", F.lit(0), lambda a, c: a + c["last"] - c["first"] + 1)
    after = [(F.when(F.col("cuts").isNull(), text).otherwise(cut) if c == "text" else F.col("row")[c]).alias(c) for c in columns]
    return joined.select(*after, n.cast("int").alias("n_lines"), F.when(F.col("cuts").isNull(), 0).otherwise(removed).cast("int").alias("removed_lines"))
