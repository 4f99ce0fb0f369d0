"""One call from files to results: texts, pages, words, tables, exports.

Each verb takes files (doc_id, content), as reader.open_files gives them; the
plan is lazy and every page is a row's work, so the same call serves one file
and a folder of millions. ``Document`` holds the options once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions import bidi
from ..operators import geometry, layout, pages, search, tables, words
from ..sources import sinks
from ..sources.pdf import reader
from ..streaming.files import ordered_rows

FORMATS = ("text", "html", "xml", "hocr", "tag")


def object_columns(df: DataFrame) -> DataFrame:
    return df.drop("matrix", "color", "mcid", "tag", "adv")


def extract_text(files: DataFrame, settings: layout.LayoutSettings | None = None, numbers: Iterable[int] | None = None, password: str = "", reconstruct: bool = False) -> DataFrame:
    """doc_id, text by layout analysis, a form feed behind each page. ``reconstruct``: right-to-left text in logical order."""
    lines = layout.layout_boxes(layout.layout_lines(reader.chars(files, password=password, numbers=numbers), settings), settings)
    text = sinks.document_text(layout.page_text(lines))
    return text.withColumn("text", bidi.reconstructed(F.col("text"))) if reconstruct else text


def extract_pages(files: DataFrame, settings: layout.LayoutSettings | None = None, numbers: Iterable[int] | None = None, password: str = "") -> DataFrame:
    """Lines with their boxes and reading order, by page."""
    return layout.layout_boxes(layout.layout_lines(reader.chars(files, password=password, numbers=numbers), settings), settings)


def extract_pages_with_images(files: DataFrame, settings: layout.LayoutSettings | None = None, password: str = "") -> tuple[DataFrame, DataFrame]:
    """(pages, image files)."""
    return extract_pages(files, settings, password=password), reader.image_files(files, password=password)


def extract_text_to(files: DataFrame, form: str = "text", settings: layout.LayoutSettings | None = None, password: str = "", **options: Any) -> DataFrame:
    """doc_id and a column with the whole document: text, html, xml, hocr (as html) or tag (as xml)."""
    if form not in FORMATS:
        raise ValueError(f"no such format: {form}")
    if form == "text":
        return extract_text(files, settings, password=password)
    if form == "html" and not (settings or layout.LayoutSettings()).detect_vertical:
        sinks.check_mode(options.get("mode", "normal"))
        return reader.whole_html(files, settings or layout.LayoutSettings(), password, **options)
    frames = reader.pages(files, password=password)
    found = reader.chars(files, password=password)
    if form == "tag":
        return sinks.document_tagged(found, frames)
    lines = layout.layout_boxes(layout.layout_lines(found, settings), settings)
    if form == "hocr":
        return sinks.document_hocr(words.extract_words(found), lines, frames)
    placed = layout.line_chars(found, settings)
    if form == "html":
        return sinks.document_html(placed, lines, frames, **options)
    return sinks.document_xml(placed, lines, frames, reader.shapes(files, password=password), reader.images(files, password=password), reader.figures(files, password=password))


def extract_words(files: DataFrame, settings: words.TextSettings | None = None, numbers: Iterable[int] | None = None, password: str = "") -> DataFrame:
    return words.extract_words(reader.chars(files, password=password, numbers=numbers), settings)


def _crop(df: DataFrame, box: tuple[float, float, float, float] | None) -> DataFrame:
    return df if box is None else geometry.crop(df, box)


def find_tables(characters: DataFrame, shapes: DataFrame, settings: tables.TableSettings | None = None, explicit: DataFrame | None = None, crop: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Cells of tables from characters and shapes by the settings' strategies; with a crop, of those that lie in it."""
    s = settings or tables.TableSettings()
    found_words = words.extract_words(characters, s.text) if "text" in (s.vertical_strategy, s.horizontal_strategy) else None
    found = tables.find_tables(geometry.object_edges(shapes), s, found_words, explicit)
    return found if crop is None else tables.retain_tables(found, crop)


def _table_input(files: DataFrame, settings: tables.TableSettings | None, probe: str, password: str, numbers: Iterable[int] | None, crop: tuple[float, float, float, float] | None) -> tuple[DataFrame, DataFrame]:
    shapes = reader.shapes(files, password=password, numbers=numbers)
    characters = reader.chars(files, password=password, numbers=numbers)
    if tables.should_probe(settings or tables.TableSettings(), probe):
        some = reader.edge_pages(files, password).filter("has_edges").select("doc_id", "page_no")
        characters = characters.join(some, ["doc_id", "page_no"], "left_semi")
    return _crop(characters, crop), _crop(shapes, crop)


def extract_tables(files: DataFrame, settings: tables.TableSettings | None = None, numbers: Iterable[int] | None = None, crop: tuple[float, float, float, float] | None = None, probe: str = "never", password: str = "") -> DataFrame:
    """doc_id, page_no, table, rows: texts of all tables. ``probe``: whether pages are first looked at for edges (auto, always, never)."""
    characters, shapes = _table_input(files, settings, probe, password, numbers, crop)
    return tables.extract_tables(find_tables(characters, shapes, settings, crop=crop), characters, (settings or tables.TableSettings()).text)


def extract_table_metadata(files: DataFrame, settings: tables.TableSettings | None = None, numbers: Iterable[int] | None = None, password: str = "") -> DataFrame:
    """A row for each cell: table, box, row and column with their spans, text."""
    characters, shapes = _table_input(files, settings, "never", password, numbers, None)
    found = find_tables(characters, shapes, settings)
    texts = tables.extract_cells(found, characters, (settings or tables.TableSettings()).text)
    return tables.with_spans(found).join(texts, ["doc_id", "page_no", "table", "row_index", "column_index"], "left")


def layout_and_tables(files: DataFrame, settings: layout.LayoutSettings | None = None, table_settings: tables.TableSettings | None = None, password: str = "") -> tuple[DataFrame, DataFrame]:
    """(lines with boxes, table cells with texts) from one parse: its objects are kept on disk until ``unpersist`` of the first's ``objects``."""
    from pyspark import StorageLevel

    both = reader.marks(files, password=password).persist(StorageLevel.DISK_ONLY)
    characters, shapes = reader.marks_of(both, "char"), reader.marks_of(both, "shape")
    lines = layout.layout_boxes(layout.layout_lines(characters, settings), settings)
    found = find_tables(characters, shapes, table_settings)
    cells = tables.extract_cells(found, characters, (table_settings or tables.TableSettings()).text)
    lines.objects = both
    return lines, cells


def tables_from_objects(characters: DataFrame, shapes: DataFrame, settings: tables.TableSettings | None = None) -> DataFrame:
    """Texts of tables in pages that were cropped or filtered before, whatever made them."""
    found = find_tables(characters, shapes, settings)
    return tables.extract_tables(found, characters, (settings or tables.TableSettings()).text)


@dataclass
class Document:
    """Files with one password and page choice, and all verbs on them."""

    files: DataFrame
    password: str = ""
    numbers: tuple[int, ...] | None = None
    _made: dict[str, DataFrame] = field(default_factory=dict)

    @classmethod
    def open(cls, spark: SparkSession, given: Any, password: str = "") -> Document:
        """From a path or folder, bytes, or an object with ``read``."""
        return cls(reader.open_input(spark, given), password)

    def _once(self, name: str, make) -> DataFrame:
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    def page(self, number: int) -> Document:
        return Document(self.files, self.password, (number,))

    def select(self, spec: str) -> Document:
        """Pages by a specification such as 1,3-5."""
        return Document(self.files, self.password, tuple(pages.parse_page_spec(spec)))

    @property
    def metadata(self) -> DataFrame:
        return self._once("metadata", lambda: reader.documents(self.files, self.password))

    @property
    def pages(self) -> DataFrame:
        return self._once("pages", lambda: reader.pages(self.files, password=self.password, numbers=self.numbers))

    @property
    def chars(self) -> DataFrame:
        return self._once("chars", lambda: reader.chars(self.files, password=self.password, numbers=self.numbers))

    @property
    def shapes(self) -> DataFrame:
        return self._once("shapes", lambda: reader.shapes(self.files, password=self.password, numbers=self.numbers))

    @property
    def lines(self) -> DataFrame:
        return self.shapes.filter("object_type = 'line'")

    @property
    def rects(self) -> DataFrame:
        return self.shapes.filter("object_type = 'rect'")

    @property
    def curves(self) -> DataFrame:
        return self.shapes.filter("object_type = 'curve'")

    @property
    def images(self) -> DataFrame:
        return self._once("images", lambda: reader.images(self.files, password=self.password, numbers=self.numbers))

    @property
    def annotations(self) -> DataFrame:
        return reader.annotations(self.files, password=self.password)

    @property
    def hyperlinks(self) -> DataFrame:
        return reader.hyperlinks(self.files, password=self.password)

    @property
    def edges(self) -> DataFrame:
        return geometry.object_edges(self.shapes)

    @property
    def structure(self) -> DataFrame:
        return reader.structure(self.files, password=self.password)

    def text(self, settings: layout.LayoutSettings | None = None, reconstruct: bool = False) -> DataFrame:
        return extract_text(self.files, settings, self.numbers, self.password, reconstruct)

    def page_texts(self, settings: words.TextSettings | None = None) -> DataFrame:
        return words.extract_text(self.chars, settings)

    def words(self, settings: words.TextSettings | None = None) -> DataFrame:
        return words.extract_words(self.chars, settings)

    def search(self, pattern: str, **options: Any) -> DataFrame:
        return search.search(self.chars, pattern, **options)

    def tables(self, settings: tables.TableSettings | None = None) -> DataFrame:
        return tables_from_objects(self.chars, self.shapes, settings)

    def table_rows(self, settings: tables.TableSettings | None = None) -> DataFrame:
        """A row for each row of a table."""
        return self.tables(settings).select("doc_id", "page_no", "table", F.posexplode("rows").alias("row_index", "cells"))

    def summaries(self) -> DataFrame:
        """Pages with the number of objects of each kind."""
        out = self.pages
        for name, rows in (("char_count", self.chars), ("shape_count", self.shapes), ("image_count", self.images)):
            out = out.join(rows.groupBy("doc_id", "page_no").agg(F.count("*").alias(name)), ["doc_id", "page_no"], "left").fillna(0, [name])
        return out

    def to_dict(self) -> DataFrame:
        return sinks.document_dict(self.metadata, self.pages, chars=object_columns(self.chars), shapes=self.shapes.drop("pts"), images=self.images)

    def rows(self, frame: DataFrame) -> Iterator[Row]:
        """A frame's rows in page order."""
        return ordered_rows(frame, "doc_id", "page_no")
