"""Files of pages as DataFrames: documents, pages, characters, shapes, images, figures and what a file says of itself.

Files are read by Spark's binaryFile source, so any store that Spark reaches
will do; each file is parsed where its bytes are, and its pages are given out
one by one. A file or page that cannot be parsed gives a row of ``errors`` (a
file also an ``error`` in ``documents``), the other pages stay; ``strict``
raises instead.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from . import catalog
from .content import Page
from .images import export, file_name
from .syntax import File, Name, text_of

_BOX = "x0 double, y0 double, x1 double, y1 double"
_PLACED = f"{_BOX}, top double, bottom double, doctop double"
CHARS = f"doc_id string, page_no int, seq long, text string, {_PLACED}, size double, upright boolean, adv double, fontname string, mcid int, tag string, matrix array<double>, color array<double>"
SHAPES = f"doc_id string, page_no int, seq long, object_type string, {_PLACED}, linewidth double, stroke boolean, fill boolean, evenodd boolean, pts array<struct<x:double,y:double>>, mcid int, tag string, stroking_color array<double>, non_stroking_color array<double>"
MARKS = f"{CHARS}, mark string, object_type string, linewidth double, stroke boolean, fill boolean, evenodd boolean, pts array<struct<x:double,y:double>>, stroking_color array<double>, non_stroking_color array<double>"
IMAGES = f"doc_id string, page_no int, seq long, name string, {_PLACED}, pixel_width int, pixel_height int, bits int, colorspace array<string>, imagemask boolean, filters array<string>, mcid int, tag string"
FIGURES = f"doc_id string, page_no int, seq long, name string, depth int, {_PLACED}"
PAGES = "doc_id string, page_no int, rotate int, width double, height double, initial_doctop double, mediabox array<double>, cropbox array<double>"
DOCUMENTS = "doc_id string, bytes long, page_count int, declared_pages int, version string, catalog_version string, encrypted boolean, info map<string,string>, xmp string, form_type string, has_javascript boolean, linearized boolean, tagged boolean, printable boolean, modifiable boolean, extractable boolean, fallback_xref boolean, error string"
OUTLINE = "doc_id string, position int, level int, title string, dest string, page_no int, action string, uri string"
ANNOTATIONS = f"doc_id string, page_no int, position int, subtype string, {_PLACED}, uri string, title string, contents string"
STRUCTURE = "doc_id string, id int, parent int, depth int, type string, page_no int, element_id string, lang string, title string, alt_text string, actual_text string, attributes map<string,string>, mcids array<struct<page_no:int,mcid:int>>"
#: Rows that a parser holds before it gives them out.
BATCH_ROWS = 20_000

Row = dict[str, Any]


def check_path(path: str) -> str:
    """A path or address that names something; raises for blanks and NUL bytes."""
    if not path.strip() or "\0" in path:
        raise ValueError("a path is blank or has a NUL byte")
    return path


def open_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """doc_id (the path) and content."""
    got = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(check_path(path))
    return got.select(F.col("path").alias("doc_id"), "content")


def from_bytes(df: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    return df.select(F.col(key).cast("string").alias("doc_id"), F.col(content).alias("content"))


def open_input(spark: SparkSession, given: Any, name: str = "input") -> DataFrame:
    """A path, bytes, or an object with ``read``, as files."""
    if isinstance(given, str):
        return open_files(spark, given)
    data = given.read() if hasattr(given, "read") else given
    if not isinstance(data, (bytes, bytearray, memoryview)):
        raise TypeError(f"neither a path nor bytes: {type(data).__name__}")
    return spark.createDataFrame([(name, bytearray(data))], "doc_id string, content binary")


def _table(files: DataFrame, schema: str, rows: Callable[[bytes], Iterable[Row]], strict: bool, at_once: int | None = None) -> DataFrame:
    """Rows of each file, BATCH_ROWS or ``at_once`` held; those of a file that fails are given out as far as they came."""
    kind: StructType = DataType.fromDDL(schema)  # type: ignore[assignment]

    def parse(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(kind)
        for batch in batches:
            out: list[Row] = []
            for doc_id, content in zip(batch["doc_id"], batch["content"], strict=True):
                key = doc_id.as_py()
                try:
                    for r in rows(content.as_py() or b""):
                        r["doc_id"] = key
                        out.append(r)
                        if len(out) >= (at_once or BATCH_ROWS):
                            yield pa.RecordBatch.from_pylist(out, schema=arrow)
                            out = []
                except Exception as e:
                    if strict:
                        raise ValueError(f"{key}: {e}") from e
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return files.select("doc_id", "content").mapInArrow(parse, schema)


def _pages_of(content: bytes, password: str, numbers: frozenset[int] | None = None, turn: int = 0) -> Iterator[tuple[int, Page | Exception, float]]:
    """Number, page (or why it cannot be had) and the heights before it, of the wanted pages."""
    file, start = File(content, password), 0.0
    for n, d in enumerate(file.pages(), 1):
        try:
            page: Page | Exception = Page(file, d, turn)
        except Exception as e:
            page = e
        if numbers is None or n in numbers:
            yield n, page, start
        start += page.height if isinstance(page, Page) else 0.0


def _placed(r: Row, page: Page, start: float) -> Row:
    """The row, which is the caller's own, with its place from the top."""
    r["top"] = top = page.height - r["y1"]
    r["bottom"], r["doctop"] = page.height - r["y0"], start + top
    return r


def _objects(files: DataFrame, schema: str, give: Callable[[Page], list[Row]], strict: bool, password: str, numbers: Iterable[int] | None, turn: int) -> DataFrame:
    wanted = None if numbers is None else frozenset(numbers)

    def rows(content: bytes) -> Iterator[Row]:
        for n, page, start in _pages_of(content, password, wanted, turn):
            try:
                if isinstance(page, Exception):
                    raise page
                found = give(page.run())
                for r in found:
                    r["page_no"] = n
                    _placed(r, page, start)
            except Exception as e:
                if strict:
                    raise ValueError(f"page {n}: {e}") from e
                continue
            yield from found

    return _table(files, schema, rows, strict)


def documents(files: DataFrame, password: str = "") -> DataFrame:
    """One row a file: pages by the tree and as declared, metadata, permissions, and the error of one that cannot be read."""

    def rows(content: bytes) -> list[Row]:
        try:
            file = File(content, password)
            return [{"bytes": len(content), "page_count": len(file.page_objects()), **catalog.metadata(file, content), "error": None}]
        except Exception as e:
            return [{"bytes": len(content), "info": {}, "error": str(e) or type(e).__name__}]

    return _table(files, DOCUMENTS, rows, True)


def errors(files: DataFrame, password: str = "") -> DataFrame:
    """doc_id, page_no (null for a whole file), error."""

    def rows(content: bytes) -> Iterator[Row]:
        try:
            for n, page, _ in _pages_of(content, password):
                try:
                    if isinstance(page, Exception):
                        raise page
                    page.run()
                except Exception as e:
                    yield {"page_no": n, "error": f"{type(e).__name__}: {e}"}
        except Exception as e:
            yield {"page_no": None, "error": f"{type(e).__name__}: {e}"}

    return _table(files, "doc_id string, page_no int, error string", rows, True)


def pages(files: DataFrame, strict: bool = False, password: str = "", numbers: Iterable[int] | None = None, turn: int = 0) -> DataFrame:
    """Pages; ``turn`` (a multiple of 90) adds to their rotation."""
    wanted = None if numbers is None else frozenset(numbers)

    def rows(content: bytes) -> Iterator[Row]:
        for n, p, start in _pages_of(content, password, wanted, turn):
            if isinstance(p, Page):
                yield {"page_no": n, "rotate": p.rotate, "width": p.width, "height": p.height, "initial_doctop": start, "mediabox": p.mediabox, "cropbox": p.cropbox}
            elif strict:
                raise p

    return _table(files, PAGES, rows, strict)


def chars(files: DataFrame, strict: bool = False, password: str = "", numbers: Iterable[int] | None = None, turn: int = 0, columns: Iterable[str] | None = None) -> DataFrame:
    """Characters with both coordinate systems and doctop. ``columns``: those wanted, as the others (matrices, colours) cost more than all else."""
    schema = CHARS
    if columns is not None:
        kinds = dict(c.split(" ", 1) for c in CHARS.split(", "))
        schema = ", ".join(f"{c} {kinds[c]}" for c in columns)
    return _objects(files, schema, lambda p: p.chars, strict, password, numbers, turn)


def shapes(files: DataFrame, strict: bool = False, password: str = "", numbers: Iterable[int] | None = None, turn: int = 0) -> DataFrame:
    """Lines, rectangles and curves, with top, bottom and points from the top."""

    def give(p: Page) -> list[Row]:
        return [{**r, "pts": [{"x": q["x"], "y": p.height - q["y"]} for q in r["pts"]]} for r in p.shapes]

    return _objects(files, SHAPES, give, strict, password, numbers, turn)


def marks(files: DataFrame, strict: bool = False, password: str = "", numbers: Iterable[int] | None = None) -> DataFrame:
    """Characters and shapes of one parse, told apart by ``mark`` (char or shape); columns of the other kind are null."""
    schema = MARKS

    def give(p: Page) -> list[Row]:
        flipped = [{**r, "pts": [{"x": q["x"], "y": p.height - q["y"]} for q in r["pts"]]} for r in p.shapes]
        return [{"mark": "char", **r} for r in p.chars] + [{"mark": "shape", **r} for r in flipped]

    return _objects(files, schema, give, strict, password, numbers, 0)


def marks_of(both: DataFrame, mark: str) -> DataFrame:
    """Of ``marks`` the characters or the shapes, with their own columns."""
    names = [c.split()[0] for c in (CHARS if mark == "char" else SHAPES).split(", ")]
    return both.filter(F.col("mark") == mark).select(*names)


def images(files: DataFrame, strict: bool = False, password: str = "", numbers: Iterable[int] | None = None) -> DataFrame:
    """Images and inline images with their boxes and formats."""
    return _objects(files, IMAGES, lambda p: [{k: v for k, v in r.items() if k != "stream"} for r in p.images], strict, password, numbers, 0)


def figures(files: DataFrame, strict: bool = False, password: str = "", numbers: Iterable[int] | None = None, counts: bool = False) -> DataFrame:
    """Forms that pages draw, with their boxes; depth counts forms around them. ``counts``: with the numbers of their page's characters, shapes and images, of the same parse."""

    def counted(p: Page) -> list[Row]:
        n = {"page_chars": len(p.chars), "page_shapes": len(p.shapes), "page_images": len(p.images)}
        return [{**r, **n} for r in p.figures]

    if counts:
        return _objects(files, f"{FIGURES}, page_chars int, page_shapes int, page_images int", counted, strict, password, numbers, 0)
    return _objects(files, FIGURES, lambda p: p.figures, strict, password, numbers, 0)


def whole_html(files: DataFrame, settings: Any, password: str = "", **options: Any) -> DataFrame:
    """doc_id, html: each file's ``sinks.document_html`` from one parse; a page whose contents fail is empty."""
    from ..sinks import html_of_pages

    def rows(content: bytes) -> Iterator[Row]:
        def pages_of() -> Iterator[tuple[int, float, float, list[Row]]]:
            for n, page, _ in _pages_of(content, password):
                if isinstance(page, Page):
                    try:
                        chars = page.run().chars
                    except Exception:
                        chars = []
                    yield n, page.width, page.height, chars

        html = html_of_pages(pages_of(), settings, **options)
        if html is not None:
            yield {"html": html}

    return _table(files, "doc_id string, html string", rows, False, 100)


def image_files(files: DataFrame, strict: bool = False, password: str = "") -> DataFrame:
    """doc_id, page_no, seq, name (of the file, page-0001-...), extension, data: images as files."""

    def rows(content: bytes) -> Iterator[Row]:
        for n, page, _ in _pages_of(content, password):
            if isinstance(page, Exception):
                continue
            for k, r in enumerate(page.run().images, 1):
                try:
                    extension, data = export(page.file, r["stream"])
                except Exception:
                    if strict:
                        raise
                    continue
                yield {"page_no": n, "seq": r["seq"], "name": file_name(n, r["name"], k, extension), "extension": extension, "data": data}

    return _table(files, "doc_id string, page_no int, seq long, name string, extension string, data binary", rows, strict)


def edge_pages(files: DataFrame, password: str = "") -> DataFrame:
    """doc_id, page_no, has_edges: pages that paint a path, read no further than the first one."""

    def rows(content: bytes) -> Iterator[Row]:
        for n, page, _ in _pages_of(content, password):
            if isinstance(page, Page):
                yield {"page_no": n, "has_edges": page.has_edges()}

    return _table(files, "doc_id string, page_no int, has_edges boolean", rows, False)


def _of_file(files: DataFrame, schema: str, give: Callable[[File], Iterable[Row]], strict: bool, password: str) -> DataFrame:
    return _table(files, schema, lambda content: give(File(content, password)), strict)


def outline(files: DataFrame, strict: bool = False, password: str = "") -> DataFrame:
    """Bookmarks in order: position, level (from 1), title, the destination's name and page, action, uri."""
    return _of_file(files, OUTLINE, lambda f: ({"position": i, **r} for i, r in enumerate(catalog.outline(f))), strict, password)


def page_labels(files: DataFrame, strict: bool = False, password: str = "") -> DataFrame:
    """Label ranges: doc_id, first_page (from 1), style, prefix, start."""

    def give(file: File) -> Iterator[Row]:
        for first, label in catalog.number_tree(file, catalog.catalog(file).get("PageLabels")):
            label = file.get(label) or {}
            style = file.get(label.get("S"))
            yield {"first_page": first + 1, "style": str(style) if isinstance(style, Name) else None, "prefix": text_of(file.get(label.get("P"))) or "", "start": int(file.get(label.get("St", 1)))}

    return _of_file(files, "doc_id string, first_page int, style string, prefix string, start long", give, strict, password)


def named_destinations(files: DataFrame, strict: bool = False, password: str = "") -> DataFrame:
    """doc_id, name, page_no."""

    def give(file: File) -> Iterator[Row]:
        names, numbers = catalog.destinations(file), catalog.page_numbers(file)
        return ({"name": k, "page_no": catalog.destination_page(file, v, names, numbers)} for k, v in names.items())

    return _of_file(files, "doc_id string, name string, page_no int", give, strict, password)


def embedded_files(files: DataFrame, strict: bool = False, password: str = "") -> DataFrame:
    """doc_id, name, data."""
    return _of_file(files, "doc_id string, name string, data binary", lambda f: ({"name": n, "data": d} for n, d in catalog.embedded_files(f)), strict, password)


def structure(files: DataFrame, strict: bool = False, password: str = "") -> DataFrame:
    """Structure elements, depth first; parents are ids of the same document."""
    return _of_file(files, STRUCTURE, catalog.structure, strict, password)


def _annotation_text(raw: Any) -> str | None:
    """UTF-8, else UTF-16, else as any text string."""
    if not isinstance(raw, bytes):
        return text_of(raw)
    for codec in ("utf-8", "utf-16") if raw[:2] != b"\xfe\xff" else ("utf-16",):
        try:
            return raw.decode(codec)
        except UnicodeDecodeError:
            pass
    return text_of(raw)


def annotations(files: DataFrame, strict: bool = False, password: str = "") -> DataFrame:
    """Annotations of pages, turned with their page: subtype, box, uri, title, contents."""

    def rows(content: bytes) -> Iterator[Row]:
        for n, page, start in _pages_of(content, password):
            if isinstance(page, Exception):
                continue
            for k, ref in enumerate(page.file.get(page.page.get("Annots")) or []):
                a = page.file.deep(ref, 3)
                rect = a.get("Rect") if isinstance(a, dict) else None
                if not isinstance(rect, list) or len(rect) != 4:
                    continue
                action = a["A"] if isinstance(a.get("A"), dict) else {}
                spot = page._box(page.start, *[float(v) for v in rect])
                yield {"page_no": n, "position": k, "subtype": str(a.get("Subtype")), **_placed(spot, page, start), "uri": _annotation_text(action.get("URI")), "title": _annotation_text(a.get("T")), "contents": _annotation_text(a.get("Contents"))}

    return _table(files, ANNOTATIONS, rows, strict)


def hyperlinks(files: DataFrame, strict: bool = False, password: str = "") -> DataFrame:
    """Annotations that have a uri."""
    return annotations(files, strict, password).filter("uri is not null")


def objects(files: DataFrame, codec: str | None = None, password: str = "") -> DataFrame:
    """doc_id, number (0 for the trailer), xml: all objects of a file. ``codec``: raw, binary, text, or streams left out."""

    def give(file: File) -> Iterator[Row]:
        from .syntax import Ref

        yield {"number": 0, "xml": f"<trailer>\n{catalog.object_xml(file, file.trailer, codec)}\n</trailer>"}
        for number in sorted(file.places):
            got = file.get(Ref(number, 0))
            if got is not None:
                yield {"number": number, "xml": f'<object id="{number}">\n{catalog.object_xml(file, got, codec)}\n</object>'}

    return _of_file(files, "doc_id string, number int, xml string", give, False, password)


def repair(files: DataFrame) -> DataFrame:
    """Files with the corners of their page boxes in order, at the same length."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            fixed = [None if c is None else catalog.repair(c) for c in batch["content"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(fixed, pa.binary())], names=["doc_id", "content"])

    return files.select("doc_id", "content").mapInArrow(run, "doc_id string, content binary")


def extractable(files: DataFrame, password: str = "") -> DataFrame:
    """The files whose permissions allow text to be taken; raises for any other."""
    allowed = documents(files, password).select("doc_id", "extractable")
    refused = F.when(~F.col("extractable"), F.raise_error(F.concat(F.lit("no extraction allowed: "), "doc_id")).cast("boolean")).otherwise(True)
    return files.join(allowed, "doc_id").filter(refused).drop("extractable")


def mcid_text(characters: DataFrame) -> DataFrame:
    """doc_id, page_no, mcid, text: characters of each marked content in content order."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "text")))
    return characters.filter("mcid is not null").groupBy("doc_id", "page_no", "mcid").agg(F.array_join(F.transform(ordered, lambda c: c["text"]), "").alias("text"))


def _descendants(elements: DataFrame) -> DataFrame:
    """doc_id, ancestor, id: every element with each one above it and itself; a join for each level of depth."""
    step = elements.select("doc_id", F.col("id").alias("ancestor"), "id")
    own = elements.select("doc_id", F.col("id").alias("_child"), F.col("parent").alias("_parent"))
    deepest = elements.agg(F.max("depth")).first()[0] or 0
    out = level = step
    for _ in range(deepest):
        level = level.join(own, (level["doc_id"] == own["doc_id"]) & (level["id"] == own["_parent"])).select(level["doc_id"], "ancestor", F.col("_child").alias("id"))
        out = out.unionByName(level)
    return out


def _marks_above(elements: DataFrame) -> DataFrame:
    """doc_id, id, page_no, mcid: each marked content with its element and every element above it, in one pass over the elements."""
    tree = elements.groupBy("doc_id").agg(F.collect_list("id").alias("ids"), F.collect_list(F.coalesce("parent", F.lit(-1))).alias("parents"), F.collect_list(F.coalesce("mcids", F.array())).alias("mcids"))
    kind = elements.schema["doc_id"].dataType.simpleString()

    def climb(batches):
        import pyarrow as pa

        for batch in batches:
            rows, ids, page_nos, marks = [], [], [], []
            for k, (own, parents, mcids) in enumerate(zip(*[batch[c].to_pylist() for c in ("ids", "parents", "mcids")], strict=True)):
                above = dict(zip(own, parents, strict=True))
                for at, found in zip(own, mcids, strict=True):
                    seen: set[int] = set()
                    while found and at in above and at not in seen:
                        seen.add(at)
                        rows += [k] * len(found)
                        ids += [at] * len(found)
                        page_nos += [m["page_no"] for m in found]
                        marks += [m["mcid"] for m in found]
                        at = above[at]
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(rows, pa.int64())), pa.array(ids, pa.int32()), pa.array(page_nos, pa.int32()), pa.array(marks, pa.int32())], names=["doc_id", "id", "page_no", "mcid"])

    return tree.mapInArrow(climb, f"doc_id {kind}, id int, page_no int, mcid int")


def element_boxes(elements: DataFrame, characters: DataFrame) -> DataFrame:
    """doc_id, id, page_no, box, text of each structure element: from the characters of its marked contents and of those below it."""
    marked = _marks_above(elements)
    inside = marked.join(characters.filter("mcid is not null"), ["doc_id", "page_no", "mcid"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda c: c["text"]), "").alias("text")
    return inside.groupBy("doc_id", "id", "page_no").agg(F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"), text)


def find_elements(elements: DataFrame, wanted: str | re.Pattern[str] | Callable[..., Any], under: int | None = None) -> DataFrame:
    """Elements by type (a name, or a pattern found in it) or by a function of the DataFrame's columns that gives a condition; in document order by id."""
    if isinstance(wanted, str):
        test = F.col("type") == wanted
    elif isinstance(wanted, re.Pattern):
        test = F.col("type").rlike(wanted.pattern)
    else:
        test = wanted(elements)
    out = elements.filter(test)
    if under is not None:
        below = _descendants(elements).filter((F.col("ancestor") == under) & (F.col("id") != under)).select("doc_id", "id")
        out = out.join(below, ["doc_id", "id"], "left_semi")
    return out
