"""Objects and tables as text, CSV, JSON, XML, HTML and hOCR, by columns and ordered aggregates."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache
from itertools import groupby
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import box_text, escape_csv, escape_html

if TYPE_CHECKING:
    from ..operators.layout import LayoutSettings

PAGE = ["doc_id", "page_no"]


def _ordered(order: Sequence[str], text: Column, by: str) -> Column:
    rows = F.array_sort(F.collect_list(F.struct(*order, text.alias("_t"))))
    return F.array_join(F.transform(rows, lambda r: r["_t"]), by)


def attributes(df: DataFrame, include: Sequence[str] | None = None, exclude: Sequence[str] | None = None) -> list[str]:
    """The columns to export; include and exclude rule each other out, object_type always stays."""
    if include is not None and exclude is not None:
        raise ValueError("give include or exclude, not both")
    keep = [c for c in df.columns if (include is None or c in include or c == "object_type") and (exclude is None or c not in exclude or c == "object_type")]
    return keep


def _rounded(df: DataFrame, columns: Sequence[str], precision: int | None) -> list[Column]:
    kinds = dict(df.dtypes)
    return [F.round(F.col(c), precision).alias(c) if precision is not None and kinds[c] in ("double", "float") else F.col(c) for c in columns]


def objects_json(df: DataFrame, include: Sequence[str] | None = None, exclude: Sequence[str] | None = None, precision: int | None = None) -> DataFrame:
    """doc_id, page_no, seq, json: one JSON object a row; bytes become base64."""
    kinds = dict(df.dtypes)
    names = [c for c in attributes(df, include, exclude) if c not in PAGE]
    columns = [F.base64(c).alias(n) if kinds[n] == "binary" else c for n, c in zip(names, _rounded(df, names, precision), strict=True)]
    return df.select(*PAGE, "seq", F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("json"))


def objects_csv(df: DataFrame, include: Sequence[str] | None = None, exclude: Sequence[str] | None = None, precision: int | None = None) -> DataFrame:
    """doc_id, page_no, seq, line: one CSV line a row, quoted only where needed."""
    names = attributes(df, include, exclude)
    line = F.array_join(F.array(*[escape_csv(c.cast("string")) for c in _rounded(df, names, precision)]), ",")
    return df.select(*PAGE, "seq", line.alias("line"))


def tables_csv(cells: DataFrame) -> DataFrame:
    """doc_id, csv of all tables of a document: a heading for each, null cells empty. ``cells`` as from extract_cells."""
    by = [*PAGE, "table"]
    rows = cells.groupBy(*by, "row_index").agg(_ordered(["column_index"], escape_csv(F.col("text")), ",").alias("_line"))
    tables = rows.groupBy(*by).agg(_ordered(["row_index"], F.col("_line"), "\n").alias("_body"))
    whole = F.concat(F.format_string("--- Page %d Table %d ---\n", F.col("page_no"), F.col("table") + 1), F.col("_body"), F.lit("\n"))
    return tables.groupBy("doc_id").agg(_ordered(["page_no", "table"], whole, "").alias("csv"))


def tables_json(tables: DataFrame) -> DataFrame:
    """doc_id, json: [{page, table, rows}]. ``tables`` as from extract_tables."""
    one = F.struct(F.col("page_no").alias("page"), F.col("table"), F.col("rows"))
    return tables.groupBy("doc_id").agg(F.to_json(F.array_sort(F.collect_list(one)), {"ignoreNullFields": "false"}).alias("json"))


def flat_tables(tables: DataFrame) -> DataFrame:
    """All cells of a page in one array, with where rows and tables begin: cells, row_offsets, table_offsets."""
    page = tables.groupBy(*PAGE).agg(F.transform(F.array_sort(F.collect_list(F.struct("table", "rows"))), lambda t: t["rows"]).alias("_t"))
    rows = F.flatten("_t")
    ends = lambda sizes: F.aggregate(sizes, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
    return page.select(*PAGE, F.flatten(rows).alias("cells"), ends(F.transform(rows, lambda r: F.size(r))).alias("row_offsets"), ends(F.transform("_t", lambda t: F.size(t))).alias("table_offsets"))


def document_text(pages: DataFrame, form_feed: bool = True) -> DataFrame:
    """doc_id, text of all pages in order."""
    end = "\f" if form_feed else ""
    body = F.col("text") if not form_feed else F.when(F.col("text").endswith("\f"), F.col("text")).otherwise(F.concat("text", F.lit(end)))
    return pages.groupBy("doc_id").agg(_ordered(["page_no"], body, "").alias("text"))


def _clean(text: Column) -> Column:
    return escape_html(F.regexp_replace(text, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]", ""))


def lines_xml(lines: DataFrame) -> DataFrame:
    """doc_id, xml: pages, boxes and lines. ``lines`` as from layout_boxes."""
    box = box_text(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    line = F.concat(F.lit('<textline bbox="'), box, F.lit('">'), _clean(F.col("text")), F.lit("</textline>"))
    boxes = lines.filter("box is not null").groupBy(*PAGE, "box_index").agg(_ordered(["line"], line, "\n").alias("_l"))
    whole = F.concat(F.format_string('<textbox id="%d">\n', F.col("box_index")), F.col("_l"), F.lit("\n</textbox>"))
    pages = boxes.groupBy(*PAGE).agg(_ordered(["box_index"], whole, "\n").alias("_b"))
    page = F.concat(F.format_string('<page id="%d">\n', F.col("page_no")), F.col("_b"), F.lit("\n</page>"))
    return pages.groupBy("doc_id").agg(F.concat(F.lit('<?xml version="1.0" encoding="utf-8" ?>\n<pages>\n'), _ordered(["page_no"], page, "\n"), F.lit("\n</pages>\n")).alias("xml"))


def words_hocr(words: DataFrame) -> DataFrame:
    """doc_id, page_no, html: a word a span with its box."""
    spot = F.format_string("bbox %d %d %d %d", *[F.round(c).cast("int") for c in ("x0", "top", "x1", "bottom")])
    span = F.concat(F.lit("<span class='ocrx_word' title='"), spot, F.lit("'>"), _clean(F.col("text")), F.lit("</span>"))
    return words.groupBy(*PAGE).agg(F.concat(F.lit("<div class='ocr_page'>"), _ordered(["word"], span, " "), F.lit("</div>")).alias("html"))


def lines_html(lines: DataFrame, scale: float = 1.0) -> DataFrame:
    """doc_id, page_no, html: a line a div at its place. ``lines`` have text, x0, top."""
    place = F.format_string("position:absolute; left:%.0fpx; top:%.0fpx;", F.col("x0") * scale, F.col("top") * scale)
    div = F.concat(F.lit('<div style="'), place, F.lit('">'), _clean(F.col("text")), F.lit("</div>"))
    return lines.groupBy(*PAGE).agg(_ordered(["line"], div, "\n").alias("html"))


# Whole documents


def _bbox(*names: str) -> Column:
    return box_text(*[F.col(c) for c in names or ("x0", "y0", "x1", "y1")])


def _attribute(name: str, value: Column) -> Column:
    return F.concat(F.lit(f' {name}="'), escape_html(F.coalesce(value.cast("string"), F.lit(""))), F.lit('"'))


def document_xml(chars: DataFrame, lines: DataFrame, pages: DataFrame, shapes: DataFrame | None = None, images: DataFrame | None = None, figures: DataFrame | None = None) -> DataFrame:
    """doc_id, xml: pages with their text boxes, lines and characters (font, box, size), then lines, rectangles, curves, images, figures, and the boxes' order.

    ``chars`` have ``line`` (as from layout.line_chars), ``lines`` are those of layout_boxes.
    """
    text = F.concat(F.lit("<text"), _attribute("font", F.col("fontname")), F.lit(' bbox="'), _bbox(), F.lit('" size="'), F.format_string("%.3f", "size"), F.lit('">'), _clean(F.col("text")), F.lit("</text>"))
    inner = chars.groupBy(*PAGE, "line").agg(_ordered(["seq"], text, "\n").alias("_c"))
    line = F.concat(F.lit('<textline bbox="'), _bbox(), F.lit('">\n'), F.coalesce("_c", F.lit("")), F.lit("\n<text>\n</text>\n</textline>"))
    placed = lines.filter("box is not null").join(inner, [*PAGE, "line"], "left")
    boxes = placed.groupBy(*PAGE, "box_index").agg(
        _ordered(["line"], line, "\n").alias("_l"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.first("vertical").alias("_v")
    )
    mode = F.when(F.col("_v"), ' wmode="vertical"').otherwise("")
    whole = F.concat(F.format_string('<textbox id="%d" bbox="', "box_index"), _bbox(), F.lit('"'), mode, F.lit(">\n"), F.col("_l"), F.lit("\n</textbox>"))
    short = F.concat(F.format_string('<textbox id="%d" bbox="', "box_index"), _bbox(), F.lit('" />'))
    parts = [boxes.select(*PAGE, F.lit(0).alias("_k"), F.col("box_index").cast("long").alias("_i"), whole.alias("_x"))]
    if shapes is not None:
        points = F.array_join(F.transform("pts", lambda p: F.format_string("%.3f,%.3f", p["x"], p["y"])), ",")
        shape = F.concat(F.lit("<"), F.col("object_type"), F.format_string(' linewidth="%.0f" bbox="', "linewidth"), _bbox(), F.lit('"'), F.when(F.col("object_type") == "curve", F.concat(F.lit(' pts="'), points, F.lit('"'))).otherwise(""), F.lit("/>"))
        parts.append(shapes.select(*PAGE, F.lit(1).alias("_k"), F.col("seq").alias("_i"), shape.alias("_x")))
    if images is not None:
        image = F.concat(F.lit("<image"), _attribute("src", F.col("name")), _attribute("width", F.col("pixel_width")), _attribute("height", F.col("pixel_height")), F.lit(" />"))
        parts.append(images.select(*PAGE, F.lit(1).alias("_k"), F.col("seq").alias("_i"), image.alias("_x")))
    if figures is not None:
        figure = F.concat(F.lit("<figure"), _attribute("name", F.col("name")), F.lit(' bbox="'), _bbox(), F.lit('" />'))
        parts.append(figures.select(*PAGE, F.lit(1).alias("_k"), F.col("seq").alias("_i"), figure.alias("_x")))
    groups = boxes.groupBy(*PAGE).agg(F.concat(F.lit("<layout>\n<textgroup>\n"), _ordered(["box_index"], short, "\n"), F.lit("\n</textgroup>\n</layout>")).alias("_x"))
    parts.append(groups.select(*PAGE, F.lit(2).alias("_k"), F.lit(0).cast("long").alias("_i"), "_x"))
    items = parts[0]
    for p in parts[1:]:
        items = items.unionByName(p)
    bodies = items.groupBy(*PAGE).agg(_ordered(["_k", "_i"], F.col("_x"), "\n").alias("_b"))
    frame = pages.select(*PAGE, F.format_string('<page id="%d" bbox="0.000,0.000,%.3f,%.3f" rotate="%d">\n', "page_no", "width", "height", "rotate").alias("_h"))
    page = F.concat("_h", F.coalesce("_b", F.lit("")), F.lit("\n</page>"))
    return frame.join(bodies, PAGE, "left").groupBy("doc_id").agg(F.concat(F.lit('<?xml version="1.0" encoding="utf-8" ?>\n<pages>\n'), _ordered(["page_no"], page, "\n"), F.lit("\n</pages>\n")).alias("xml"))


def check_mode(mode: str) -> None:
    if mode not in ("exact", "normal", "loose"):
        raise ValueError(f"no such mode: {mode}")


def document_html(chars: DataFrame, lines: DataFrame, pages: DataFrame, mode: str = "normal", scale: float = 1.0, fontscale: float = 1.0, gap: float = 50.0) -> DataFrame:
    """doc_id, html: absolutely placed pages. Modes: exact (each character), normal (boxes of lines with their fonts), loose (boxes as flowing text)."""
    check_mode(mode)
    before = Window.partitionBy("doc_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
    tops = pages.withColumn("_start", F.coalesce(F.sum((F.col("height") + gap) * scale).over(before), F.lit(0.0)) + gap * scale)
    px = lambda c: F.format_string("%.0fpx", c)
    own = tops.select(*PAGE, "height", "_start")
    y = F.col("_start") + (F.col("height") - F.col("y1")) * scale
    place = F.concat(F.lit("position:absolute; left:"), px(F.col("x0") * scale), F.lit("; top:"), px(y), F.lit(";"))
    font = F.concat(F.lit("font-family:"), escape_html(F.regexp_replace(F.coalesce("fontname", F.lit("")), "^[A-Z]{6}[+]", "")), F.lit("; font-size:"), px(F.col("size") * scale * fontscale))
    if mode == "exact":
        span = F.concat(F.lit('<span style="'), place, F.lit(" "), font, F.lit('">'), _clean(F.col("text")), F.lit("</span>"))
        body = chars.join(own, PAGE).groupBy(*PAGE).agg(_ordered(["seq"], span, "\n").alias("_b"))
    else:
        order = Window.partitionBy(*PAGE, "line").orderBy("seq")
        turn = ~(F.col("fontname").eqNullSafe(F.lag("fontname").over(order)) & F.col("size").eqNullSafe(F.lag("size").over(order)))
        runs = chars.withColumn("_r", F.sum(F.when(turn, 1).otherwise(0)).over(order)).groupBy(*PAGE, "line", "_r").agg(_ordered(["seq"], F.col("text"), "").alias("_t"), F.min("fontname").alias("fontname"), F.max("size").alias("size"))
        span = F.concat(F.lit('<span style="'), font, F.lit('">'), _clean(F.col("_t")), F.lit("</span>"))
        texts = runs.groupBy(*PAGE, "line").agg(_ordered(["_r"], span, "").alias("_s"))
        rows = lines.filter("box is not null").join(texts, [*PAGE, "line"], "left")
        by = F.lit("<br>") if mode == "normal" else F.lit(" ")
        boxes = rows.groupBy(*PAGE, "box_index").agg(_ordered(["line"], F.concat(F.coalesce("_s", F.lit("")), by), "").alias("_s"), F.min("x0").alias("x0"), F.max("y1").alias("y1"), F.max("x1").alias("x1"))
        wide = F.concat(F.lit(" width:"), px((F.col("x1") - F.col("x0")) * scale), F.lit(";"))
        div = F.concat(F.lit('<div style="'), place, wide, F.lit('">'), F.col("_s"), F.lit("</div>"))
        body = boxes.join(own, PAGE).groupBy(*PAGE).agg(_ordered(["box_index"], div, "\n").alias("_b"))
    frame = F.concat(F.lit('<span style="position:absolute; border: gray 1px solid; left:0px; top:'), px(F.col("_start")), F.lit("; width:"), px(F.col("width") * scale), F.lit("; height:"), px(F.col("height") * scale), F.lit(';"></span>\n'))
    head = F.concat(F.lit('<div style="position:absolute; top:'), px(F.col("_start")), F.format_string(';"><a name="%d">Page %d</a></div>\n', "page_no", "page_no"))
    page = F.concat(frame, head, F.coalesce("_b", F.lit("")), F.lit("\n"))
    whole = tops.join(body, PAGE, "left").groupBy("doc_id").agg(_ordered(["page_no"], page, "").alias("_p"))
    return whole.select("doc_id", F.concat(F.lit('<html><head>\n<meta http-equiv="Content-Type" content="text/html; charset=utf-8">\n</head><body>\n'), "_p", F.lit("</body></html>\n")).alias("html"))


@lru_cache(maxsize=65_536)
def _px(x: float) -> str:
    """Pixels as format_string rounds them: halves away from zero."""
    return f"{Decimal(repr(x)).quantize(Decimal(1), ROUND_HALF_UP)}px"


_CONTROLS = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f]")
_SUBSET = re.compile("^[A-Z]{6}[+]")


def _escaped(text: str) -> str:
    return text.replace("&", "&amp;").replace(">", "&gt;").replace("<", "&lt;").replace('"', "&quot;")


def html_of_pages(pages: Iterable[tuple[int, float, float, list[dict]]], settings: LayoutSettings, mode: str = "normal", scale: float = 1.0, fontscale: float = 1.0, gap: float = 50.0) -> str | None:
    """The html of ``document_html`` for one document: number, width, height and characters of each page in order; None without pages."""
    from ..operators.layout import page_boxes, page_lines

    clean = lambda t: _escaped(_CONTROLS.sub("", t))
    parts, before = [], None
    for number, width, height, chars in pages:
        start = (0.0 if before is None else before) + gap * scale
        before = (0.0 if before is None else before) + (height + gap) * scale

        def place(x0: float, y1: float, start: float = start, height: float = height) -> str:
            return f"position:absolute; left:{_px(x0 * scale)}; top:{_px(start + (height - y1) * scale)};"

        def font(c: dict) -> str:
            return f"font-family:{_escaped(_SUBSET.sub('', c['fontname'] or ''))}; font-size:{_px(c['size'] * scale * fontscale)}"

        if mode == "exact":
            body = [f'<span style="{place(c["x0"], c["y1"])} {font(c)}">{clean(c["text"])}</span>' for c in chars]
        else:
            lines, body, by = page_lines(chars, settings), [], "<br>" if mode == "normal" else " "
            for box in page_boxes(lines, settings):
                text = ""
                for k in box:
                    for _, run in groupby(lines[k], key=lambda c: (c["fontname"], c["size"])):
                        held = list(run)
                        text += f'<span style="{font(held[0])}">{clean("".join(c["text"] for c in held))}</span>'
                    text += by
                every = [c for k in box for c in lines[k]]
                x0, x1 = min(c["x0"] for c in every), max(c["x1"] for c in every)
                body.append(f'<div style="{place(x0, max(c["y1"] for c in every))} width:{_px((x1 - x0) * scale)};">{text}</div>')
        frame = f'<span style="position:absolute; border: gray 1px solid; left:0px; top:{_px(start)}; width:{_px(width * scale)}; height:{_px(height * scale)};"></span>\n'
        head = f'<div style="position:absolute; top:{_px(start)};"><a name="{number}">Page {number}</a></div>\n'
        parts.append(frame + head + "\n".join(body) + "\n")
    if not parts:
        return None
    return '<html><head>\n<meta http-equiv="Content-Type" content="text/html; charset=utf-8">\n</head><body>\n' + "".join(parts) + "</body></html>\n"


def document_hocr(words: DataFrame, lines: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, html: pages, blocks (lines of layout_boxes) and words with their boxes, as OCR programs give them."""
    spot = lambda a, b, c, d: F.format_string("bbox %d %d %d %d", *[F.round(x).cast("int") for x in (a, b, c, d)])
    word = F.concat(F.lit("<span class='ocrx_word' title='"), spot(F.col("x0"), F.col("top"), F.col("x1"), F.col("bottom")), F.lit("'>"), _clean(F.col("text")), F.lit("</span>"))
    texts = words.groupBy(*PAGE).agg(_ordered(["word"], word, " ").alias("_w"))
    heights = pages.select(*PAGE, F.col("width").alias("_pw"), F.col("height").alias("_ph"))
    blocks = lines.filter("box is not null").groupBy(*PAGE, "box_index").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")).join(heights, PAGE)
    block = F.concat(F.lit("<div class='ocr_block' title='"), spot(F.col("x0"), F.col("_ph") - F.col("y1"), F.col("x1"), F.col("_ph") - F.col("y0")), F.lit("'></div>"))
    areas = blocks.groupBy(*PAGE).agg(_ordered(["box_index"], block, "\n").alias("_a"))
    page = F.concat(F.lit("<div class='ocr_page' title='"), spot(F.lit(0.0), F.lit(0.0), F.col("_pw"), F.col("_ph")), F.lit("'>\n"), F.coalesce("_a", F.lit("")), F.lit("\n"), F.coalesce("_w", F.lit("")), F.lit("\n</div>"))
    whole = heights.join(areas, PAGE, "left").join(texts, PAGE, "left").groupBy("doc_id").agg(_ordered(["page_no"], page, "\n").alias("_p"))
    return whole.select("doc_id", F.concat(F.lit("<html xmlns='http://www.w3.org/1999/xhtml' xml:lang='en' lang='en'>\n<head>\n<title></title>\n<meta name='ocr-capabilities' content='ocr_page ocr_block ocrx_word'/>\n</head>\n<body>\n"), "_p", F.lit("\n</body></html>\n")).alias("html"))


def document_tagged(chars: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, xml: characters in content order inside the tags that mark them."""
    order = Window.partitionBy(*PAGE).orderBy("seq")
    same = F.col("tag").eqNullSafe(F.lag("tag").over(order)) & F.col("mcid").eqNullSafe(F.lag("mcid").over(order))
    runs = chars.withColumn("_r", F.sum(F.when(same, 0).otherwise(1)).over(order)).groupBy(*PAGE, "_r").agg(F.first("tag").alias("tag"), F.first("mcid").alias("mcid"), _ordered(["seq"], F.col("text"), "").alias("_t"))
    name = F.regexp_replace("tag", "[^A-Za-z0-9_.-]", "_")
    mark = F.when(F.col("mcid").isNotNull(), F.format_string(' MCID="%d"', "mcid")).otherwise("")
    run = F.when(F.col("tag").isNull(), _clean(F.col("_t"))).otherwise(F.concat(F.lit("<"), name, mark, F.lit(">"), _clean(F.col("_t")), F.lit("</"), name, F.lit(">")))
    bodies = runs.groupBy(*PAGE).agg(_ordered(["_r"], run, "").alias("_b"))
    page = F.concat(F.format_string('<page id="%d" bbox="0.000,0.000,%.3f,%.3f" rotate="%d">', "page_no", "width", "height", "rotate"), F.coalesce("_b", F.lit("")), F.lit("</page>\n"))
    return pages.join(bodies, PAGE, "left").groupBy("doc_id").agg(_ordered(["page_no"], page, "").alias("xml"))


def document_dict(documents: DataFrame, pages: DataFrame, **objects: DataFrame) -> DataFrame:
    """doc_id, metadata (map), pages: array of page structs, each with an array of structs for every kind of object given."""
    whole = pages
    for kind, rows in objects.items():
        names = [c for c in rows.columns if c not in PAGE]
        held = rows.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("seq", *[c for c in names if c != "seq"]))).alias(kind))
        whole = whole.join(held, PAGE, "left").withColumn(kind, F.coalesce(kind, F.array().cast(held.schema[kind].dataType)))
    page = F.struct("page_no", *[c for c in whole.columns if c not in PAGE])
    listed = whole.groupBy("doc_id").agg(F.collect_list(page).alias("pages")).withColumn("pages", F.array_sort("pages", lambda a, b: a["page_no"] - b["page_no"]))
    return documents.select("doc_id", F.col("info").alias("metadata")).join(listed, "doc_id", "left")


def overlay(df: DataFrame, kind: str, stroke: str = "red", scale: float = 1.0, column: str = "x0") -> DataFrame:
    """Boxes, lines and points as drawing rows for a page image: page, shape, coordinates in pixels, colour."""
    shape = {"box": "rect", "line": "line", "vline": "line", "hline": "line", "circle": "ellipse"}[kind]
    return df.select(*PAGE, F.lit(shape).alias("shape"), *[(F.col(c) * scale).alias(c) for c in ("x0", "top", "x1", "bottom")], F.lit(stroke).alias("stroke"))


def overlay_svg(marks: DataFrame, pages: DataFrame, scale: float = 1.0) -> DataFrame:
    """doc_id, page_no, svg: the rows of ``overlay`` as a drawing of the page's size."""
    xy = ("x0", "top", "x1", "bottom")
    rect = F.format_string('<rect x="%.2f" y="%.2f" width="%.2f" height="%.2f" fill="none" stroke="%s"/>', "x0", "top", F.col("x1") - F.col("x0"), F.col("bottom") - F.col("top"), "stroke")
    line = F.format_string('<line x1="%.2f" y1="%.2f" x2="%.2f" y2="%.2f" stroke="%s"/>', *xy, "stroke")
    ellipse = F.format_string('<ellipse cx="%.2f" cy="%.2f" rx="%.2f" ry="%.2f" fill="none" stroke="%s"/>', (F.col("x0") + F.col("x1")) / 2, (F.col("top") + F.col("bottom")) / 2, (F.col("x1") - F.col("x0")) / 2, (F.col("bottom") - F.col("top")) / 2, "stroke")
    drawn = F.when(F.col("shape") == "rect", rect).when(F.col("shape") == "line", line).otherwise(ellipse)
    body = marks.groupBy(*PAGE).agg(_ordered(["shape", *xy], drawn, "\n").alias("_b"))
    head = F.format_string('<svg xmlns="http://www.w3.org/2000/svg" width="%.2f" height="%.2f">\n', F.col("width") * scale, F.col("height") * scale)
    return pages.join(body, PAGE, "left").select(*PAGE, F.concat(head, F.coalesce("_b", F.lit("")), F.lit("\n</svg>")).alias("svg"))


def structure_json(elements: DataFrame, texts: DataFrame) -> DataFrame:
    """doc_id, id, json: structure elements, each with the texts of its marked contents (doc_id, page_no, mcid, text)."""
    marks = elements.select("doc_id", "id", F.posexplode("mcids").alias("_k", "_m")).select("doc_id", "id", "_k", "_m.page_no", "_m.mcid")
    own = marks.join(texts, ["doc_id", "page_no", "mcid"]).groupBy("doc_id", "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "text"))), lambda x: x["text"]).alias("text"))
    rows = elements.join(own, ["doc_id", "id"], "left")
    return rows.select("doc_id", "id", F.to_json(F.struct("id", "parent", "type", "page_no", "lang", "title", "alt_text", "actual_text", "attributes", F.col("mcids.mcid").alias("mcids"), "text")).alias("json"))


def object_rows(df: DataFrame, kind: str) -> DataFrame:
    """Any objects with ``object_type``, which exports keep."""
    return df if "object_type" in df.columns else df.withColumn("object_type", F.lit(kind))
