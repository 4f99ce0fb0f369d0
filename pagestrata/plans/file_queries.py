"""Registered queries over page files made of the raw tables, and of scalar and geometric functions, each with its SQL.

The files are written in twelve kinds (filters, object streams, damaged
cross-references, encryption, forms) by ``doc_id`` modulo their number, and
read back; the SQL knows nothing of files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bidi
from ..functions import text as T
from ..operators import geometry, layout, pages, search, sets, tables, words
from ..sources import sinks
from ..sources.pdf import reader, writer
from . import queries as base
from . import verbs
from .queries import _BOXES_SQL, _COLUMNS, _GRID, _TEXT_LINES, _boxes, _chars, _chars_sql, _lines_sql, _page_chars, _read, _register, _ruled, _words_sql

_PAGES = """WITH p AS (SELECT doc_id, len(string_split(text, chr(10))) AS n, GREATEST(1, list_max(list_transform(string_split(text, chr(10)), lambda x: length(x)))) * 6.0::DOUBLE AS width FROM documents WHERE text IS NOT NULL),
  pages AS (SELECT doc_id, CAST(unnest(range(CAST(ceil(n / 64.0) AS BIGINT))) + 1 AS INTEGER) AS page_no, width FROM p)"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writer.page_files(_read(spark, sf_dir, "documents"), kind=F.pmod(F.col("doc_id"), F.lit(len(writer.KINDS)))).select("doc_id", "content")


def _number(df: DataFrame) -> DataFrame:
    return df.withColumn("doc_id", F.col("doc_id").cast("long"))


# Files


@_register(_chars_sql() + """ SELECT doc_id, page_no, COUNT(*) AS n, md5(string_agg(text, '' ORDER BY line, x0)) AS text, SUM(x0) AS x0, SUM(x0 + 6) AS x1, SUM(top) AS top, SUM(top + 10) AS bottom,
  SUM(top + (page_no - 1) * 768.0::DOUBLE) AS doctop, SUM(758 - top) AS y0, SUM(10.0::DOUBLE) AS size FROM chars GROUP BY ALL""")
def file_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of files of all kinds, in content order, and the sums of their places in both coordinate systems (exact in doubles)."""
    sums = ("x0", "x1", "top", "bottom", "doctop", "y0", "size")
    got = _number(reader.chars(_files(spark, sf_dir), strict=True, columns=("doc_id", "page_no", "seq", "text", *sums)))
    text = F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda c: c["text"]), ""))
    return got.groupBy("doc_id", "page_no").agg(F.count("*").alias("n"), text.alias("text"), *[F.sum(c).alias(c) for c in sums])


@_register(_PAGES + " SELECT doc_id, page_no, width, 768.0::DOUBLE AS height, 0 AS rotate, (page_no - 1) * 768.0::DOUBLE AS initial_doctop FROM pages")
def file_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _number(reader.pages(_files(spark, sf_dir), strict=True)).select("doc_id", "page_no", "width", "height", "rotate", "initial_doctop")


@_register(_PAGES + " SELECT doc_id, page_no, width AS height, 768.0::DOUBLE AS width, 90 AS rotate FROM pages WHERE page_no = 2")
def file_page_turned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of each file, turned by 90 degrees more."""
    return _number(reader.pages(_files(spark, sf_dir), strict=True, numbers=[2], turn=90)).select("doc_id", "page_no", "width", "height", "rotate")


@_register("""SELECT doc_id, CAST(ceil(len(string_split(text, chr(10))) / 64.0) AS INTEGER) AS page_count, CAST(ceil(len(string_split(text, chr(10))) / 64.0) AS INTEGER) AS declared_pages, '1.7' AS version,
  doc_id % 12 IN (8, 9, 10) AS encrypted, 'none' AS form_type, false AS has_javascript, true AS extractable, doc_id % 12 = 7 AS fallback_xref, NULL::VARCHAR AS error FROM documents WHERE text IS NOT NULL""")
def file_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _number(reader.documents(_files(spark, sf_dir))).select("doc_id", "page_count", "declared_pages", "version", "encrypted", "form_type", "has_javascript", "extractable", "fallback_xref", "error")


@_register(_words_sql() + _TEXT_LINES + " SELECT doc_id, page_no, string_agg(text, chr(10) ORDER BY line) AS text FROM text_lines GROUP BY ALL")
def file_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _number(verbs.Document(_files(spark, sf_dir)).page_texts())


@_register(base.ORACLE_SQL["reading_order"].replace("SELECT doc_id, page_no, string_agg(t, '' ORDER BY b) || chr(12) AS text FROM t GROUP BY ALL", "SELECT doc_id, string_agg(x, '' ORDER BY page_no) AS text FROM (SELECT doc_id, page_no, string_agg(t, '' ORDER BY b) || chr(12) AS x FROM t GROUP BY ALL) q GROUP BY ALL"))
def file_layout_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents by layout analysis."""
    return _number(verbs.extract_text(_files(spark, sf_dir)))


@_register("WITH " + _lines_sql() + """ SELECT doc_id, page_no, count(*) AS lines, sum(length(l)) AS chars FROM lines WHERE l <> '' GROUP BY ALL""")
def file_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and characters of the untagged text sink, counted again from the layout lines."""
    lines = layout.layout_lines(reader.chars(_files(spark, sf_dir)))
    return _number(lines.groupBy("doc_id", "page_no").agg(F.count("*").alias("lines"), F.sum(F.length("text") - 1).alias("chars")))


_ROWS = f"""WITH r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_COLUMNS)}) - 1 AS r FROM lineitem)"""


@_register(_ROWS + f""" SELECT l_orderkey AS doc_id, 1 AS page_no, 0 AS "table", CAST(r AS INTEGER) AS row_index, to_json([{', '.join(f'{c}::VARCHAR' for c in _COLUMNS)}])::VARCHAR AS cells FROM r""")
def file_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ruled tables of files, found from their lines."""
    files = writer.table_files(_read(spark, sf_dir, "lineitem"), "l_orderkey", _COLUMNS, _COLUMNS)
    found = _number(verbs.extract_tables(files))
    return found.select("doc_id", "page_no", "table", F.posexplode("rows").alias("row_index", "cells")).withColumn("cells", F.to_json("cells"))


@_register("SELECT l_orderkey AS doc_id, 1 AS page_no, true AS has_edges FROM lineitem GROUP BY 1")
def file_edge_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = writer.table_files(_read(spark, sf_dir, "lineitem"), "l_orderkey", _COLUMNS, _COLUMNS)
    return _number(reader.edge_pages(files)).select("doc_id", "page_no", "has_edges")


@_register(f"SELECT l_orderkey AS doc_id, COUNT(*) + {len(_COLUMNS)} + 2 AS shapes, CAST(SUM(0) AS BIGINT) AS curves FROM lineitem GROUP BY 1")
def file_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = writer.table_files(_read(spark, sf_dir, "lineitem"), "l_orderkey", _COLUMNS, _COLUMNS)
    return _number(reader.shapes(files, strict=True).groupBy("doc_id").agg(F.count("*").alias("shapes"), F.sum(F.when(F.col("object_type") == "curve", 1).otherwise(0)).alias("curves")))


# Search with positions


@_register(_words_sql() + _TEXT_LINES + """, pages AS (SELECT doc_id, page_no, string_agg(text, chr(10) ORDER BY line) AS t FROM text_lines GROUP BY ALL),
  m AS (SELECT doc_id, page_no, unnest(regexp_extract_all(t, '[0-9]+')) AS text, unnest(range(len(regexp_extract_all(t, '[0-9]+')))) AS match FROM pages)
  SELECT doc_id, page_no, CAST(match AS INTEGER) AS match, text, length(text) * 6.0::DOUBLE AS width, 10.0::DOUBLE AS height, CAST(length(text) AS INTEGER) AS chars FROM m""")
def search_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in page texts with the boxes and characters of each."""
    found = search.search(_page_chars(spark, sf_dir), "[0-9]+")
    return found.select("doc_id", "page_no", "match", "text", (F.col("x1") - F.col("x0")).alias("width"), (F.col("bottom") - F.col("top")).alias("height"), F.size("chars").alias("chars"))


@_register("""SELECT doc_id, string_split(text, chr(10))[-1] AS last_line, reverse(string_split(text, chr(10))[1]) AS first_reversed FROM documents WHERE text IS NOT NULL""")
def render_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").filter("text is not null")
    up, back = search.render(F.col("text"), "btt", "ltr"), search.render(F.col("text"), "ttb", "rtl")
    return docs.select("doc_id", F.element_at(F.split(up, "\n", -1), 1).alias("last_line"), F.element_at(F.split(back, "\n", -1), 1).alias("first_reversed"))


# Sinks


@_register(_words_sql() + " SELECT doc_id, page_no, COUNT(*) AS n FROM words GROUP BY ALL")
def hocr_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of hOCR pages, counted in what was written."""
    html = sinks.words_hocr(words.extract_words(_chars(spark, sf_dir)))
    return html.select("doc_id", "page_no", F.regexp_count("html", F.lit("class='ocrx_word'")).cast("long").alias("n"))


@_register(_BOXES_SQL + """ SELECT page_no, id, '{"id":' || id || ',"x0":' || round(x0, 1) || ',"x1":' || round(x1, 1) || '}' AS json, page_no || ',' || id || ',' || round(x0, 1) || ',' || round(x1, 1) AS line FROM boxes""")
def object_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _boxes(spark, sf_dir).select(F.col("page_no").alias("doc_id"), "page_no", F.col("id").alias("seq"), "id", "x0", "x1")
    made = sinks.objects_json(rows, include=["id", "x0", "x1"], precision=1).join(sinks.objects_csv(rows, exclude=["seq", "doc_id"], precision=1).drop("doc_id"), ["page_no", "seq"])
    return made.select("page_no", F.col("seq").alias("id"), "json", "line")


# Geometry


_PAIRS_SQL = _BOXES_SQL + ", pairs AS (SELECT a.id, a.x0, a.top, a.x1, a.bottom, b.x0 AS bx0, b.top AS btop, b.x1 AS bx1, b.bottom AS bbottom FROM boxes a JOIN boxes b ON b.id = a.id + 1)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _boxes(spark, sf_dir).select(*["id", "x0", "top", "x1", "bottom"])
    after = b.select((F.col("id") - 1).alias("id"), *[F.col(c).alias(f"b{c}") for c in ("x0", "top", "x1", "bottom")])
    return b.join(after, "id")


_OVER = "(LEAST(x1, bx1) >= GREATEST(x0, bx0))"


@_register(_PAIRS_SQL + f""" SELECT id, CASE WHEN {_OVER} THEN 0.0 ELSE LEAST(abs(x0 - bx1), abs(x1 - bx0)) END::DOUBLE AS distance, CASE WHEN {_OVER} THEN LEAST(abs(x0 - bx1), abs(x1 - bx0)) ELSE 0.0 END::DOUBLE AS overlap,
  ((GREATEST(x1, bx1) - LEAST(x0, bx0)) * (GREATEST(bottom, bbottom) - LEAST(top, btop)) - (x1 - x0) * (bottom - top) - (bx1 - bx0) * (bbottom - btop))::DOUBLE AS gap,
  ((GREATEST(x1, bx1) - LEAST(x0, bx0)) * (GREATEST(bottom, bbottom) - LEAST(top, btop)) - (x1 - x0) * (bottom - top))::DOUBLE AS expansion FROM pairs""")
def box_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, other = [F.col(c) for c in ("x0", "top", "x1", "bottom")], [F.col(f"b{c}") for c in ("x0", "top", "x1", "bottom")]
    return _pairs(spark, sf_dir).select(
        "id",
        geometry.axis_distance(own[0], own[2], other[0], other[2]).alias("distance"),
        geometry.axis_overlap(own[0], own[2], other[0], other[2]).alias("overlap"),
        geometry.axis_gap(own, other).alias("gap"),
        geometry.expansion(own, other).alias("expansion"),
    )


@_register(_PAIRS_SQL + """ SELECT id, x0 + 5 AS x0, x1 + 5 AS x1, top - 2 AS top, bottom + 1 AS bottom, bottom + 1 - (top - 2) AS height FROM pairs""")
def move_resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pairs(spark, sf_dir).withColumn("height", F.col("bottom") - F.col("top"))
    moved = geometry.move(geometry.move(rows, "h", 5), "v", -2)
    return geometry.resize(moved, "bottom", F.col("bottom") + 3).select("id", "x0", "x1", "top", "bottom", "height")


@_register(_PAIRS_SQL + """, c AS (SELECT *, GREATEST(bx0, x0) AS c0, GREATEST(btop, top) AS c1, LEAST(bx1, x1) AS c2, LEAST(bbottom, bottom) AS c3 FROM pairs)
  SELECT id, CASE WHEN c2 > c0 AND c3 > c1 THEN c0 ELSE x0 END AS x0, CASE WHEN c2 > c0 AND c3 > c1 THEN c3 ELSE bottom END AS bottom FROM c""")
def crop_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, other = [F.col(c) for c in ("x0", "top", "x1", "bottom")], [F.col(f"b{c}") for c in ("x0", "top", "x1", "bottom")]
    box = geometry.clamp_crop(other, own)
    return _pairs(spark, sf_dir).select("id", box[0].alias("x0"), box[3].alias("bottom"))


@_register("""SELECT o_orderkey AS id, 2.0::DOUBLE AS scale_x, sqrt(9.0)::DOUBLE AS scale_y, CAST(o_custkey % 100 AS DOUBLE) AS translation_x FROM orders""")
def matrix_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = geometry.scale_skew(geometry.matrix(2, 0, 0, 3, (F.col("o_custkey") % 100).cast("double"), 0))
    return _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), m["scale_x"].alias("scale_x"), m["scale_y"].alias("scale_y"), m["translation_x"].alias("translation_x"))


@_register(_BOXES_SQL + """ SELECT id, 800 - bottom AS y0, 800 - top AS y1, top + 5 AS shifted FROM boxes""")
def flip_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    flipped = layout.bottom_left(_boxes(spark, sf_dir), 800.0).withColumn("height", F.lit(800.0))
    back = geometry.to_top_left(flipped.drop("top", "bottom"), y_shift=5.0)
    return back.select("id", "y0", "y1", F.col("top").alias("shifted"))


# Tables with gaps, offsets, short edges and several tables a page

_JITTER = """WITH n AS (SELECT l_orderkey AS doc_id, LEAST(COUNT(*), 6) AS n FROM lineitem GROUP BY 1)"""


@_register(_JITTER + """, t AS (SELECT doc_id, n, CAST(unnest(range(2)) AS INTEGER) AS "table" FROM n) SELECT doc_id, "table", n * 3 AS cells, "table" * 400.0::DOUBLE AS top, 180.0::DOUBLE AS width FROM t""")
def jittered_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables a page (one above the other), whose lines are off by up to 1, cut by gaps of 2, with short strays between; snapped, joined and filtered they are whole."""
    sizes = _read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.least(F.count("*"), F.lit(6)).alias("n"))
    two = sizes.withColumn("t", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("y", F.col("t") * 400.0)
    tall = F.col("n") * 20.0
    h = two.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n")))).select("doc_id", F.lit("h").alias("orientation"), F.explode(F.array(F.struct(F.lit(0.0).alias("a"), F.lit(90.0).alias("b"), F.lit(0.5).alias("d")), F.struct(F.lit(92.0).alias("a"), F.lit(180.0).alias("b"), F.lit(-0.5).alias("d")))).alias("p"), (F.col("y") + F.col("k") * 20.0).alias("c"))
    h = h.select("doc_id", "orientation", F.col("p.a").alias("x0"), F.col("p.b").alias("x1"), (F.col("c") + F.col("p.d")).alias("top"), (F.col("c") + F.col("p.d")).alias("bottom"))
    v = two.withColumn("k", F.explode(F.array(*[F.lit(x) for x in range(4)]))).select("doc_id", F.lit("v").alias("orientation"), (F.col("k") * 60.0).alias("x0"), (F.col("k") * 60.0).alias("x1"), F.col("y").alias("top"), (F.col("y") + tall).alias("bottom"))
    stray = two.select("doc_id", F.lit("v").alias("orientation"), F.lit(30.0).alias("x0"), F.lit(30.0).alias("x1"), (F.col("y") + 5).alias("top"), (F.col("y") + 7).alias("bottom"))
    edges = h.unionByName(v).unionByName(stray).select("doc_id", F.lit(1).alias("page_no"), F.lit("line").alias("object_type"), "orientation", "x0", "top", "x1", "bottom", (F.col("x1") - F.col("x0")).alias("width"), (F.col("bottom") - F.col("top")).alias("height"))
    found = tables.table_boxes(tables.find_tables(edges))
    return found.select("doc_id", "table", "cells", F.round("top").alias("top"), (F.col("x1") - F.col("x0")).alias("width"))


@_register(_JITTER + " SELECT doc_id, n * 3 AS cells FROM n")
def largest_of_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a large and a small table the large one; the page also has a smaller one above it."""
    sizes = _read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.least(F.count("*"), F.lit(6)).alias("n"))

    def grid(rows: Column, columns: int, y: float) -> DataFrame:
        size = sizes.withColumn("r", rows)
        cell = size.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("r") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
        x, top = F.col("j") * 50.0, F.lit(y) + F.col("i") * 20.0
        return cell.select("doc_id", F.lit(1).alias("page_no"), F.lit(0).cast("long").alias("seq"), x.alias("x0"), top.alias("top"), (x + 50).alias("x1"), (top + 20).alias("bottom"))

    rects = grid(F.lit(1).cast("long"), 2, 0.0).unionByName(grid(F.col("n"), 3, 100.0))
    return tables.largest_table(tables.find_tables(geometry.rect_edges(rects))).select("doc_id", "cells")


# Scalars


@_register(r"""SELECT o_orderkey, regexp_matches(o_orderpriority, '^[0-9]+$') AS digits, CAST(floor(o_totalprice) AS BIGINT) AS whole, o_orderkey * 65536 + 255 AS unpacked,
  CASE WHEN o_orderkey % 4 = 0 THEN 'D:' || 2000 + o_orderkey % 30 ELSE NULL END AS raw, CASE WHEN o_orderkey % 4 = 0 THEN CAST(2000 + o_orderkey % 30 AS VARCHAR) ELSE NULL END AS year FROM orders""")
def scalar_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    raw = F.when(k % 4 == 0, F.concat(F.lit("D:"), (k % 30 + 2000).cast("string")))
    packed = F.unhex(F.lpad(F.hex(k * 65536 + 255), 14, "0"))
    return _read(spark, sf_dir, "orders").select("o_orderkey", T.is_number(F.col("o_orderpriority")).alias("digits"), T.whole_number(F.col("o_totalprice").cast("string")).alias("whole"), T.big_endian(packed).alias("unpacked"), raw.alias("raw"), T.date_to_iso(raw).alias("year"))


@_register(_BOXES_SQL + """ SELECT id, printf('%.3f,%.3f,%.3f,%.3f', x0, top, x1, bottom) AS box, printf('%.3f,%.3f,%.3f,%.3f', x0, top, x1, bottom) AS points, printf('[%.2f,%.2f,%.2f,%.2f, (%.2f,%.2f)]', 1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE, x0, top) AS matrix FROM boxes""")
def shape_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return _boxes(spark, sf_dir).select(
        "id",
        T.box_text(*[F.col(c) for c in ("x0", "top", "x1", "bottom")]).alias("box"),
        T.points_text(F.array(p("x0", "top"), p("x1", "bottom"))).alias("points"),
        T.matrix_text(geometry.matrix(1, 0, 0, 1, F.col("x0"), F.col("top"))).alias("matrix"),
    )


@_register("""SELECT o_custkey AS k, CAST(count(*) AS BIGINT) AS n, CAST(ceil(count(*) / 3.0) AS INTEGER) AS parts FROM orders GROUP BY 1""")
def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A group's rows in arrays of three."""
    got = _read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.collect_list("o_orderkey").alias("v"))
    return got.select("k", F.size("v").cast("long").alias("n"), F.size(T.chunks(F.col("v"), 3)).alias("parts"))


# Words in other directions


@_register(_words_sql() + " SELECT doc_id, page_no, reverse(text) AS text, -x1 AS x0, -x0 AS x1, top FROM words")
def words_right_to_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages seen in a mirror, read from the right, have the words as they were; read from the left, they have them reversed."""
    seen = _page_chars(spark, sf_dir).moved(lambda c: {**c, "x0": -c["x1"], "x1": -c["x0"]})
    return words.extract_words(seen).select("doc_id", "page_no", "text", "x0", "x1", "top")


@_register(_words_sql() + " SELECT doc_id, page_no, text, x0 AS top, x1 AS bottom, top AS x0 FROM words")
def words_top_to_bottom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with their axes changed: lines are columns from the left, characters run down."""
    seen = _page_chars(spark, sf_dir).moved(lambda c: {**c, "x0": c["top"], "x1": c["bottom"], "top": c["x0"], "bottom": c["x1"]})
    settings = words.TextSettings(line_dir="ltr", char_dir="ttb")
    return words.extract_words(seen, settings).select("doc_id", "page_no", "text", "top", "bottom", "x0")


@_register(_words_sql() + " SELECT doc_id, page_no, CAST(ROW_NUMBER() OVER (PARTITION BY doc_id, page_no ORDER BY line, k) - 1 AS INTEGER) AS word, text FROM words")
def words_of_uneven_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters that stand up to one unit off their line still make the same words in the same order."""
    seen = _page_chars(spark, sf_dir).moved(lambda c: {**c, "top": c["top"] + (c["seq"] % 3 - 1), "bottom": c["bottom"] + (c["seq"] % 3 - 1)})
    return words.extract_words(seen).select("doc_id", "page_no", "word", "text")


# Sets of rows and boxes


@_register("""SELECT o_custkey AS k, floor(o_totalprice / 10000) AS v, MIN(o_orderkey) AS first FROM orders GROUP BY ALL""")
def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.floor(F.col("o_totalprice") / 10000).cast("double").alias("v"), F.col("o_orderkey").alias("first"))
    return sets.ordered_distinct(rows, ["v"], ["k"], ["first"])


@_register("""SELECT o_custkey AS k, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS id, MIN(o_totalprice) AS price FROM orders GROUP BY 1""")
def pick_least(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    return sets.pick_least(rows, ["k"], ["price", "id"])


@_register("""SELECT o_orderstatus = 'F' AS yes, COUNT(*) AS n FROM orders GROUP BY 1""")
def split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    yes, no = sets.split(_read(spark, sf_dir, "orders"), F.col("o_orderstatus") == "F")
    count = lambda df, flag: df.groupBy(F.lit(flag).alias("yes")).agg(F.count("*").alias("n"))
    return count(yes, True).unionByName(count(no, False))


@_register(_BOXES_SQL + """, kept AS (SELECT * FROM boxes WHERE id % 5 <> 0 UNION ALL SELECT id + 1000000000, page_no, x0 + 1, top + 1, x1 + 1, bottom + 1 FROM boxes WHERE id % 50 = 0)
  SELECT DISTINCT a.page_no, a.id FROM boxes a JOIN kept b ON a.page_no = b.page_no AND a.id <> b.id WHERE a.id % 7 = 0 AND LEAST(a.x1, b.x1) > GREATEST(a.x0, b.x0) AND LEAST(a.bottom, b.bottom) > GREATEST(a.top, b.top)""")
def box_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes with some removed and some added; which of the asked ones have another in them."""
    every = _boxes(spark, sf_dir)
    added = every.filter("id % 50 = 0").select((F.col("id") + 1_000_000_000).alias("id"), "page_no", *[(F.col(c) + 1).alias(c) for c in ("x0", "top", "x1", "bottom")])
    index = sets.BoxIndex(every, ["page_no"], "id").remove(every.filter("id % 5 = 0")).extend(added)
    return index.any(every.filter("id % 7 = 0"))


# What files say of themselves: a file for each part, with one to three pages

_PARTS = "WITH parts AS (SELECT p_partkey AS doc_id, p_partkey % 3 + 1 AS n FROM part), pages AS (SELECT doc_id, n, CAST(unnest(range(n)) AS INTEGER) AS i FROM parts)"


def _rich(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writer.rich_files(_read(spark, sf_dir, "part"), "p_partkey", F.col("p_partkey") % 3 + 1)


@_register(_PARTS + """ SELECT doc_id, 0 AS position, 1 AS level, 'Part ' || doc_id AS title, NULL::VARCHAR AS dest, NULL::INTEGER AS page_no FROM parts
  UNION ALL SELECT doc_id, i + 1, 2, 'Page ' || (i + 1), 'p' || i, i + 1 FROM pages""")
def file_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _number(reader.outline(_rich(spark, sf_dir), strict=True)).select("doc_id", "position", "level", "title", "dest", "page_no")


@_register(_PARTS + " SELECT doc_id, 'p' || i AS name, i + 1 AS page_no FROM pages")
def file_destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _number(reader.named_destinations(_rich(spark, sf_dir), strict=True)).select("doc_id", "name", "page_no")


@_register(_PARTS + " SELECT doc_id, doc_id || '.txt' AS name, 'attached to ' || doc_id AS data FROM parts")
def file_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _number(reader.embedded_files(_rich(spark, sf_dir), strict=True)).select("doc_id", "name", F.col("data").cast("string").alias("data"))


@_register(_PARTS + """ SELECT doc_id, i + 1 AS page_no, 'http://example.org/' || doc_id || '/' || i AS uri, 'tip ' || i AS title,
  (CASE doc_id % 4 WHEN 0 THEN 10 WHEN 1 THEN 20 WHEN 2 THEN 140 ELSE 60 END)::DOUBLE AS x0, (CASE doc_id % 4 WHEN 0 THEN 60 WHEN 1 THEN 10 WHEN 2 THEN 20 ELSE 140 END)::DOUBLE AS top FROM pages""")
def file_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, turned with their pages."""
    return _number(reader.hyperlinks(_rich(spark, sf_dir), strict=True)).select("doc_id", "page_no", "uri", "title", "x0", "top")


@_register(_PARTS + """ SELECT doc_id, 0 AS id, NULL::INTEGER AS parent, 'Document' AS type, NULL::INTEGER AS page_no, NULL::VARCHAR AS actual_text, 0 AS marks FROM parts
  UNION ALL SELECT doc_id, i + 1, 0, 'P', i + 1, 'text ' || i, 1 FROM pages""")
def file_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _number(reader.structure(_rich(spark, sf_dir), strict=True)).select("doc_id", "id", "parent", "type", "page_no", "actual_text", F.size("mcids").alias("marks"))


@_register(_PARTS + """ SELECT doc_id, i + 1 AS id, i + 1 AS page_no, 'part ' || doc_id || ' page ' || i AS text FROM pages UNION ALL SELECT doc_id, 0, i + 1, 'part ' || doc_id || ' page ' || i FROM pages""")
def file_element_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of structure elements by their marked contents; those of the root by what is below it."""
    files = _rich(spark, sf_dir)
    return _number(reader.element_boxes(reader.structure(files), reader.chars(files))).select("doc_id", "id", "page_no", "text")


@_register(_PARTS + " SELECT doc_id, i + 1 AS page_no, 0 AS mcid, 'part ' || doc_id || ' page ' || i AS text FROM pages")
def file_mcid_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _number(reader.mcid_text(reader.chars(_rich(spark, sf_dir)))).select("doc_id", "page_no", "mcid", "text")


@_register(_PARTS + " SELECT doc_id, '<P MCID=\"0\">part ' || doc_id || ' page 0</P>' AS first, n AS pages FROM parts")
def file_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tagged sink's first element, and its pages."""
    xml = verbs.extract_text_to(_rich(spark, sf_dir), "tag")
    return _number(xml).select("doc_id", F.regexp_extract("xml", "<P [^>]*>[^<]*</P>", 0).alias("first"), F.regexp_count("xml", F.lit("</page>")).cast("long").alias("pages"))


@_register(_PARTS + " SELECT doc_id, i + 1 AS page_no, CASE WHEN i = 0 THEN 'i' ELSE 'A-' || (4 + i) END AS page_label FROM pages")
def file_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _rich(spark, sf_dir)
    return _number(pages.with_labels(reader.pages(files).select("doc_id", "page_no"), reader.page_labels(files))).select("doc_id", "page_no", "page_label")


@_register(_PARTS + """ SELECT doc_id, i + 1 AS page_no, 'Im' AS name, 2 AS pixel_width, 2 AS pixel_height, 8 AS bits, (CASE doc_id % 4 WHEN 0 THEN 100 WHEN 1 THEN 40 WHEN 2 THEN 80 ELSE 50 END)::DOUBLE AS x0,
  (CASE WHEN doc_id % 2 = 0 THEN 20 ELSE 10 END)::DOUBLE AS width FROM pages""")
def file_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _number(reader.images(_rich(spark, sf_dir), strict=True))
    return got.select("doc_id", "page_no", "name", "pixel_width", "pixel_height", "bits", "x0", (F.col("x1") - F.col("x0")).alias("width"))


@_register(_PARTS + """ SELECT doc_id, 'page-000' || (i + 1) || '-Im_1.bmp' AS name, 54 + 1024 + 8 AS size, upper(printf('FF800000%02x000000', doc_id % 256)) AS tail FROM pages""")
def file_image_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images as bitmap files: their names, sizes and rows (from the bottom, filled up to four bytes)."""
    got = _number(reader.image_files(_rich(spark, sf_dir), strict=True))
    return got.select("doc_id", "name", F.length("data").alias("size"), F.hex(F.substring("data", -8, 8)).alias("tail"))


@_register(_PARTS + """ SELECT doc_id, i + 1 AS page_no, 'Fm' AS name, (CASE WHEN doc_id % 2 = 0 THEN 30 ELSE 10 END)::DOUBLE AS width, 1 AS lines FROM pages""")
def file_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms, and the lines that they draw."""
    got = _number(reader.figures(_rich(spark, sf_dir), strict=True, counts=True)).filter("page_shapes > 0")
    return got.select("doc_id", "page_no", "name", (F.col("x1") - F.col("x0")).alias("width"), F.col("page_shapes").alias("lines"))


@_register(_PARTS + """ SELECT doc_id, '1.6' AS version, 'part ' || doc_id AS title, '<x:xmpmeta>' || doc_id || '</x:xmpmeta>' AS xmp, true AS tagged, false AS encrypted, CAST(n AS INTEGER) AS declared_pages FROM parts""")
def file_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _number(reader.documents(_rich(spark, sf_dir)))
    return got.select("doc_id", "version", F.col("info")["Title"].alias("title"), "xmp", "tagged", "encrypted", "declared_pages")


@_register(_PARTS + " SELECT doc_id, n * 5 + 13 AS objects, 1 AS trailers FROM parts")
def file_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _number(reader.objects(_rich(spark, sf_dir), "text"))
    return got.groupBy("doc_id").agg(F.sum(F.when(F.col("number") > 0, 1).otherwise(0)).alias("objects"), F.max(F.when(F.col("number") == 0, 1)).alias("trailers"))


@_register(_PARTS + " SELECT doc_id, i + 1 AS page_no, NULL::VARCHAR AS error FROM pages WHERE 1 = 0")
def file_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No file and no page fails."""
    return _number(reader.errors(_rich(spark, sf_dir))).select("doc_id", "page_no", "error")


@_register(_PARTS + " SELECT doc_id, i + 1 AS page_no, length('part ' || doc_id || ' page ' || i) AS char_count, 1 AS shape_count, 1 AS image_count FROM pages")
def file_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _number(verbs.Document(_rich(spark, sf_dir)).summaries())
    return got.select("doc_id", "page_no", *[F.col(c).cast("long").alias(c) for c in ("char_count", "shape_count", "image_count")])


@_register(_PARTS + " SELECT doc_id, 'part ' || doc_id AS title, n AS pages, length('part ' || doc_id || ' page 0') AS chars FROM parts")
def file_dicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as nested structs."""
    got = _number(verbs.Document(_rich(spark, sf_dir)).to_dict())
    return got.select("doc_id", F.col("metadata")["Title"].alias("title"), F.size("pages").cast("long").alias("pages"), F.size(F.element_at("pages", 1)["chars"]).cast("long").alias("chars"))


@_register(_PARTS + " SELECT doc_id, n AS pages, n AS images, n AS lines, length(string_agg(CASE WHEN doc_id % 2 = 0 THEN 'part ' || doc_id || ' page ' || i ELSE 'part' || doc_id || 'page' || i END, '')) AS texts FROM pages GROUP BY doc_id, n")
def file_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, images, lines and characters counted in the XML sink's documents; on pages turned sideways each character is a line of its own, and blank lines are in no box."""
    xml = _number(verbs.extract_text_to(_rich(spark, sf_dir), "xml"))
    count = lambda p: F.regexp_count("xml", F.lit(p)).cast("long")
    return xml.select("doc_id", count("</page>").alias("pages"), count("<image ").alias("images"), count("<line ").alias("lines"), count("<text font=").alias("texts"))


@_register(_PARTS + " SELECT doc_id, n AS pages, n AS spans FROM parts WHERE doc_id % 4 = 0 UNION ALL SELECT doc_id, n, n FROM parts WHERE doc_id % 4 = 2")
def file_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and runs of one font in the HTML sink's documents, of pages whose lines run level."""
    level = writer.rich_files(_read(spark, sf_dir, "part").filter("p_partkey % 2 = 0"), "p_partkey", F.col("p_partkey") % 3 + 1)
    html = _number(verbs.extract_text_to(level, "html"))
    return html.select("doc_id", F.regexp_count("html", F.lit("<a name=")).cast("long").alias("pages"), F.regexp_count("html", F.lit("font-family:Courier")).cast("long").alias("spans"))


# Right-to-left text: names in Hebrew letters, one for each Latin one

_LATIN, _HEBREW = "abcdefghijklmnopqrstuvwxyz", "".join(chr(0x5D0 + i) for i in range(26))
_HEBREW_SQL = f"WITH names AS (SELECT p_partkey, translate(trim(regexp_replace(lower(p_name), '[^a-z ]+', ' ', 'g')), '{_LATIN}', '{_HEBREW}') AS t FROM part WHERE p_name IS NOT NULL)"


def _hebrew(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = F.trim(F.regexp_replace(F.lower("p_name"), "[^a-z ]+", " "))
    return _read(spark, sf_dir, "part").filter("p_name is not null").select("p_partkey", F.translate(plain, _LATIN, _HEBREW).alias("t"))


@_register(_HEBREW_SQL + " SELECT p_partkey, t AS logical, reverse(t) AS visual, t <> '' AS rtl FROM names")
def rtl_reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands from right to left comes back in order, and goes there again."""
    names = _hebrew(spark, sf_dir)
    return names.select("p_partkey", bidi.reconstructed(F.reverse("t")).alias("logical"), bidi.reordered(F.col("t")).alias("visual"), bidi.contains_rtl(F.col("t")).alias("rtl"))


@_register(_HEBREW_SQL + """ SELECT p_partkey, list_transform(range(2 + len(string_split(t, ' '))), lambda i: CAST(1 + len(string_split(t, ' ')) - i AS INTEGER))::VARCHAR AS places FROM names WHERE t <> ''""")
def rtl_word_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two left-to-right words before the name's: runs come from the right, the left-to-right run keeps its order, the other is turned."""
    names = _hebrew(spark, sf_dir).filter("t <> ''")
    words_ = F.concat(F.split("t", " "), F.array(F.lit("12"), F.lit("34")))
    turned = bidi.word_order(words_)
    n = F.size(F.split("t", " "))
    # neutral words keep their order: put that run last to first, so that the whole is one count down
    shown = F.concat(F.reverse(F.slice(turned, 1, 2)), F.slice(turned, F.lit(3), n))
    return names.select("p_partkey", F.concat(F.lit("["), F.array_join(shown, ", "), F.lit("]")).alias("places"))


@_register("SELECT p_partkey, p_name AS name, CAST(length(p_name) AS INTEGER) AS n FROM part WHERE p_name IS NOT NULL")
def font_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.encode(F.concat(F.lit("ABCDEF+"), F.col("p_name")), "UTF-8")
    return _read(spark, sf_dir, "part").filter("p_name is not null").select("p_partkey", T.fixed_fontname(raw).alias("name"), F.length(T.compatible_text(F.encode(F.col("p_name"), "UTF-8"))).alias("n"))


@_register("SELECT o_orderkey, CAST(floor(o_totalprice / 1000) AS BIGINT) % 7 AS x, CAST(floor(o_totalprice / 1000) AS BIGINT) % 7 + 1 AS place, true AS near FROM orders")
def sorted_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.floor(F.col("o_totalprice") / 1000) % 7
    values = F.array(*[F.lit(i).cast("long") for i in range(7)])
    return _read(spark, sf_dir, "orders").select("o_orderkey", x.alias("x"), T.upper_bound(values, x).cast("long").alias("place"), T.nearly(x + 1e-12, x.cast("double")).alias("near"))


@_register(_BOXES_SQL + " SELECT id FROM boxes WHERE x1 - x0 > bottom - top")
def filter_callback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python predicate on rows."""
    return sets.filter_objects(_boxes(spark, sf_dir), lambda r: r["x1"] - r["x0"] > r["bottom"] - r["top"]).select("id")


@_register(_BOXES_SQL + """, t AS (SELECT DISTINCT page_no FROM boxes) SELECT id, page_no, 2.0::DOUBLE * page_no AS wide FROM boxes""")
def page_geometries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page with the one box given for it."""
    b = _boxes(spark, sf_dir).withColumn("doc_id", F.lit(1))
    frames = b.select("doc_id", "page_no").distinct().select("doc_id", "page_no", F.lit(0.0).alias("x0"), F.lit(0.0).alias("top"), (F.col("page_no") * 2.0).alias("x1"), F.lit(9.0).alias("bottom"))
    return geometry.with_geometries(b.select("doc_id", "page_no", "id"), frames).select("id", "page_no", F.col("geometry")["x1"].alias("wide"))


@_register(_GRID + f" SELECT doc_id, CAST(n * {len(_COLUMNS)} AS BIGINT) AS cells FROM n WHERE n > 2")
def tables_in_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables that reach more than two rows down, by a crop that begins there."""
    edges, _ = _ruled(spark, sf_dir)
    kept = tables.retain_tables(tables.find_tables(edges), (0.0, 32.0, 1000.0, 100000.0))
    return kept.groupBy("doc_id").agg(F.count("*").alias("cells"))
