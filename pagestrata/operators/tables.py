"""Tables from edges: intersections, cells, connected tables, grids, spans."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import page_arrays
from .cluster import cluster_1d, merge_edges
from .geometry import EDGE, filter_edges
from .words import PAGE, TextSettings, extract_text

STRATEGIES = ("lines", "lines_strict", "text", "explicit")


@dataclass(frozen=True)
class TableSettings:
    vertical_strategy: str = "lines"
    horizontal_strategy: str = "lines"
    snap_x_tolerance: float = 3.0
    snap_y_tolerance: float = 3.0
    join_x_tolerance: float = 3.0
    join_y_tolerance: float = 3.0
    edge_min_length: float = 3.0
    edge_min_length_prefilter: float = 1.0
    min_words_vertical: int = 3
    min_words_horizontal: int = 1
    intersection_x_tolerance: float = 3.0
    intersection_y_tolerance: float = 3.0
    text: TextSettings = TextSettings()

    def __post_init__(self) -> None:
        for s in (self.vertical_strategy, self.horizontal_strategy):
            if s not in STRATEGIES:
                raise ValueError(f"no such strategy: {s}")
        for name, value in vars(self).items():
            if isinstance(value, (int, float)) and value < 0:
                raise ValueError(f"{name} is negative")

    @classmethod
    def resolve(cls, options: dict | None) -> TableSettings:
        """From a flat dict: snap_tolerance and the like set both axes unless an axis has its own; text_* go to the text settings."""
        options = dict(options or {})
        for name in ("snap", "join", "intersection"):
            both = options.pop(f"{name}_tolerance", None)
            if both is not None:
                options.setdefault(f"{name}_x_tolerance", both)
                options.setdefault(f"{name}_y_tolerance", both)
        text = dict(options.pop("text_settings", None) or {})
        text |= {k[5:]: options.pop(k) for k in [k for k in options if k.startswith("text_")]}
        both = text.pop("tolerance", None)
        if both is not None:
            text.setdefault("x_tolerance", both)
            text.setdefault("y_tolerance", both)
        unknown = set(options) - {f for f in cls.__dataclass_fields__ if f != "text"}
        if unknown:
            raise TypeError(f"no such table settings: {sorted(unknown)}")
        return replace(cls(**options), text=TextSettings(**text))


def words_to_edges_h(words: DataFrame | page_arrays.PageChars, least: int = 1) -> DataFrame:
    """Two edges, at the top and at the bottom, of each cluster of tops (tolerance 1) with enough words; all as wide as the widest.

    Pages of characters give the edges of their words.
    """
    if isinstance(words, page_arrays.PageChars):
        return page_arrays.word_edges_h(words, least, TextSettings())
    rows = cluster_1d(words, PAGE, F.col("top"), 1.0, "_c").groupBy(*PAGE, "_c").agg(F.count("*").alias("_n"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("top").alias("top"), F.max("bottom").alias("bottom")).filter(F.col("_n") >= least)
    page = Window.partitionBy(*PAGE)
    rows = rows.withColumn("x0", F.min("x0").over(page)).withColumn("x1", F.max("x1").over(page))
    return rows.select(*PAGE, F.lit("word_edge").alias("object_type"), F.lit("h").alias("orientation"), "x0", "x1", F.explode(F.array("top", "bottom")).alias("top")).select(*PAGE, "object_type", "orientation", "x0", "top", "x1", F.col("top").alias("bottom"), (F.col("x1") - F.col("x0")).alias("width"), F.lit(0.0).alias("height"))


def words_to_edges_v(words: DataFrame, least: int = 3) -> DataFrame:
    """Edges at the left of columns of words that share a left, right or centre, and one at the right of all.

    Clusters are taken largest first; one that overlaps an accepted one is left
    out. That is a fold over a page's clusters, which are few.
    """
    parts = None
    for k, value in enumerate((F.col("x0"), F.col("x1"), (F.col("x0") + F.col("x1")) / 2)):
        found = cluster_1d(words, PAGE, value, 1.0, "_c").groupBy(*PAGE, "_c").agg(F.count("*").alias("n"), F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom")).filter(F.col("n") >= least).withColumn("kind", F.lit(k))
        parts = found if parts is None else parts.unionByName(found)
    ranked = parts.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("rank"), "kind", "_c", "x0", "top", "x1", "bottom"))).alias("all"))
    meets = lambda a, b: (F.least(a["x1"], b["x1"]) >= F.greatest(a["x0"], b["x0"])) & (F.least(a["bottom"], b["bottom"]) >= F.greatest(a["top"], b["top"])) & ((F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])) + (F.least(a["bottom"], b["bottom"]) - F.greatest(a["top"], b["top"])) > 0)
    none = F.slice("all", 1, 0)
    kept = F.aggregate("all", none, lambda acc, c: F.when(F.exists(acc, lambda x: meets(x, c)), acc).otherwise(F.concat(acc, F.array(c))))
    rows = ranked.withColumn("kept", kept)
    edge_at = F.array_distinct(F.concat(F.transform("kept", lambda c: c["x0"]), F.array(F.array_max(F.transform("kept", lambda c: c["x1"])))))
    top, bottom = F.array_min(F.transform("kept", lambda c: c["top"])), F.array_max(F.transform("kept", lambda c: c["bottom"]))
    return rows.select(*PAGE, F.explode(edge_at).alias("x0"), top.alias("top"), bottom.alias("bottom")).select(*PAGE, F.lit("word_edge").alias("object_type"), F.lit("v").alias("orientation"), "x0", "top", F.col("x0").alias("x1"), "bottom", F.lit(0.0).alias("width"), (F.col("bottom") - F.col("top")).alias("height"))


def table_edges(edges: DataFrame, settings: TableSettings | None = None, words: DataFrame | None = None, explicit: DataFrame | None = None) -> DataFrame:
    """The edges that a table is made of, by strategy, snapped, joined and long enough. Explicit edges count under every strategy."""
    s = settings or TableSettings()
    slim = edges.select(*PAGE, *EDGE)
    out = slim.limit(0)
    sides = [("v", s.vertical_strategy), ("h", s.horizontal_strategy)]
    if s.vertical_strategy == s.horizontal_strategy and s.vertical_strategy in ("lines", "lines_strict"):  # one pass serves both
        out, sides = filter_edges(slim, None, "line" if s.vertical_strategy == "lines_strict" else None, s.edge_min_length_prefilter).filter(F.col("orientation").isNotNull()), []
    for turn, strategy in sides:
        if strategy == "text":
            if words is None:
                raise ValueError("the text strategy needs words")
            got = words_to_edges_v(words, s.min_words_vertical) if turn == "v" else words_to_edges_h(words, s.min_words_horizontal)
        elif strategy == "explicit":
            if explicit is None:
                raise ValueError("the explicit strategy needs edges")
            got = slim.limit(0)
        else:
            got = filter_edges(slim, turn, "line" if strategy == "lines_strict" else None, s.edge_min_length_prefilter)
        out = out.unionByName(got.select(*PAGE, *EDGE))
    if explicit is not None:
        out = out.unionByName(explicit.select(*PAGE, *EDGE))
    merged = merge_edges(out, PAGE, s.snap_x_tolerance, s.snap_y_tolerance, s.join_x_tolerance, s.join_y_tolerance)
    return filter_edges(merged, min_length=s.edge_min_length)


def intersections(edges: DataFrame, x_tolerance: float = 3.0, y_tolerance: float = 3.0) -> DataFrame:
    """(x, top) and the two edges (v, h as structs of their boxes) of each crossing, within tolerances at the ends.

    A page's edges meet in one equi-join by page; the rest is its condition.
    """
    box = F.struct("x0", "top", "x1", "bottom")
    distinct = edges.select(*PAGE, "orientation", box.alias("e")).distinct()
    v = distinct.filter("orientation = 'v'").select(*PAGE, F.col("e").alias("v"))
    h = distinct.filter("orientation = 'h'").select(*PAGE, F.col("e").alias("h"))
    near = (
        (F.col("v.top") <= F.col("h.top") + y_tolerance)
        & (F.col("v.bottom") >= F.col("h.top") - y_tolerance)
        & (F.col("v.x0") >= F.col("h.x0") - x_tolerance)
        & (F.col("v.x0") <= F.col("h.x1") + x_tolerance)
    )
    return v.join(h, PAGE).filter(near).select(*PAGE, F.col("v.x0").alias("x"), F.col("h.top").alias("top"), "v", "h")


def cells(crossings: DataFrame) -> DataFrame:
    """One cell at most for each crossing as its upper left corner: the nearest below, then to the right, whose sides are edges."""
    pv = crossings.select(*PAGE, "x", "top", "v").distinct()
    ph = crossings.select(*PAGE, "x", "top", "h").distinct()
    down = pv.alias("a").join(pv.alias("b"), [*[F.col(f"a.{c}") == F.col(f"b.{c}") for c in PAGE], F.col("a.x") == F.col("b.x"), F.col("a.v") == F.col("b.v")]).filter("b.top > a.top")
    down = down.select(*[F.col(f"a.{c}") for c in PAGE], F.col("a.x").alias("x"), F.col("a.top").alias("top"), F.col("b.top").alias("bottom")).distinct()
    right = ph.alias("a").join(ph.alias("b"), [*[F.col(f"a.{c}") == F.col(f"b.{c}") for c in PAGE], F.col("a.top") == F.col("b.top"), F.col("a.h") == F.col("b.h")]).filter("b.x > a.x")
    right = right.select(*[F.col(f"a.{c}") for c in PAGE], F.col("a.x").alias("x"), F.col("a.top").alias("top"), F.col("b.x").alias("x1")).distinct()
    both = down.join(right, [*PAGE, "x", "top"])
    far_side = down.select(*PAGE, F.col("x").alias("x1"), "top", "bottom")
    low_side = right.select(*PAGE, "x", F.col("top").alias("bottom"), "x1")
    whole = both.join(far_side, [*PAGE, "x1", "top", "bottom"]).join(low_side, [*PAGE, "x", "bottom", "x1"])
    first = Window.partitionBy(*PAGE, "x", "top").orderBy("bottom", "x1")
    return whole.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select(*PAGE, F.col("x").alias("x0"), "top", "x1", "bottom")


def _numbered(boxes: list[tuple[float, float, float, float]]) -> list[tuple[int, float, float, float, float]]:
    """(table, box) of cells that share corners, by union-find; tables of one cell are left out, the rest ordered by (top, x0)."""
    boxes = sorted(boxes, key=lambda c: (c[1], c[0]))
    parent = list(range(len(boxes)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    at: dict[tuple[float, float], int] = {}
    for i, (x0, top, x1, bottom) in enumerate(boxes):
        for corner in ((x0, top), (x0, bottom), (x1, top), (x1, bottom)):
            a, b = find(at.setdefault(corner, i)), find(i)
            parent[max(a, b)] = min(a, b)
    members: dict[int, list[int]] = {}
    for i in range(len(boxes)):
        members.setdefault(find(i), []).append(i)
    kept = [m for _, m in sorted(members.items()) if len(m) > 1]
    return [(k, *boxes[i]) for k, m in enumerate(kept) for i in m]


def _page_cells(v: list[tuple], h: list[tuple], xt: float, yt: float) -> list[tuple[float, float, float, float]]:
    """The same cells as ``cells(intersections(...))`` for one page's edges."""
    v, h = sorted(set(v)), sorted(set(h), key=lambda e: (e[1], e[0], e[2]))
    tops = [e[1] for e in h]
    points: dict[tuple[float, float], tuple[set[int], set[int]]] = {}
    for i, (x, top, _, bottom) in enumerate(v):
        for j in range(bisect_left(tops, top - yt), bisect_right(tops, bottom + yt)):
            if h[j][0] - xt <= x <= h[j][2] + xt:
                mine = points.setdefault((x, h[j][1]), (set(), set()))
                mine[0].add(i)
                mine[1].add(j)
    columns: dict[float, list[float]] = {}
    rows: dict[float, list[float]] = {}
    for x, y in sorted(points):
        columns.setdefault(x, []).append(y)
        rows.setdefault(y, []).append(x)
    found = []
    for (x, y), (pv, ph) in points.items():
        below, right = columns[x], rows[y]
        rights = [r for r in right[bisect_right(right, x) :] if points[r, y][1] & ph]
        cell = next(
            (
                (x, y, r, d)
                for d in below[bisect_right(below, y) :]
                if points[x, d][0] & pv
                for r in rights
                if (r, d) in points and points[r, d][1] & points[x, d][1] and points[r, d][0] & points[r, y][0]
            ),
            None,
        )
        if cell:
            found.append(cell)
    return found


def _by_page(df: DataFrame, solve, kinds: str) -> DataFrame:
    """Rows (page, orientation, x0, top, x1, bottom), one page after the other, through ``solve(rows)``; one shuffle, one page in memory."""
    key = df.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {key}, page_no int, {kinds}"

    def run(batches):
        import pyarrow as pa

        names = [k.split()[0] for k in schema.split(", ")]
        page, held, out = None, [], []

        def close():
            out.extend((*page, *r) for r in solve(held))

        def batch_of(rows):
            kind = {"int": pa.int32(), "long": pa.int64(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, kind[k.split()[1]]) for c, k in zip(columns, schema.split(", "), strict=True)], names=names)

        for batch in batches:
            for d, p, *row in zip(*(batch[c].to_pylist() for c in ("doc_id", "page_no", "orientation", "x0", "top", "x1", "bottom")), strict=True):
                if (d, p) != page:
                    if held:
                        close()
                    page, held = (d, p), []
                held.append(row)
            if len(out) > 10_000:
                yield batch_of(out)
                out.clear()
        if held:
            close()
        yield batch_of(out)

    slim = df.select("doc_id", F.col("page_no").cast("int").alias("page_no"), "orientation", "x0", "top", "x1", "bottom")
    return slim.repartition(*PAGE).sortWithinPartitions(*PAGE).mapInArrow(run, schema)


def tables(page_cells: DataFrame) -> DataFrame:
    """Cells with ``table`` (from 0, by top then x0): cells that share corners, without tables of one cell."""
    rows = page_cells.withColumn("orientation", F.lit("c"))
    return _by_page(rows, lambda held: _numbered([tuple(r[1:]) for r in held]), "table int, x0 double, top double, x1 double, bottom double")


def find_tables(edges: DataFrame, settings: TableSettings | None = None, words: DataFrame | None = None, explicit: DataFrame | None = None) -> DataFrame:
    """Cells of all tables: page, table, x0, top, x1, bottom.

    Crossings, cells and connected tables of a page are found in one pass over
    its final edges, which are few; ``intersections`` and ``cells`` are the same
    as joins.
    """
    s = settings or TableSettings()
    xt, yt = s.intersection_x_tolerance, s.intersection_y_tolerance

    def solve(held: list) -> list:
        v = [tuple(r[1:]) for r in held if r[0] == "v"]
        h = [tuple(r[1:]) for r in held if r[0] == "h"]
        return _numbered(_page_cells(v, h, xt, yt))

    return _by_page(table_edges(edges, s, words, explicit), solve, "table int, x0 double, top double, x1 double, bottom double")


def table_boxes(found: DataFrame) -> DataFrame:
    return found.groupBy(*PAGE, "table").agg(F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"), F.count("*").alias("cells"))


def largest_table(found: DataFrame) -> DataFrame:
    """A page's table of most cells; ties go to the upper, then the left one."""
    order = Window.partitionBy(*PAGE).orderBy(F.desc("cells"), "top", "x0")
    return table_boxes(found).withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def with_spans(found: DataFrame) -> DataFrame:
    """Cells with row_index, column_index, row_span, column_span, and the table's row_count and column_count."""
    by = [*PAGE, "table"]
    whole = Window.partitionBy(*by)
    r = found.withColumn("row_index", (F.dense_rank().over(whole.orderBy("top")) - 1).cast("int")).withColumn("column_index", (F.dense_rank().over(whole.orderBy("x0")) - 1).cast("int"))
    r = r.withColumn("_tops", F.collect_set("top").over(whole)).withColumn("_lefts", F.collect_set("x0").over(whole))
    span = lambda values, a, b: F.greatest(F.lit(1), F.size(F.filter(values, lambda v: (v >= F.col(a)) & (v < F.col(b) - 1e-6)))).cast("int")
    return r.withColumn("row_span", span("_tops", "top", "bottom")).withColumn("column_span", span("_lefts", "x0", "x1")).withColumn("row_count", F.size("_tops")).withColumn("column_count", F.size("_lefts")).drop("_tops", "_lefts")


def cell_chars(found: DataFrame, chars: DataFrame, square: float = 64.0) -> DataFrame:
    """Characters with the cell that holds their centre (its left and top sides belong to it).

    Cells are dealt out to the squares of a grid that they touch, a character
    looks into its own, so that a page's characters do not meet all its cells.
    """
    at = lambda c: F.floor(c / square)
    hx, vy = (F.col("x0") + F.col("x1")) / 2, (F.col("top") + F.col("bottom")) / 2
    c = chars.withColumns({"_hx": hx, "_vy": vy, "_gx": at(hx), "_gy": at(vy)})
    box = found.select(*PAGE, "table", *[F.col(x).alias(f"_{x}") for x in ("x0", "top", "x1", "bottom")])
    box = box.withColumn("_gx", F.explode(F.sequence(at(F.col("_x0")), at(F.col("_x1"))))).withColumn("_gy", F.explode(F.sequence(at(F.col("_top")), at(F.col("_bottom")))))
    inside = (F.col("_hx") >= F.col("_x0")) & (F.col("_hx") < F.col("_x1")) & (F.col("_vy") >= F.col("_top")) & (F.col("_vy") < F.col("_bottom"))
    return c.join(box, [*PAGE, "_gx", "_gy"]).filter(inside).drop("_hx", "_vy", "_gx", "_gy")


def extract_cells(found: DataFrame, chars: DataFrame, settings: TextSettings | None = None) -> DataFrame:
    """All slots of every table: page, table, row_index, column_index, text: '' in an empty cell, null where no cell begins."""
    own = ["table", "_x0", "_top"]
    placed = cell_chars(found, chars).withColumn("_cell", F.struct("page_no", *own))
    texts = extract_text(placed.drop("page_no").withColumnRenamed("_cell", "page_no"), settings).select("doc_id", F.col("page_no.page_no").alias("page_no"), F.col("page_no.table").alias("table"), F.col("page_no._x0").alias("x0"), F.col("page_no._top").alias("top"), "text")
    filled = with_spans(found).join(texts, [*PAGE, "table", "x0", "top"], "left")
    # a table's texts by their slot's number; the slots without one are made here, not by another pass over the cells
    slot = F.struct(F.col("row_index") * F.col("column_count") + F.col("column_index"), F.coalesce("text", F.lit("")))
    whole = filled.groupBy(*PAGE, "table").agg(F.map_from_entries(F.collect_list(slot)).alias("_t"), F.first("row_count").alias("_r"), F.first("column_count").alias("_c"))
    slots = whole.withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_r") * F.col("_c") - 1)))
    return slots.select(*PAGE, "table", F.floor(F.col("_k") / F.col("_c")).cast("int").alias("row_index"), (F.col("_k") % F.col("_c")).alias("column_index"), F.try_element_at("_t", F.col("_k")).alias("text"))


def extract_tables(found: DataFrame, chars: DataFrame, settings: TextSettings | None = None) -> DataFrame:
    """page, table, rows: array of arrays of texts."""
    slots = extract_cells(found, chars, settings)
    rows = slots.groupBy(*PAGE, "table", "row_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("column_index", "text"))), lambda x: x["text"]).alias("cells"))
    return rows.groupBy(*PAGE, "table").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_index", "cells"))), lambda x: x["cells"]).alias("rows"))


def pages_with_edges(edges: DataFrame) -> DataFrame:
    """doc_id, page_no of pages that have an edge at all."""
    return edges.select(*PAGE).distinct()


def should_probe(settings: TableSettings, policy: str = "auto") -> bool:
    """Whether pages without edges can be left out: never, always, or (auto) unless a text strategy is in use."""
    if policy not in ("auto", "always", "never"):
        raise ValueError(f"no such policy: {policy}")
    return policy == "always" or (policy == "auto" and "text" not in (settings.vertical_strategy, settings.horizontal_strategy))


def retain_tables(found: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Cells of the tables whose boxes have a common area with a crop."""
    kept = table_boxes(found).filter((F.least(F.col("x1"), F.lit(float(box[2]))) > F.greatest(F.col("x0"), F.lit(float(box[0])))) & (F.least(F.col("bottom"), F.lit(float(box[3]))) > F.greatest(F.col("top"), F.lit(float(box[1])))))
    return found.join(kept.select(*PAGE, "table"), [*PAGE, "table"], "left_semi")
