"""Bounding boxes, crops, edges and affine maps as columns. Boxes are columns x0, top, x1, bottom."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Box = Sequence[float | Column]


def _box(b: Box) -> list[Column]:
    return [x if isinstance(x, Column) else F.lit(float(x)) for x in b]


def _own(prefix: str = "") -> list[Column]:
    return [F.col(f"{prefix}{c}") for c in ("x0", "top", "x1", "bottom")]


def overlap_size(a: Box, b: Box) -> tuple[Column, Column]:
    """Width and height of the common part, negative where the boxes are apart."""
    (ax0, at, ax1, ab), (bx0, bt, bx1, bb) = _box(a), _box(b)
    return F.least(ax1, bx1) - F.greatest(ax0, bx0), F.least(ab, bb) - F.greatest(at, bt)


def overlaps(a: Box, b: Box) -> Column:
    """Touching edges count, touching corners do not."""
    w, h = overlap_size(a, b)
    return (w >= 0) & (h >= 0) & (w + h > 0)


def overlaps_strictly(a: Box, b: Box) -> Column:
    w, h = overlap_size(a, b)
    return (w > 0) & (h > 0)


def check_box(box: Sequence[float], parent: Sequence[float] | None = None, strict: bool = True) -> None:
    """Raise for a box without area, and if strict for one that is not within its parent."""
    x0, top, x1, bottom = box
    if not (x1 > x0 and bottom > top):
        raise ValueError(f"the box {tuple(box)} has no area")
    if strict and parent is not None and not (parent[0] <= x0 and parent[1] <= top and x1 <= parent[2] and bottom <= parent[3]):
        raise ValueError(f"the box {tuple(box)} is not within {tuple(parent)}")


def _derived(df: DataFrame) -> DataFrame:
    have = set(df.columns)
    out = df
    if "width" in have:
        out = out.withColumn("width", F.col("x1") - F.col("x0"))
    if "height" in have:
        out = out.withColumn("height", F.col("bottom") - F.col("top"))
    return out


def intersects_box(df: DataFrame, box: Box) -> DataFrame:
    return df.filter(overlaps(_own(), box))


def outside_box(df: DataFrame, box: Box) -> DataFrame:
    return df.filter(~overlaps(_own(), box))


def within_box(df: DataFrame, box: Box) -> DataFrame:
    """Objects whose part in the box is the whole object."""
    x0, top, x1, bottom = _box(box)
    inside = (F.col("x0") >= x0) & (F.col("top") >= top) & (F.col("x1") <= x1) & (F.col("bottom") <= bottom)
    return df.filter(overlaps(_own(), box) & inside)


def crop(df: DataFrame, box: Box) -> DataFrame:
    """Objects that overlap the box, clipped to it; doctop moves with the top."""
    x0, top, x1, bottom = _box(box)
    kept = intersects_box(df, box)
    new_top = F.greatest(F.col("top"), top)
    if "doctop" in df.columns:
        kept = kept.withColumn("doctop", F.col("doctop") + (new_top - F.col("top")))
    kept = kept.withColumns({"x0": F.greatest("x0", x0), "top": new_top, "x1": F.least("x1", x1), "bottom": F.least("bottom", bottom)})
    return _derived(kept)


def clamp_crop(first: Box, page: Box) -> list[Column]:
    """A crop box clamped to its page; the page where nothing is left or a number is not finite."""
    a, b = _box(first), _box(page)
    c = [F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3])]
    finite = F.lit(True)
    for x in a:
        finite = finite & ~F.isnan(x) & (F.abs(x) < float("inf"))
    ok = finite & (c[2] > c[0]) & (c[3] > c[1])
    return [F.when(ok, x).otherwise(y) for x, y in zip(c, b, strict=True)]


def move(df: DataFrame, axis: str, by: Column | float) -> DataFrame:
    """Shift along h or v, with all that derives from it."""
    by = by if isinstance(by, Column) else F.lit(float(by))
    names = ("x0", "x1") if axis == "h" else tuple(c for c in ("top", "bottom", "doctop") if c in df.columns)
    out = df.withColumns({c: F.col(c) + by for c in names})
    if axis == "v" and {"y0", "y1"} <= set(df.columns):
        out = out.withColumns({"y0": F.col("y0") - by, "y1": F.col("y1") - by})
    return out


def resize(df: DataFrame, side: str, value: Column | float) -> DataFrame:
    """Move one side (x0, x1, top, bottom) to ``value``."""
    value = value if isinstance(value, Column) else F.lit(float(value))
    out = df
    if side == "top" and "doctop" in df.columns:
        out = out.withColumn("doctop", F.col("doctop") + (value - F.col("top")))
    return _derived(out.withColumn(side, value))


def bounding_box(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"))


def to_top_left(df: DataFrame, page_height: str = "height", x_shift: Column | float = 0.0, y_shift: Column | float = 0.0) -> DataFrame:
    """Add top and bottom from y0, y1 (origin at the bottom left) and shift by the media box."""
    xs = x_shift if isinstance(x_shift, Column) else F.lit(float(x_shift))
    ys = y_shift if isinstance(y_shift, Column) else F.lit(float(y_shift))
    h = F.col(page_height)
    return df.withColumns({"top": (h - F.col("y1")) + ys, "bottom": (h - F.col("y0")) + ys, "x0": F.col("x0") + xs, "x1": F.col("x1") + xs})


# Edges


def _edge(x0: Column, top: Column, x1: Column, bottom: Column, kind: Column, orientation: Column) -> Column:
    return F.struct(
        kind.alias("object_type"),
        orientation.alias("orientation"),
        x0.alias("x0"),
        top.alias("top"),
        x1.alias("x1"),
        bottom.alias("bottom"),
        (x1 - x0).alias("width"),
        (bottom - top).alias("height"),
    )


EDGE = ("object_type", "orientation", "x0", "top", "x1", "bottom", "width", "height")


def rect_edges(rects: DataFrame) -> DataFrame:
    """The four sides of each rectangle: top, bottom, left, right."""
    x0, top, x1, bottom = _own()
    kind, h, v = F.lit("rect_edge"), F.lit("h"), F.lit("v")
    sides = F.array(_edge(x0, top, x1, top, kind, h), _edge(x0, bottom, x1, bottom, kind, h), _edge(x0, top, x0, bottom, kind, v), _edge(x1, top, x1, bottom, kind, v))
    keys = [c for c in ("doc_id", "page_no", "seq") if c in rects.columns]
    return rects.select(*keys, F.posexplode(sides).alias("side", "e")).select(*keys, "side", *[F.col(f"e.{c}") for c in EDGE])


def line_edges(lines: DataFrame) -> DataFrame:
    """Horizontal if both ends have one top, else vertical (also when slanting)."""
    x0, top, x1, bottom = _own()
    keys = [c for c in ("doc_id", "page_no", "seq") if c in lines.columns]
    e = _edge(x0, top, x1, bottom, F.lit("line"), F.when(top == bottom, "h").otherwise("v"))
    return lines.select(*keys, F.lit(0).alias("side"), e.alias("e")).select(*keys, "side", *[F.col(f"e.{c}") for c in EDGE])


def curve_edges(curves: DataFrame, points: str = "pts") -> DataFrame:
    """An edge for each two consecutive points (structs x, y in top-left space); no orientation if it slants."""
    p = F.col(points)
    pairs = F.zip_with(F.slice(p, F.lit(1), F.size(p) - 1), F.slice(p, F.lit(2), F.size(p) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    keys = [c for c in ("doc_id", "page_no", "seq") if c in curves.columns]
    rows = curves.filter(F.size(p) > 1).select(*keys, F.posexplode(pairs).alias("side", "q"))
    ax, ay, bx, by = (F.col(f"q.{c}") for c in ("a.x", "a.y", "b.x", "b.y"))
    turn = F.when(ax == bx, "v").when(ay == by, "h").otherwise(F.lit(None).cast("string"))
    e = _edge(F.least(ax, bx), F.least(ay, by), F.greatest(ax, bx), F.greatest(ay, by), F.lit("curve_edge"), turn)
    return rows.select(*keys, "side", e.alias("e")).select(*keys, "side", *[F.col(f"e.{c}") for c in EDGE])


def filter_edges(edges: DataFrame, orientation: str | None = None, object_type: str | None = None, min_length: float = 1.0) -> DataFrame:
    """Of an orientation and type, at least so long; a vertical edge's length is its height, any other's its width."""
    out = edges.filter(F.when(F.col("orientation") == "v", F.col("height")).otherwise(F.col("width")) >= min_length)
    if orientation:
        out = out.filter(F.col("orientation") == orientation)
    return out.filter(F.col("object_type") == object_type) if object_type else out


# Joins of boxes


def box_join(left: DataFrame, right: DataFrame, by: list[str], cell: float, strict: bool = False) -> DataFrame:
    """Pairs (columns l_*, r_*) of boxes that overlap in the same ``by``.

    Both sides are dealt out to a grid of squares of ``cell``; a pair is formed
    only in the square of the upper left corner of its common part, so each
    comes once and a page with many boxes is shared out.
    """

    def squares(df: DataFrame, p: str) -> DataFrame:
        named = df.select(*[F.col(c).alias(f"{p}{c}") for c in df.columns])
        span = lambda a, b: F.sequence(F.floor(F.col(f"{p}{a}") / cell), F.floor(F.col(f"{p}{b}") / cell))
        return named.withColumn(f"{p}_gx", F.explode(span("x0", "x1"))).withColumn(f"{p}_gy", F.explode(span("top", "bottom")))

    a, b = squares(left, "l_"), squares(right, "r_")
    on = [F.col(f"l_{c}") == F.col(f"r_{c}") for c in by] + [F.col("l__gx") == F.col("r__gx"), F.col("l__gy") == F.col("r__gy")]
    test = overlaps_strictly if strict else overlaps
    corner = (F.col("l__gx") == F.floor(F.greatest("l_x0", "r_x0") / cell)) & (F.col("l__gy") == F.floor(F.greatest("l_top", "r_top") / cell))
    return a.join(b, on).filter(test(_own("l_"), _own("r_")) & corner).drop("l__gx", "l__gy", "r__gx", "r__gy")


def nearest_boxes(queries: DataFrame, boxes: DataFrame, by: list[str], key: str, k: int) -> DataFrame:
    """For each query box the k boxes of its ``by`` with the nearest centres: (by, q_key, rank, key, distance), ties by key.

    Boxes are dealt out to a grid whose squares hold about k of them, and a
    query looks into its square and the eight around it. What it finds within a
    square's side is final. Queries that find fewer there look into squares
    eight times as wide, and the few that are left over into their whole ``by``.
    """
    centre = lambda a, b: (F.col(a) + F.col(b)) / 2
    spots = boxes.select(*by, key, centre("x0", "x1").alias("_x"), centre("top", "bottom").alias("_y"))
    side = F.greatest(F.sqrt((F.max("_x") - F.min("_x") + 1) * (F.max("_y") - F.min("_y") + 1) * k / F.count("*")), F.lit(1e-9)).alias("_side")
    # a row for each ``by``, so that the data, not the driver, say how wide a square is
    spots = spots.join(spots.groupBy(*by).agg(side), by)
    own = queries.select(*[F.col(c).alias(f"q_{c}") for c in (*by, key)], centre("x0", "x1").alias("q_x"), centre("top", "bottom").alias("q_y"))
    sides = spots.select(*[F.col(c).alias(f"q_{c}") for c in by], F.col("_side").alias("q_side")).distinct()
    own = own.join(sides, [f"q_{c}" for c in by])
    same = [F.col(f"q_{c}") == F.col(c) for c in by]
    query = [*[f"q_{c}" for c in by], f"q_{key}"]
    dx, dy = F.col("q_x") - F.col("_x"), F.col("q_y") - F.col("_y")

    def best(pairs: DataFrame) -> DataFrame:
        rows = pairs.filter(F.col(f"q_{key}") != F.col(key)).withColumn("distance", F.sqrt(dx * dx + dy * dy))
        order = Window.partitionBy(*query).orderBy("distance", key)
        return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(*query, "rank", key, "distance", "q_side")

    def by_squares(some: DataFrame, times: float) -> DataFrame:
        at = lambda c, side: F.floor(F.col(c) / (F.col(side) * times))
        around = F.array(*[F.lit(v).cast("long") for v in (-1, 0, 1)])
        look = some.withColumn("_dx", F.explode(around)).withColumn("_dy", F.explode(around)).withColumn("q_gx", at("q_x", "q_side") + F.col("_dx")).withColumn("q_gy", at("q_y", "q_side") + F.col("_dy"))
        held = spots.withColumn("_gx", at("_x", "_side")).withColumn("_gy", at("_y", "_side")).drop("_side")
        return best(look.join(held, [*same, F.col("q_gx") == F.col("_gx"), F.col("q_gy") == F.col("_gy")]))

    def final(found: DataFrame, times: float) -> DataFrame:
        """Queries whose k-th box lies within a square's side; one just outside cannot be nearer."""
        return found.groupBy(*query).agg(F.count("*").alias("n"), F.max("distance").alias("far"), F.first("q_side").alias("s")).filter((F.col("n") == k) & (F.col("far") < F.col("s") * times)).select(*query)

    first = by_squares(own, 1.0)
    done = final(first, 1.0)
    left = own.join(done, query, "left_anti")
    second = by_squares(left, 8.0)
    done2 = final(second, 8.0)
    last = best(left.join(done2, query, "left_anti").join(spots.drop("_side"), same))
    out = first.join(done, query, "left_semi").unionByName(second.join(done2, query, "left_semi")).unionByName(last)
    return out.select(*[F.col(f"q_{c}").alias(c) for c in by], f"q_{key}", "rank", key, "distance")


# Affine maps, as structs of a, b, c, d, e, f


def matrix(a, b, c, d, e, f) -> Column:
    names = "abcdef"
    return F.struct(*[(x if isinstance(x, Column) else F.lit(float(x))).cast("double").alias(n) for n, x in zip(names, (a, b, c, d, e, f), strict=True)])


def multiply(m1: Column, m0: Column) -> Column:
    """First m1, then m0."""
    return matrix(
        m0["a"] * m1["a"] + m0["c"] * m1["b"],
        m0["b"] * m1["a"] + m0["d"] * m1["b"],
        m0["a"] * m1["c"] + m0["c"] * m1["d"],
        m0["b"] * m1["c"] + m0["d"] * m1["d"],
        m0["a"] * m1["e"] + m0["c"] * m1["f"] + m0["e"],
        m0["b"] * m1["e"] + m0["d"] * m1["f"] + m0["f"],
    )


def translate(m: Column, x: Column, y: Column) -> Column:
    return matrix(m["a"], m["b"], m["c"], m["d"], x * m["a"] + y * m["c"] + m["e"], x * m["b"] + y * m["d"] + m["f"])


def apply_point(m: Column, x: Column, y: Column) -> Column:
    return F.struct((m["a"] * x + m["c"] * y + m["e"]).alias("x"), (m["b"] * x + m["d"] * y + m["f"]).alias("y"))


def apply_vector(m: Column, x: Column, y: Column) -> Column:
    """Without the translation."""
    return F.struct((m["a"] * x + m["c"] * y).alias("x"), (m["b"] * x + m["d"] * y).alias("y"))


def apply_rect(m: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The box around the mapped corners."""
    p = [apply_point(m, x, y) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]
    xs, ys = [q["x"] for q in p], [q["y"] for q in p]
    return F.struct(F.least(*xs).alias("x0"), F.least(*ys).alias("y0"), F.greatest(*xs).alias("x1"), F.greatest(*ys).alias("y1"))


def scale_skew(m: Column) -> Column:
    """scale_x, scale_y, skew_x, skew_y (degrees), translation_x, translation_y."""
    return F.struct(
        F.sqrt(m["a"] * m["a"] + m["b"] * m["b"]).alias("scale_x"),
        F.sqrt(m["c"] * m["c"] + m["d"] * m["d"]).alias("scale_y"),
        (F.degrees(F.atan2(m["d"], m["c"])) - 90).alias("skew_x"),
        F.degrees(F.atan2(m["b"], m["a"])).alias("skew_y"),
        m["e"].alias("translation_x"),
        m["f"].alias("translation_y"),
    )


def area(x0: Column, top: Column, x1: Column, bottom: Column) -> Column:
    return (x1 - x0) * (bottom - top)


def axis_distance(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """0 if the intervals meet (ends included), else the least distance of their ends."""
    meet = (b0 <= a1) & (a0 <= b1)
    return F.when(meet, 0.0).otherwise(F.least(F.abs(a0 - b1), F.abs(a1 - b0)))


def axis_overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    meet = (b0 <= a1) & (a0 <= b1)
    return F.when(meet, F.least(F.abs(a0 - b1), F.abs(a1 - b0))).otherwise(0.0)


def axis_gap(a: Box, b: Box) -> Column:
    """The area of the box around both that neither covers: how far two boxes are from being one."""
    (ax0, at, ax1, ab), (bx0, bt, bx1, bb) = _box(a), _box(b)
    whole = area(F.least(ax0, bx0), F.least(at, bt), F.greatest(ax1, bx1), F.greatest(ab, bb))
    return whole - area(ax0, at, ax1, ab) - area(bx0, bt, bx1, bb)


def union_box(a: Box, b: Box) -> list[Column]:
    """The box around both."""
    (ax0, at, ax1, ab), (bx0, bt, bx1, bb) = _box(a), _box(b)
    return [F.least(ax0, bx0), F.least(at, bt), F.greatest(ax1, bx1), F.greatest(ab, bb)]


def expansion(a: Box, b: Box) -> Column:
    """By how much the area of ``a`` grows to hold ``b``."""
    x0, top, x1, bottom = union_box(a, b)
    return area(x0, top, x1, bottom) - area(*_box(a))


def object_edges(shapes: DataFrame) -> DataFrame:
    """Edges of shapes by their kind: a line's one, a rectangle's four, a curve's segments."""
    of = lambda kind: shapes.filter(F.col("object_type") == kind)
    parts = [line_edges(of("line")), rect_edges(of("rect"))]
    if "pts" in shapes.columns:
        parts.append(curve_edges(of("curve")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def horizontal_edges(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("orientation") == "h")


def vertical_edges(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("orientation") == "v")


def with_geometries(pages: DataFrame, geometries: DataFrame) -> DataFrame:
    """Pages with the boxes given for them (doc_id, page_no, x0, top, x1, bottom); raises where a page has none or more than one."""
    held = geometries.groupBy("doc_id", "page_no").agg(F.first(F.struct("x0", "top", "x1", "bottom")).alias("geometry"), F.count("*").alias("_n"))
    out = pages.join(held, ["doc_id", "page_no"], "left")
    wrong = F.raise_error(F.format_string("page %d of %s has %d geometries", "page_no", F.col("doc_id").cast("string"), F.coalesce("_n", F.lit(0)))).cast("boolean")
    return out.filter(F.when(F.coalesce("_n", F.lit(0)) != 1, wrong).otherwise(True)).drop("_n")
