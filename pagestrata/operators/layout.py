"""The layout path: characters in content order to lines, lines to boxes, boxes to reading order and text.

Coordinates have their origin at the bottom left (x0, y0, x1, y1); ``seq`` is
the content order.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import page_arrays
from .words import PAGE

LINE = "page_no int, line int, text string, x0 double, y0 double, x1 double, y1 double, vertical boolean, box int, box_index int"


@dataclass(frozen=True)
class LayoutSettings:
    line_overlap: float = 0.5
    char_margin: float = 2.0
    line_margin: float = 0.5
    word_margin: float = 0.1
    boxes_flow: float | None = 0.5
    detect_vertical: bool = False

    def __post_init__(self) -> None:
        if self.boxes_flow is not None and not -1 <= self.boxes_flow <= 1:
            raise ValueError("boxes_flow is from -1 to 1, or None")


def bottom_left(chars: DataFrame | page_arrays.PageChars, page_height: float | str) -> DataFrame | page_arrays.PageChars:
    """Add y0 and y1 to top-left objects."""
    if isinstance(chars, page_arrays.PageChars):
        high = float(page_height)
        return chars.moved(lambda c: {**c, "y0": high - c["bottom"], "y1": high - c["top"]})
    h = F.lit(float(page_height)) if not isinstance(page_height, str) else F.col(page_height)
    return chars.withColumn("y0", h - F.col("bottom")).withColumn("y1", h - F.col("top"))


def _aligned(lag, s: LayoutSettings, along: str, across: str) -> Column:
    """Whether a character stands beside the one before: enough common extent across the line, and near along it."""
    size = lambda c, get: get(f"{c}1") - get(f"{c}0")
    common = F.least(F.col(f"{across}1"), lag(f"{across}1")) - F.greatest(F.col(f"{across}0"), lag(f"{across}0"))
    apart = F.greatest(F.lit(0.0), F.greatest(F.col(f"{along}0"), lag(f"{along}0")) - F.least(F.col(f"{along}1"), lag(f"{along}1")))
    wide, tall = (F.greatest(size(along, F.col), size(along, lag)), F.least(size(across, F.col), size(across, lag)))
    return (common >= 0) & (tall * s.line_overlap < common) & (apart < wide * s.char_margin)


def _with_lines(chars: DataFrame, s: LayoutSettings) -> DataFrame:
    """Characters with ``_line`` and ``vertical``."""
    order = Window.partitionBy(*PAGE).orderBy("seq")
    lag = lambda c: F.lag(c).over(order)
    first = lag("seq").isNull()
    beside = ~first & _aligned(lag, s, "x", "y")
    if not s.detect_vertical:
        rows = chars.withColumn("_new", F.when(beside, 0).otherwise(1))
        return rows.withColumn("_line", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1).withColumn("vertical", F.lit(False))
    above = ~first & _aligned(lag, s, "y", "x")
    rows = chars.withColumn("_h", beside).withColumn("_v", above)

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        """A line's direction is that of its first two characters, so each step depends on all before it."""
        pdf = pdf.sort_values("seq")
        line, way, number, turned = -1, None, [], []
        for h, v in zip(pdf["_h"], pdf["_v"], strict=True):
            if (way == "h" and h) or (way == "v" and v):
                pass
            elif way is None and line >= 0 and h != v:
                way = "v" if v else "h"
            else:
                line, way = line + 1, None
            number.append(line)
            if len(turned) <= line:
                turned.append(False)
            turned[line] = way == "v"
        pdf["_line"], pdf["vertical"] = number, [turned[k] for k in number]
        return pdf[["doc_id", "page_no", "seq", "_line", "vertical"]]

    key = rows.schema["doc_id"].dataType.simpleString()
    found = rows.select(*PAGE, "seq", "_h", "_v").groupBy(*PAGE).applyInPandas(walk, f"doc_id {key}, page_no int, seq long, _line long, vertical boolean")
    return chars.join(found, [*PAGE, "seq"])


def layout_lines(chars: DataFrame | page_arrays.PageChars, settings: LayoutSettings | None = None) -> DataFrame:
    """Lines of characters that stand beside the one before in content order, with spaces where they are apart.

    doc_id, page_no, line (from 0 in content order), text (ends with a line
    feed), x0, y0, x1, y1, vertical. With detect_vertical, a line whose first
    two characters stand one below the other, and not side by side, runs down.
    """
    s = settings or LayoutSettings()
    if isinstance(chars, page_arrays.PageChars):
        return page_arrays.layout_lines(chars, s)
    rows = _with_lines(chars, s)
    own = Window.partitionBy(*PAGE, "_line").orderBy("seq")
    margin = s.word_margin * F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    gap = F.when(F.col("vertical"), F.lag("y0").over(own) > F.col("y1") + margin).otherwise(F.lag("x1").over(own) < F.col("x0") - margin)
    rows = rows.withColumn("_t", F.concat(F.when(gap, " ").otherwise(""), "text"))
    return rows.groupBy(*PAGE, F.col("_line").cast("int").alias("line")).agg(
        F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "_t"))), lambda c: c["_t"]), ""), F.lit("\n")).alias("text"),
        F.min("x0").alias("x0"),
        F.min("y0").alias("y0"),
        F.max("x1").alias("x1"),
        F.max("y1").alias("y1"),
        F.first("vertical").alias("vertical"),
    )


def line_chars(chars: DataFrame, settings: LayoutSettings | None = None) -> DataFrame:
    """Characters with ``line``, their line's number in ``layout_lines``, and ``vertical``."""
    return _with_lines(chars, settings or LayoutSettings()).withColumn("line", F.col("_line").cast("int")).drop("_line", "_new")


def neighbour_groups(lines: list[tuple[float, float, float, float, bool]], margin: float) -> list[int]:
    """A box number for each line: lines that are near, of a size and aligned, are together, by first seen order."""
    parent = list(range(len(lines)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    by_y = sorted(range(len(lines)), key=lambda i: lines[i][1])
    for i, (x0, y0, x1, y1, tall) in enumerate(lines):
        d = margin * ((x1 - x0) if tall else (y1 - y0))
        for j in by_y:
            a0, b0, a1, b1, other = lines[j]
            if b0 >= y1 + (0 if tall else d):
                break
            if j == i or other != tall:
                continue
            if tall:
                near = a0 < x1 + d and a1 > x0 - d and b0 < y1 and b1 > y0
                alike = abs((a1 - a0) - (x1 - x0)) <= d
                aligned = abs(b0 - y0) <= d or abs(b1 - y1) <= d or abs((b0 + b1 - y0 - y1) / 2) <= d
            else:
                near = a0 < x1 and a1 > x0 and b0 < y1 + d and b1 > y0 - d
                alike = abs((b1 - b0) - (y1 - y0)) <= d
                aligned = abs(a0 - x0) <= d or abs(a1 - x1) <= d or abs((a0 + a1 - x0 - x1) / 2) <= d
            if near and alike and aligned:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(lines))]


def reading_order(boxes: list[tuple[float, float, float, float, bool]], flow: float | None) -> list[int]:
    """The rank of each box. With a flow, the pair that wastes least area is joined again and again (one with a third
    box between is put back once), and the tree is read in order; without, vertical boxes come first, then by place."""
    n = len(boxes)
    if not n:  # a page of blank lines only
        return []
    if flow is None:
        key = lambda i: (0, -boxes[i][2], -boxes[i][1], i) if boxes[i][4] else (1, -boxes[i][1], boxes[i][0], i)
        rank = [0] * n
        for k, i in enumerate(sorted(range(n), key=key)):
            rank[i] = k
        return rank
    # boxes and the pairs made of them, in the order in which they come
    at = np.zeros((2 * n, 4))
    at[:n] = [b[:4] for b in boxes]
    tall, kids = [b[4] for b in boxes], [None] * n
    area = np.zeros(2 * n)
    area[:n] = (at[:n, 2] - at[:n, 0]) * (at[:n, 3] - at[:n, 1])
    alive = np.zeros(2 * n, dtype=bool)
    alive[:n] = True

    def around(a: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.minimum(at[a, :2], at[others, :2]), np.maximum(at[a, 2:], at[others, 2:])

    def wastes(a: int, others: np.ndarray) -> np.ndarray:
        low, high = around(a, others)
        return (high - low).prod(axis=1) - area[a] - area[others]

    def between(a: int, b: int) -> bool:
        low, high = around(a, np.array([b]))
        hit = alive & (at[:, 0] < high[0, 0]) & (at[:, 2] > low[0, 0]) & (at[:, 1] < high[0, 1]) & (at[:, 3] > low[0, 1])
        return int(hit.sum()) > int(hit[a]) + int(hit[b])

    heap = []
    for a in range(n - 1):
        others = np.arange(a + 1, n)
        heap += [(False, d, a, b) for d, b in zip(wastes(a, others).tolist(), others.tolist(), strict=True)]
    heapq.heapify(heap)
    last = n
    while heap:
        seen, d, a, b = heapq.heappop(heap)
        if not (alive[a] and alive[b]):
            continue
        if not seen and between(a, b):
            heapq.heappush(heap, (True, d, a, b))
            continue
        low, high = around(a, np.array([b]))
        at[last], alive[a], alive[b] = np.concatenate([low[0], high[0]]), False, False
        area[last] = (high[0] - low[0]).prod()
        tall.append(tall[a] or tall[b])
        kids.append((a, b))
        others = np.flatnonzero(alive)
        for d, c in zip(wastes(last, others).tolist(), others.tolist(), strict=True):
            heapq.heappush(heap, (False, d, c, last))
        alive[last] = True
        last += 1
    nodes = [(*at[k].tolist(), tall[k], kids[k]) for k in range(last)]
    rank, count = [0] * n, 0
    stack = np.flatnonzero(alive)[::-1].tolist()
    while stack:
        k = stack.pop()
        pair = nodes[k][5]
        if pair is None:
            rank[k], count = count, count + 1
            continue
        if nodes[k][4]:
            key = lambda c: -(1 + flow) * (nodes[c][0] + nodes[c][2]) - (1 - flow) * nodes[c][3]
        else:
            key = lambda c: (1 - flow) * nodes[c][0] - (1 + flow) * (nodes[c][1] + nodes[c][3])
        stack += reversed(sorted(pair, key=key))
    return rank


def page_lines(chars: list[dict], s: LayoutSettings) -> list[list[dict]]:
    """The characters of each of ``layout_lines``' level lines, of one page's characters in content order."""
    out: list[list[dict]] = []
    last = None
    for c in chars:
        beside = False
        if last is not None:
            common = min(c["y1"], last["y1"]) - max(c["y0"], last["y0"])
            if common >= 0 and min(c["y1"] - c["y0"], last["y1"] - last["y0"]) * s.line_overlap < common:
                apart = max(0.0, max(c["x0"], last["x0"]) - min(c["x1"], last["x1"]))
                beside = apart < max(c["x1"] - c["x0"], last["x1"] - last["x0"]) * s.char_margin
        if beside:
            out[-1].append(c)
        else:
            out.append([c])
        last = c
    return out


def page_boxes(lines: list[list[dict]], s: LayoutSettings) -> list[list[int]]:
    """The places of the level lines of each box, boxes in reading order, as ``layout_boxes`` has them."""
    full = [k for k, line in enumerate(lines) if "".join(c["text"] for c in line).strip()]
    around = lambda m: (min(b[0] for b in m), min(b[1] for b in m), max(b[2] for b in m), max(b[3] for b in m), False)
    where = {k: around([(c["x0"], c["y0"], c["x1"], c["y1"]) for c in lines[k]]) for k in full}
    members: dict[int, list[int]] = {}
    for g, k in zip(neighbour_groups([where[k] for k in full], s.line_margin), full, strict=True):
        members.setdefault(g, []).append(k)
    if len(members) < 2:
        return list(members.values())
    rank = reading_order([around([where[k] for k in m]) for m in members.values()], s.boxes_flow)
    return [m for _, m in sorted(zip(rank, members.values(), strict=True))]


def layout_boxes(lines: DataFrame, settings: LayoutSettings | None = None) -> DataFrame:
    """Lines with ``box`` and ``box_index`` (reading order); lines without text have neither. One page at a time."""
    s = settings or LayoutSettings()
    rows = lines if "vertical" in lines.columns else lines.withColumn("vertical", F.lit(False))

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("line").reset_index(drop=True)
        full = pdf["text"].str.strip().ne("").to_numpy()
        some = pdf[full]
        where = list(zip(some["x0"], some["y0"], some["x1"], some["y1"], some["vertical"], strict=True))
        group_of = neighbour_groups(where, s.line_margin)
        number = {g: k for k, g in enumerate(dict.fromkeys(group_of))}
        boxes: dict[int, list[float]] = {}
        for g, (x0, y0, x1, y1, tall) in zip(group_of, where, strict=True):
            b = boxes.setdefault(number[g], [x0, y0, x1, y1, tall])
            b[:4] = [min(b[0], x0), min(b[1], y0), max(b[2], x1), max(b[3], y1)]
        order = reading_order([tuple(boxes[k]) for k in range(len(boxes))], s.boxes_flow)
        pdf["box"] = pd.array([None] * len(pdf), dtype="Int32")
        pdf["box_index"] = pd.array([None] * len(pdf), dtype="Int32")
        pdf.loc[full, "box"] = [number[g] for g in group_of]
        pdf.loc[full, "box_index"] = [order[number[g]] for g in group_of]
        return pdf[["doc_id", "page_no", "line", "text", "x0", "y0", "x1", "y1", "vertical", "box", "box_index"]]

    key = rows.schema["doc_id"].dataType.simpleString()
    return rows.groupBy(*PAGE).applyInPandas(group, f"doc_id {key}, {LINE}")


def page_text(boxed: DataFrame) -> DataFrame:
    """doc_id, page_no, text: boxes in reading order, their lines from top to bottom, an empty line after each box, a form feed at the end."""
    kept = boxed.filter("box is not null")
    place = F.struct((-F.col("y1")).alias("y"), "line", "text")
    texts = kept.groupBy(*PAGE, "box_index").agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(place)), lambda c: c["text"]), ""), F.lit("\n")).alias("_t"))
    return texts.groupBy(*PAGE).agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("box_index", "_t"))), lambda c: c["_t"]), ""), F.lit("\f")).alias("text"))


def reading_text(chars: page_arrays.PageChars, settings: LayoutSettings | None = None) -> DataFrame:
    """``page_text(layout_boxes(layout_lines(chars)))`` in one pass."""
    return page_arrays.reading_text(chars, settings or LayoutSettings())
