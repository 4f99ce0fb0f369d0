"""Ruled tables as arrays, many pages a pass: from edges to cells to the texts of slots, without a row an edge or a character.

The results are those of ``tables.extract_cells(tables.find_tables(...), ...)``
over rows. A pass holds whole pages of PASS_ROWS rows or more; pages whose
crossings are no plain grid go one by one through the loop that ``tables`` has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
from pyspark.sql import DataFrame

from .page_arrays import PAGE, Arrays, _order, page_texts, strings, words
from .tables import TableSettings, _page_cells
from .words import TextSettings

PASS_ROWS = 10_000
#: Pairs of edges that are looked at at once.
PAIRS = 2_000_000
#: Sides of one direction: page, place across it, start and end along it.
Sides = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


class RuledPages:
    """Rows (doc_id, page_no, ...), those of a page together and in order, and what makes vertical and horizontal sides and characters of them."""

    def __init__(self, rows: DataFrame, place: Callable[[Any, np.ndarray], tuple[Sides, Sides, Arrays]]):
        self.rows, self.place = rows, place


def rect_sides(page: np.ndarray, x0: np.ndarray, top: np.ndarray, x1: np.ndarray, bottom: np.ndarray) -> tuple[Sides, Sides]:
    """The vertical and the horizontal sides of rectangles."""
    twice = lambda a: np.concatenate([a, a])
    page = twice(page)
    return (page, np.concatenate([x0, x1]), twice(top), twice(bottom)), (page, np.concatenate([top, bottom]), twice(x0), twice(x1))


def _turn(*keys: np.ndarray) -> np.ndarray:
    """Where a key is another than the one before; the first is."""
    new = np.ones(len(keys[0]), dtype=bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _begins(rows: Any, last: Any) -> np.ndarray:
    """Rows that begin a page, the first one if ``last``, the row before, is of another."""
    import pyarrow.compute as pc

    new = np.zeros(rows.num_rows, dtype=bool)
    new[0] = last is None or any(last[k][0].as_py() != rows[k][0].as_py() for k in PAGE)
    for k in PAGE:
        a, b = rows[k].slice(1), rows[k].slice(0, rows.num_rows - 1)
        new[1:] |= pc.coalesce(pc.not_equal(a, b), pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)
    return new


def _passes(batches: Iterator[Any]) -> Iterator[Any]:
    """Whole pages, in tables of PASS_ROWS rows or more but for the last."""
    import pyarrow as pa

    held, rows, whole, last = [], 0, 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.flatnonzero(_begins(batch, last))
        if len(new):
            whole = rows + int(new[-1])
        held.append(batch)
        rows, last = rows + batch.num_rows, batch.slice(batch.num_rows - 1, 1)
        if whole >= PASS_ROWS:
            every = pa.Table.from_batches(held).combine_chunks()
            yield every.slice(0, whole).to_batches()[0]
            held, rows, whole = every.slice(whole).to_batches(), rows - whole, 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _ranks(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each value's place among the distinct ones, and these in order."""
    import pyarrow as pa

    found = pa.array(values + 0.0).dictionary_encode()
    kinds = found.dictionary.to_numpy()
    o = np.argsort(kinds)
    place = np.empty(len(o), dtype=np.int64)
    place[o] = np.arange(len(o))
    return place[found.indices.to_numpy()], kinds[o]


def merged(sides: Sides, least: float, snap: float, join: float, most: float) -> Sides:
    """Sides of ``least`` length, snapped and joined, of ``most`` length then: distinct, by page, place and start."""
    page, at, start, end = sides
    if len(page) and not (kept := end - start >= least).all():
        page, at, start, end = page[kept], at[kept], start[kept], end[kept]
    if not len(page):
        return page, at, start, end
    # equal sides count once, with how many they are
    key, size, radix, kinds = page, int(page[-1] if (page[1:] >= page[:-1]).all() else page.max()) + 1, [], []
    for values in (at, start, end):
        rank, kind = _ranks(values)
        size *= len(kind)
        if size < 2**62:
            key = key * len(kind) + rank
            radix.append(len(kind))
            kinds.append(kind)
    if len(radix) == 3:
        key = np.sort(key)
        first = np.flatnonzero(_turn(key))
        times, key = np.diff(np.append(first, len(key))), key[first]
        out = []
        for n, kind in zip(radix[::-1], kinds[::-1], strict=True):
            key, rank = np.divmod(key, n)
            out.append(kind[rank])
        page, (end, start, at) = key, out
    else:
        o = np.lexsort((end, start, at, page))
        page, at, start, end = page[o], at[o], start[o], end[o]
        first = np.flatnonzero(_turn(page, at, start, end))
        times = np.diff(np.append(first, len(page)))
        page, at, start, end = page[first], at[first], start[first], end[first]
    if snap > 0:
        new = _turn(page)
        new[1:] |= at[1:] > at[:-1] + snap
        begin = np.flatnonzero(new)
        mean = np.add.reduceat(at * times, begin) / np.add.reduceat(times, begin)
        at = at + (np.repeat(mean, np.diff(np.append(begin, len(at)))) - at)
    if (o := _order(page, at, start, end)) is not None:
        page, at, start, end = page[o], at[o], start[o], end[o]
    line = np.cumsum(_turn(page, at)) - 1
    rank, kind = _ranks(end)
    far = np.maximum.accumulate(line * len(kind) + rank) - line * len(kind)
    new = _turn(line)
    new[1:] |= start[1:] > kind[far[:-1]] + join
    begin = np.flatnonzero(new)
    page, at, start, end = page[begin], at[begin], start[begin], np.maximum.reduceat(end, begin)
    kept = end - start >= most
    return page[kept], at[kept], start[kept], end[kept]


def _spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owners and numbers of runs that begin at first."""
    own = np.repeat(np.arange(len(count)), count)
    return own, np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count) + first[own]


def _crossings(v: Sides, h: Sides, xt: float, yt: float) -> tuple[np.ndarray, np.ndarray]:
    """Vertical and horizontal sides that meet, by vertical side and then by place of the other."""
    rank, tops = _ranks(h[1])
    key = h[0] * len(tops) + rank
    low = np.searchsorted(key, v[0] * len(tops) + np.searchsorted(tops, v[2] - yt, "left"))
    count = np.searchsorted(key, v[0] * len(tops) + np.searchsorted(tops, v[3] + yt, "right")) - low
    total, a, out = np.cumsum(count), 0, []
    while a < len(count):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + PAIRS, "right")))
        i, j = _spread(low[a:b], count[a:b])
        i += a
        x = v[1][i]
        near = (h[2][j] - xt <= x) & (x <= h[3][j] + xt)
        out.append((i[near], j[near]))
        a = b
    return (np.concatenate([p[0] for p in out]), np.concatenate([p[1] for p in out])) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def page_cells(v: Sides, h: Sides, xt: float, yt: float) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """page, box and the numbers of the four corners of each cell, as ``tables._page_cells`` finds them, by (page, top, x0)."""
    i, j = _crossings(v, h, xt, yt)
    page, x, y = v[0][i], v[1][i], h[1][j]
    (xr, xs), (yr, ys) = _ranks(x), _ranks(y)
    key = (page * len(xs) + xr) * len(ys) + yr
    odd = np.zeros(max([0, *(int(s[0].max()) + 1 for s in (v, h) if len(s[0]))]), dtype=bool)
    if not (key[1:] > key[:-1]).all():
        o = np.argsort(key, kind="stable")
        i, j, page, x, y, xr, yr, key = (a[o] for a in (i, j, page, x, y, xr, yr, key))
        # a crossing of several sides of one direction
        odd[page[1:][key[1:] == key[:-1]]] = True
    n = len(key)
    below, right = np.full(n, -1), np.full(n, -1)
    k = np.flatnonzero(i[1:] == i[:-1])
    below[k] = k + 1
    o = np.argsort((page * len(ys) + yr) * len(xs) + xr, kind="stable")
    k = np.flatnonzero(j[o][1:] == j[o][:-1])
    right[o[k]] = o[k + 1]
    at = np.flatnonzero((below >= 0) & (right >= 0))
    r, d = right[at], below[at]
    across = below[r]
    plain = (across >= 0) & (across == right[d])
    # the nearest corners give no cell: others may
    odd[page[at[~plain]]] = True
    fine = plain & ~odd[page[at]]
    at, r, d, across = at[fine], r[fine], d[fine], across[fine]
    whose, box, corners = page[at], [x[at], y[at], x[r], y[d]], [at, r, d, across]
    if odd.any():
        found = []
        for p in np.flatnonzero(odd).tolist():
            mine = [[s[a : b] for s in side] for side in (v, h) for a, b in [np.searchsorted(side[0], (p, p + 1))]]
            (_, vx, v0, v1), (_, hy, h0, h1) = ([c.tolist() for c in side] for side in mine)
            found.extend((p, *c) for c in _page_cells(list(zip(vx, v0, vx, v1, strict=True)), list(zip(h0, hy, h1, hy, strict=True)), xt, yt))
        if found:
            more = [np.array(c) for c in zip(*found, strict=True)]
            ids = {}
            spots = [np.array([ids.setdefault(s, n + len(ids)) for s in zip(more[0].tolist(), more[a].tolist(), more[b].tolist(), strict=True)]) for a, b in ((1, 2), (3, 2), (1, 4), (3, 4))]
            whose, box, corners = np.concatenate([whose, more[0]]), [np.concatenate(b) for b in zip(box, more[1:], strict=True)], [np.concatenate(c) for c in zip(corners, spots, strict=True)]
    if (o := _order(whose, box[1], box[0])) is not None:
        whose, box, corners = whose[o], [b[o] for b in box], [c[o] for c in corners]
    return whose, box, corners


def connected(corners: list[np.ndarray]) -> np.ndarray:
    """The least cell among those that corners connect with each cell."""
    m = len(corners[0])
    label = np.arange(m)
    least = np.empty(max([0, *(int(c.max()) + 1 for c in corners if m)]), dtype=np.int64)
    while m:
        least[:] = m
        for c in corners:
            np.minimum.at(least, c, label)
        got = np.minimum(np.minimum(least[corners[0]], least[corners[1]]), np.minimum(least[corners[2]], least[corners[3]]))
        got = got[got]
        if (got == label).all():
            break
        label = got
    return label


def _grid(page: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, Callable[[np.ndarray, np.ndarray], np.ndarray]]:
    """Of intervals: the first of their pages' distinct starts that each covers, how many it covers, these by (page, start), and what finds the last start up to a place."""
    rank, kinds = _ranks(low)
    key = page * len(kinds) + rank
    starts = np.sort(key)
    starts = starts[_turn(starts)]
    first = np.searchsorted(starts, key)
    count = np.searchsorted(starts, page * len(kinds) + np.searchsorted(kinds, high, "left")) - first
    find = lambda p, at: np.searchsorted(starts, p * len(kinds) + np.searchsorted(kinds, at, "right")) - 1
    return first, count, starts // max(1, len(kinds)), find


def cell_chars(page: np.ndarray, box: list[np.ndarray], c: Arrays) -> tuple[np.ndarray, np.ndarray]:
    """Characters and the cells that hold their centres (left and top sides belong to a cell), by character.

    A page's distinct tops and lefts make a grid; cells are dealt out to all of
    its squares that they cover, a character looks into its own.
    """
    x0, top, x1, bottom = box
    (row, rows, row_page, row_of), (col, cols, col_page, col_of) = _grid(page, top, bottom), _grid(page, x0, x1)
    n = int(max(page[-1], c["page"].max(initial=0))) + 1
    wide, tall = np.bincount(col_page, minlength=n), np.bincount(row_page, minlength=n)
    row0, col0, size = np.cumsum(tall) - tall, np.cumsum(wide) - wide, tall * wide
    base = np.cumsum(size) - size
    square = lambda p, r, k: base[p] + (r - row0[p]) * wide[p] + (k - col0[p])
    if (rows == 1).all() and (cols == 1).all():
        cell, spot = np.arange(len(page)), square(page, row, col)
    else:
        one, r = _spread(row, rows)
        two, k = _spread(col[one], cols[one])
        cell = one[two]
        spot = square(page[cell], r[two], k)
    p = c["page"]
    hx, vy = (c["x0"] + c["x1"]) / 2, (c["top"] + c["bottom"]) / 2
    r, k = row_of(p, vy), col_of(p, hx)
    inside = np.flatnonzero((r >= row0[p]) & (k >= col0[p]) & (size[p] > 0))
    at = square(p[inside], r[inside], k[inside])
    held = np.bincount(spot, minlength=int(size.sum()))
    if held.max(initial=0) <= 1:
        who = np.full(len(held), -1)
        who[spot] = cell
        char, got = inside, who[at]
        char, got = char[got >= 0], got[got >= 0]
    else:
        o = np.argsort(spot, kind="stable")
        own, i = _spread((np.cumsum(held) - held)[at], held[at])
        char, got = inside[own], cell[o][i]
    fine = (hx[char] < x1[got]) & (vy[char] < bottom[got])
    return char[fine], got[fine]


def _slots(page: np.ndarray, box: list[np.ndarray], corners: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cells of tables of two or more: page, box and slot; of tables, by page, top and left: page, rows, columns."""
    label = connected(corners)
    number = np.bincount(label, minlength=len(label)) > 1
    kept = np.flatnonzero(number[label])
    table = (np.cumsum(number) - 1)[label[kept]]
    page, box = page[kept], [b[kept] for b in box]
    if (o := _order(table, box[1], box[0])) is not None:
        table, page, box = table[o], page[o], [b[o] for b in box]
    first = np.flatnonzero(_turn(table))
    level = np.cumsum(_turn(table, box[1]))
    row = level - np.repeat(level[first], np.diff(np.append(first, len(table))))
    rank, kinds = _ranks(box[0])
    lefts = np.sort(table * len(kinds) + rank)
    lefts = lefts[_turn(lefts)]
    begin = np.searchsorted(lefts, np.arange(len(first)) * len(kinds))
    column = np.searchsorted(lefts, table * len(kinds) + rank) - begin[table]
    height, width = np.maximum.reduceat(row, first) + 1 if len(first) else row, np.diff(np.append(begin, len(lefts)))
    base = np.cumsum(height * width) - height * width
    return page, box, base[table] + row * width[table] + column, page[first], height, width


def slot_texts(v: Sides, h: Sides, c: Arrays, s: TableSettings, t: TextSettings) -> tuple[Arrays, Any]:
    """page, table, row_index and column_index of all slots of all tables, and their texts: '' in an empty cell, null where none begins."""
    import pyarrow as pa
    import pyarrow.compute as pc

    v = merged(v, s.edge_min_length_prefilter, s.snap_x_tolerance, s.join_y_tolerance, s.edge_min_length)
    h = merged(h, s.edge_min_length_prefilter, s.snap_y_tolerance, s.join_x_tolerance, s.edge_min_length)
    page, box, slot, whose, height, width = _slots(*page_cells(v, h, s.intersection_x_tolerance, s.intersection_y_tolerance))
    size = height * width
    table, k = _spread(np.zeros(len(size), dtype=np.int64), size)
    row, column = np.divmod(k, width[table])
    first = np.flatnonzero(_turn(whose)) if len(whose) else np.zeros(0, dtype=np.int64)
    nth = np.arange(len(whose)) - np.repeat(first, np.diff(np.append(first, len(whose))))
    out = {"page": whose[table], "table": nth[table], "row_index": row, "column_index": column}
    if not len(k):
        return out, pa.array([], pa.string())
    char, cell = cell_chars(page, box, c)
    at = slot[cell]
    if (o := _order(at)) is not None:
        char, at = char[o], at[o]
    whole = len(char) == len(c["page"]) and (char[1:] > char[:-1]).all()
    got = page_texts(words({**(c if whole else {k: x[char] for k, x in c.items()}), "page": at}, t), t.y_tolerance)
    length = np.zeros(len(k), dtype=np.int64)
    length[got["page"]] = got["stops"] - got["starts"]
    own = np.ones(len(got["codes"]), dtype=bool)
    own[got["stops"]] = False
    texts = strings(got["codes"][own], np.append(0, np.cumsum(length)))
    if len(slot) < len(k):
        begun = np.zeros(len(k), dtype=bool)
        begun[slot] = True
        texts = pc.if_else(pa.array(begun), texts, pa.scalar(None, pa.string()))
    return out, texts


def extract_cells(pages: RuledPages, settings: TableSettings | None = None, text: TextSettings | None = None) -> DataFrame:
    """All slots of every table, as ``tables.extract_cells`` has them: page, table, row_index, column_index, text."""
    s, t = settings or TableSettings(), text or TextSettings()
    if (s.vertical_strategy, s.horizontal_strategy) != ("lines", "lines"):
        raise ValueError("other strategies than lines are for rows of edges")
    kind, place = pages.rows.schema["doc_id"].dataType.simpleString(), pages.place

    def run(batches):
        import pyarrow as pa

        for part in _passes(batches):
            first = _begins(part, None)
            got, texts = slot_texts(*place(part, np.cumsum(first) - 1), s, t)
            at = pa.array(np.flatnonzero(first)[got["page"]])
            numbers = {k: pa.array(got[k], pa.int32()) for k in ("table", "row_index", "column_index")}
            yield pa.RecordBatch.from_pydict({"doc_id": part["doc_id"].take(at), "page_no": part["page_no"].take(at), **numbers, "text": texts})

    return pages.rows.mapInArrow(run, f"doc_id {kind}, page_no int, table int, row_index int, column_index int, text string")
