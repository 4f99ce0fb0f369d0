"""Tables of arrays are those of rows of edges and characters, on plain grids and on others, whatever passes they come in."""

import random

import numpy as np
import pytest

from pagestrata.operators import geometry, table_arrays, tables, words
from pagestrata.plans import queries
from pagestrata.sources import glyphs as G

BOX = ("x0", "top", "x1", "bottom")


def page_of(k):
    """Rectangles and characters of page k: grids with gaps, jitter, merged cells, lone and overlapping rectangles; places are quarters."""
    dice = random.Random(k)
    rects = []
    for at in range(dice.choice((0, 1, 1, 1, 2, 3))):
        n, m, left, up = dice.randint(1, 5), dice.randint(1, 5), at * 130.0, dice.choice((0.0, 7.25, 200.0))
        for i in range(n):
            for j in range(m):
                if k % 4 and dice.random() < 0.15:
                    continue
                wide, tall = (1 + (k % 3 == 2 and dice.random() < 0.2) for _ in "ab")
                off = lambda: dice.choice((-0.5, 0, 0.25, 1)) if k % 5 == 4 else 0.0
                rects.append((left + j * 20 + off(), up + i * 16 + off(), left + (j + wide) * 20 + off(), up + (i + tall) * 16 + off()))
    if k % 7 == 6:
        rects += [(5.0, 5.0, 47.0, 39.0), (1000.0, 3.0, 1020.0, 13.0), (1.0, 1.0, 1.5, 1.5)]
    chars = [("ab ﬁ9é𝒳"[dice.randrange(7)], dice.randrange(0, 1600) / 4, dice.randrange(0, 900) / 4) for _ in range(dice.randrange(150))]
    return rects, chars


def placed(pages):
    """What table_arrays.RuledPages wants of rows with doc_id."""

    def place(part, page):
        rects = [(p, *r) for p, d in zip(page.tolist(), part["doc_id"].to_pylist(), strict=True) for r in pages[d][0]]
        chars = [(p, i, ord(c), x, y) for p, d in zip(page.tolist(), part["doc_id"].to_pylist(), strict=True) for i, (c, x, y) in enumerate(pages[d][1])]
        n, seq, code, x, y = (np.array(c) for c in zip(*chars, strict=True)) if chars else [np.zeros(0, np.int64)] * 5
        sides = table_arrays.rect_sides(*[np.array(c) for c in zip(*rects, strict=True)]) if rects else [[np.zeros(0, np.int64)] * 4] * 2
        c = {"page": n, "seq": seq, "code": code.astype(np.uint32), "x0": x * 1.0, "x1": x + 4.0, "top": y * 1.0, "bottom": y + 6.0, "doctop": y * 1.0, "size": np.full(len(n), 6.0), "upright": np.ones(len(n), bool)}
        return *sides, c

    return place


@pytest.mark.parametrize("settings", [tables.TableSettings(), tables.TableSettings(snap_x_tolerance=0, snap_y_tolerance=0.5, join_x_tolerance=0, intersection_x_tolerance=0, edge_min_length=17)])
def test_slots_are_those_of_rows(spark, monkeypatch, settings):
    pages = {k: page_of(k) for k in range(120)}
    rects = spark.createDataFrame([(k, 1, i, *r) for k, (rs, _) in pages.items() for i, r in enumerate(rs)], f"doc_id long, page_no int, seq long, {', '.join(f'{c} double' for c in BOX)}")
    chars = spark.createDataFrame([(k, 1, i, c, x, x + 4.0, y, y + 6.0, y, 6.0, True) for k, (_, cs) in pages.items() for i, (c, x, y) in enumerate(cs)], "doc_id long, page_no int, seq long, text string, x0 double, x1 double, top double, bottom double, doctop double, size double, upright boolean")
    columns = ["doc_id", "page_no", "table", "row_index", "column_index", "text"]
    wanted = tables.extract_cells(tables.find_tables(geometry.rect_edges(rects), settings), chars).select(columns)
    rows = spark.createDataFrame([(k, 1) for k in pages], "doc_id long, page_no int").coalesce(1).sortWithinPartitions("doc_id")
    got = table_arrays.extract_cells(table_arrays.RuledPages(rows, placed(pages)), settings)
    key = lambda r: str(tuple(r))
    a, b = (sorted(map(tuple, df.collect()), key=key) for df in (wanted, got))
    assert a == b and len(a) > 400 and {None, ""} < {r[-1] for r in a}
    assert [f.dataType for f in got.schema] == [f.dataType for f in wanted.schema]


def test_passes_hold_whole_pages(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(table_arrays, "PASS_ROWS", 4)
    key = [None, None, 1, 1, 1, 1, 1, 1, 2, 3, 3, 4, 5]
    batches = [pa.RecordBatch.from_pydict({"doc_id": pa.array(key[i : i + 3], pa.int64()), "page_no": pa.array([1] * len(key[i : i + 3]), pa.int32())}) for i in range(0, len(key), 3)]
    assert [p["doc_id"].to_pylist() for p in table_arrays._passes(iter([batches[0].slice(0, 0), *batches]))] == [[None, None, 1, 1, 1, 1, 1, 1], [2, 3, 3, 4], [5]]
    assert list(table_arrays._passes(iter([]))) == []


def test_far_apart_places_do_not_overflow():
    n = 3000
    at = np.arange(n) * 1e9 + 0.5
    page = np.arange(n) * 10**6
    got = table_arrays.merged((page, at, at, at + 7), 1.0, 3.0, 3.0, 3.0)
    assert all((a == b).all() for a, b in zip(got, (page, at, at, at + 7), strict=True))


def test_other_strategies_are_for_rows():
    with pytest.raises(ValueError):
        table_arrays.extract_cells(None, tables.TableSettings("text", "text"), words.TextSettings())


def test_ruled_pages_and_the_plan(spark, tmp_path):
    """Pages with a null key, null and wide texts, equal rows; no row an edge or a character in the query's plan."""
    rows = [(k, a, b) for k in (None, 7, 8) for a, b in ((3, "x y"), (None, "ﬁé"), (3, "x y"), (1, None), (12, "𝒳 "))]
    df = spark.createDataFrame(rows, "k long, a int, b string")
    got = {tuple(r) for r in table_arrays.extract_cells(G.ruled_pages(df, "k", ["a", "b"])).select("doc_id", "row_index", "column_index", "text").collect()}
    texts = [("", "fié"), ("1", ""), ("3", "x y"), ("3", "x y"), ("12", "𝒳")]
    assert got == {(k, i, j, t) for k in (None, 7, 8) for i, row in enumerate(texts) for j, t in enumerate(row)}
    spark.createDataFrame([(1, 1, 2, 3, "A", "B")], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string, l_linestatus string").write.parquet(str(tmp_path / "lineitem.parquet"))
    plan = queries.extract_tables(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Window" not in plan and "Join" not in plan and "Generate" not in plan
