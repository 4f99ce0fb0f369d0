import pytest
from pyspark.sql import functions as F

from pagestrata.functions import text as T
from pagestrata.operators import cluster, geometry, layout, pages, tables, words

CHAR = "doc_id int, page_no int, seq long, text string, x0 double, x1 double, top double, bottom double, doctop double, size double, upright boolean, fontname string"


def chars(spark, rows):
    return spark.createDataFrame([(1, 1, i, t, float(x0), float(x1), float(top), float(top + 10), float(top), 10.0, up, "f") for i, (t, x0, x1, top, up) in enumerate(rows)], CHAR)


def flat(spark, text, top=0, at=0):
    return [(c, at + 6 * i, at + 6 * i + 6, top, True) for i, c in enumerate(text)]


def test_words(spark):
    df = chars(spark, [*flat(spark, "one two"), *flat(spark, "ab", 0, 60), ("ﬁ", 0, 6, 20, True), ("t", 6, 12, 21, True), ("u", 0, 6, 40, False), ("v", 0, 6, 52, False)])
    got = [(r["text"], r["x0"], r["x1"], r["direction"]) for r in words.extract_words(df).orderBy("word").collect()]
    assert got == [("one", 0, 18, "ltr"), ("two", 24, 42, "ltr"), ("ab", 60, 72, "ltr"), ("fit", 0, 12, "ltr"), ("uv", 0, 6, "ttb")]
    assert words.extract_text(df.filter("upright")).first()["text"] == "one two ab\nfit"
    marks = words.extract_words(chars(spark, flat(spark, "a,b.c")), words.TextSettings(split_at_punctuation=True)).orderBy("word").collect()
    assert [r["text"] for r in marks] == ["a", ",", "b", ".", "c"]
    right = words.extract_words(chars(spark, flat(spark, "abc")), words.TextSettings(char_dir="rtl")).first()["text"]
    assert right == "cba"
    with pytest.raises(ValueError):
        words.TextSettings(line_dir="ltr", char_dir="rtl")


def test_layout_text(spark):
    frame = spark.createDataFrame([(1, 1, 145.0, 65.0)], "doc_id int, page_no int, width double, height double")
    df = chars(spark, [*flat(spark, "ab", 0, 0), *flat(spark, "cd", 0, 72.5), *flat(spark, "e", 39, 7.25)])
    got = words.layout_text(df, frame).first()["text"].split("\n")
    assert got == ["ab        cd".ljust(20), " " * 20, " " * 20, " e".ljust(20), " " * 20]


def test_dedupe_and_search(spark):
    df = chars(spark, [*flat(spark, "aab"), ("a", 0.5, 6.5, 0.5, True)])
    assert [r["seq"] for r in words.dedupe_chars(df).orderBy("seq").collect()] == [0, 1, 2]
    lines = words.text_lines(chars(spark, flat(spark, "x1 y22 x3")))
    assert [(r["text"], r["start"]) for r in words.search_lines(lines, r"[xy]\d+").orderBy("match").collect()] == [("x1", 0), ("y22", 3), ("x3", 7)]
    assert words.search_lines(lines, ".", regex=False).count() == 0


def edges(spark, rows):
    schema = "doc_id int, page_no int, seq int, object_type string, orientation string, x0 double, top double, x1 double, bottom double, width double, height double"
    return spark.createDataFrame([(1, 1, i, "line", o, *map(float, b), float(b[2] - b[0]), float(b[3] - b[1])) for i, (o, b) in enumerate(rows)], schema)


def test_edges(spark):
    e = edges(spark, [("h", (0, 10, 50, 10)), ("h", (52, 12, 90, 12)), ("h", (100, 10, 120, 10)), ("v", (5, 0, 5, 9)), (None, (0, 0, 3, 3))])
    snapped = cluster.snap_edges(e, ["doc_id", "page_no"])
    assert {round(r["top"], 6) for r in snapped.filter("orientation = 'h'").collect()} == {round(32 / 3, 6)} and snapped.count() == 4
    got = cluster.merge_edges(e, ["doc_id", "page_no"]).orderBy("orientation", "x0").collect()
    assert [(r["orientation"], r["x0"], r["x1"]) for r in got] == [("h", 0, 90), ("h", 100, 120), ("v", 5, 5)]
    runs = cluster.cluster_runs(spark.createDataFrame([(1, i, v) for i, v in enumerate([1.0, 2.0, 9.0, 1.5])], "k int, seq int, v double"), ["k"], F.col("v"), 1.0)
    assert [r["run"] for r in runs.orderBy("seq").collect()] == [0, 0, 1, 2]
    rows = cluster.cluster_1d(spark.createDataFrame([(1.0,), (1.0,), (2.0,)], "v double").withColumn("k", F.lit(1)), ["k"], F.col("v"), 0.0)
    assert sorted(r["cluster"] for r in rows.collect()) == [0, 0, 1]


def test_table_with_missing_side_and_spans(spark):
    grid = [("h", (0, y, 200, y)) for y in (0, 50, 100)] + [("v", (x, 0, x, 100)) for x in (0, 200)] + [("v", (100, 50, 100, 100))]
    found = tables.find_tables(edges(spark, grid))
    text = chars(spark, [("A", 40, 46, 20, True), ("B", 40, 46, 70, True), ("C", 140, 146, 70, True)])
    assert tables.extract_tables(found, text).first()["rows"] == [["A", None], ["B", "C"]]
    spans = tables.with_spans(found).orderBy("row_index", "column_index").collect()
    assert [(r["row_span"], r["column_span"]) for r in spans] == [(1, 2), (1, 1), (1, 1)]
    assert tables.largest_table(found).first()["cells"] == 3
    alone = edges(spark, grid[:2] + [("v", (0, 0, 0, 50)), ("v", (200, 0, 200, 50))])
    assert tables.find_tables(alone).count() == 0


def test_text_strategy(spark):
    rows = [c for r in range(4) for k in range(3) for c in flat(spark, f"w{r}{k}", 20 * r, 60 * k)]
    w = words.extract_words(chars(spark, rows))
    none = edges(spark, [("h", (0, 0, 1, 0))]).limit(0)
    found = tables.find_tables(none, tables.TableSettings("text", "text"), w)
    got = [[c for c in r if c] for r in tables.extract_tables(found, chars(spark, rows)).first()["rows"]]
    assert [r for r in got if r] == [[f"w{r}{k}" for k in range(3)] for r in range(4)]
    with pytest.raises(ValueError):
        tables.table_edges(none, tables.TableSettings("explicit", "lines"))


def test_settings():
    s = tables.TableSettings.resolve({"snap_tolerance": 5, "snap_x_tolerance": 1, "text_tolerance": 2, "text_y_tolerance": 4, "text_settings": {"keep_blank_chars": True}})
    assert (s.snap_x_tolerance, s.snap_y_tolerance, s.text.x_tolerance, s.text.y_tolerance, s.text.keep_blank_chars) == (1, 5, 2, 4, True)
    with pytest.raises(TypeError):
        tables.TableSettings.resolve({"snap": 1})
    with pytest.raises(ValueError):
        tables.TableSettings(vertical_strategy="magic")


def test_crops(spark):
    df = chars(spark, [("a", 0, 6, 0, True), ("b", 6, 12, 0, True), ("c", 20, 26, 0, True)])
    assert [(r["text"], r["x0"], r["x1"]) for r in geometry.crop(df, (3, 2, 12, 8)).orderBy("seq").collect()] == [("a", 3, 6), ("b", 6, 12)]
    assert geometry.within_box(df, (0, 0, 12, 10)).count() == 2 and geometry.outside_box(df, (0, 0, 12, 10)).count() == 1
    assert geometry.intersects_box(df, (12, 10, 14, 12)).count() == 0  # corners that touch
    with pytest.raises(ValueError):
        geometry.check_box((5, 5, 5, 9))
    with pytest.raises(ValueError):
        geometry.check_box((0, 0, 11, 5), (0, 0, 10, 10))


def test_reading_order():
    # two columns: the left one first
    left, right, foot = (0, 50, 40, 90, False), (60, 50, 100, 90, False), (0, 0, 100, 10, False)
    assert layout.reading_order([right, foot, left], 0.5) == [1, 2, 0]
    assert layout.reading_order([right, foot, left], None) == [1, 2, 0]
    assert layout.neighbour_groups([(0, 0, 10, 2, False), (0, 2.5, 10, 4.5, False), (20, 0, 30, 2, False)], 0.5) == [0, 0, 2]


def test_pages_and_text(spark):
    p = spark.createDataFrame([(1, n, 100.0 * n) for n in (1, 2, 3)], "doc_id int, page_no int, height double")
    assert [r["initial_doctop"] for r in pages.with_doctop(pages.select_pages(p, [3, 1])).orderBy("page_no").collect()] == [0, 100]
    assert pages.parse_page_spec("1,3-5") == [1, 3, 4, 5]
    one = spark.range(1)
    got = one.select(T.roman(F.lit(1994)), T.letters(F.lit(703)), T.date_to_iso(F.lit("D:2024")), T.date_to_iso(F.lit("x")), T.shorten(F.lit("abcdefghijkl"), 9), T.big_endian(F.lit(b"\x01\x00")), T.escape_csv(F.lit('a"b')), T.expand_ligature(F.lit("ﬃ"))).first()
    assert tuple(got) == ("mcmxciv", "aaa", "2024", None, "ab ... kl", 256, '"a""b"', "ffi")
    assert one.select(T.normalize("NFKC")(F.lit("ﬁx")).alias("t")).first()["t"] == "fix"
