import zlib

import pytest
from pdf_writer import GRID, TEXT, build, document, stream
from pyspark.sql import functions as F

from pagestrata.operators import geometry, layout, pages, tables, words
from pagestrata.sources import sinks
from pagestrata.sources.pdf import reader, syntax
from pagestrata.streaming import files as streams


def files(spark, **docs):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in docs.items()], "doc_id string, content binary")


@pytest.mark.parametrize("kind", ["plain", "flate", "hex", "a85"])
def test_text(spark, kind):
    f = files(spark, a=document([TEXT, TEXT], kind))
    got = words.extract_text(reader.chars(f)).orderBy("page_no").collect()
    assert [r["text"] for r in got] == ["Hello, World\nsecond"] * 2
    first = reader.chars(f).filter("page_no = 2 and text = 'H'").first()
    assert (first["x0"], first["x1"], first["y0"], first["top"], first["doctop"], first["size"]) == (10, 16, 80 - 1.94, pytest.approx(11.94), pytest.approx(111.94), pytest.approx(10))


def test_damaged_and_rotated(spark):
    f = files(spark, broken=document([TEXT], broken=True), cut=document([TEXT])[:-60], turned=document([TEXT], rotate=90), junk=b"no such file", empty=b"")
    docs = {r["doc_id"]: r for r in reader.documents(f).collect()}
    assert docs["broken"]["page_count"] == docs["cut"]["page_count"] == 1 and docs["junk"]["error"] and docs["empty"]["error"]
    assert docs["broken"]["info"]["Title"] == "A (test)"
    texts = {r["doc_id"]: r["text"] for r in words.extract_text(reader.chars(f)).collect()}
    assert texts["broken"] == texts["cut"] == "Hello, World\nsecond" and "junk" not in texts
    page = reader.pages(f).filter("doc_id = 'turned'").first()
    assert (page["width"], page["height"], page["rotate"]) == (100, 200, 90)
    with pytest.raises(Exception, match="junk"):
        reader.pages(f, strict=True).collect()


def test_object_streams(spark):
    packed = [(1, b"<< /Type /Catalog /Pages 2 0 R >>"), (2, b"<< /Type /Pages /Kids [4 0 R] /Count 1 >>"), (4, b"<< /Type /Page /MediaBox [0 0 200 100] /Contents 11 0 R /Resources << /Font << /F1 << /Type /Font /Subtype /Type1 /BaseFont /Courier >> >> >> >>")]
    heads, body = b"", b""
    for n, b in packed:
        heads += b"%d %d " % (n, len(body))
        body += b + b" "
    inner = zlib.compress(heads + body)
    out = bytearray(b"%PDF-1.5\n")
    at10 = len(out)
    out += b"10 0 obj\n<< /Type /ObjStm /N 3 /First %d /Filter /FlateDecode /Length %d >>\nstream\n" % (len(heads), len(inner)) + inner + b"\nendstream\nendobj\n"
    at11 = len(out)
    out += b"11 0 obj\n" + stream(TEXT) + b"\nendobj\n"
    at12 = len(out)
    rows = [(0, 0, 0), (2, 10, 0), (2, 10, 1), (0, 0, 0), (2, 10, 2), *[(0, 0, 0)] * 5, (1, at10, 0), (1, at11, 0), (1, at12, 0)]
    table = zlib.compress(b"".join(bytes([a]) + b.to_bytes(3, "big") + bytes([c]) for a, b, c in rows))
    out += b"12 0 obj\n<< /Type /XRef /Size 13 /W [1 3 1] /Root 1 0 R /Filter /FlateDecode /Length %d >>\nstream\n" % len(table) + table + b"\nendstream\nendobj\nstartxref\n%d\n%%%%EOF" % at12
    assert [r["text"] for r in words.extract_text(reader.chars(files(spark, a=bytes(out)))).collect()] == ["Hello, World\nsecond"]


def test_filters():
    assert syntax.run_length(bytes([2]) + b"abc" + bytes([254]) + b"x" + bytes([128])) == b"abcxxx"
    assert syntax.lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])
    assert syntax.predict(bytes([2, 1, 2, 3, 2, 1, 1, 1]), {"Predictor": 12, "Columns": 3}) == bytes([1, 2, 3, 2, 3, 4])
    lex = syntax.Lexer(b"<< /A#20b (x\\051\\n) /C [1 -.5 true null 3 0 R] /D <4a4> >> % end\n")
    assert lex.object() == {"A b": b"x)\n", "C": [1, -0.5, True, None, syntax.Ref(3, 0)], "D": b"J@"}


def test_table_and_layout(spark):
    f = files(spark, a=document([GRID]))
    shapes, chars = reader.shapes(f), reader.chars(f)
    edges = geometry.line_edges(shapes.filter("object_type = 'line'"))
    found = tables.find_tables(edges)
    assert [r["rows"] for r in tables.extract_tables(found, chars).collect()] == [[["A", "B"], ["C", "D"]]]
    assert sinks.tables_csv(tables.extract_cells(found, chars)).first()["csv"] == "--- Page 1 Table 1 ---\nA,B\nC,D\n"
    assert sinks.tables_json(tables.extract_tables(found, chars)).first()["json"] == '[{"page":1,"table":0,"rows":[["A","B"],["C","D"]]}]'
    flat = sinks.flat_tables(tables.extract_tables(found, chars)).first()
    assert (flat["cells"], flat["row_offsets"], flat["table_offsets"]) == (["A", "B", "C", "D"], [0, 2, 4], [0, 2])
    lines = layout.layout_lines(chars)
    text = layout.page_text(layout.layout_boxes(lines)).first()["text"]
    assert text.endswith("\f") and set(text.split()) == {"A", "B", "C", "D"}
    assert "<textline" in sinks.lines_xml(layout.layout_boxes(lines)).first()["xml"]


def test_labels_outline_marks(spark):
    tagged = b"/P << /MCID 0 >> BDC BT /F1 10 Tf 10 80 Td (one) Tj ET EMC /P << /MCID 1 >> BDC BT /F1 10 Tf 10 60 Td (two) Tj ET EMC"
    f = files(spark, a=document([tagged, TEXT, TEXT]))
    labelled = pages.with_labels(reader.pages(f).select("doc_id", "page_no"), reader.page_labels(f))
    assert [r["page_label"] for r in labelled.orderBy("page_no").collect()] == ["i", "A-5", "A-6"]
    assert [(r["level"], r["title"]) for r in reader.outline(f).orderBy("position").collect()] == [(1, "One"), (1, "Two")]
    assert sorted((r["mcid"], r["text"]) for r in reader.mcid_text(reader.chars(f)).collect()) == [(0, "one"), (1, "two")]


def test_form_that_calls_itself(spark):
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>",
        2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>",
        3: b"<< /Type /Page /MediaBox [0 0 10 10] /Contents 4 0 R /Resources << /XObject << /X 5 0 R >> >> >>",
        4: stream(b"/X Do 1 1 4 4 re f"),
        5: b"<< /Type /XObject /Subtype /Form /Resources << /XObject << /X 5 0 R >> >> /Length 16 >>\nstream\n/X Do 0 0 m 9 9 l S\nendstream",
    }
    got = reader.shapes(files(spark, a=build(objects))).groupBy("object_type").count().collect()
    assert {r["object_type"]: r["count"] for r in got} == {"line": 1, "rect": 1}


def test_file_stream(spark, tmp_path):
    for i in range(3):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{i}.pdf").write_bytes(document([TEXT]))
    plan = lambda f: words.extract_text(reader.chars(f.select("doc_id", "content")))
    streams.run_stream(streams.file_stream(spark, str(tmp_path / "in"), files_per_batch=2), plan, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    batch = plan(reader.open_files(spark, str(tmp_path / "in")))
    got = spark.read.parquet(str(tmp_path / "out")).select(*batch.columns)
    assert got.exceptAll(batch).count() == 0 and got.count() == 3
    rows = list(streams.ordered_rows(spark.range(20).select(F.col("id")), "id"))
    assert [r["id"] for r in rows] == list(range(20))
