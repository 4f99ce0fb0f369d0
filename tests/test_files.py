"""Page files: encryption, fonts, codes, images, what files say of themselves, failures, verbs, sinks, streams."""

import asyncio
import hashlib
import struct
import zlib

import pytest
from pdf_writer import GRID, TEXT, build, document, stream
from pyspark.sql import functions as F

from pagestrata import cli
from pagestrata.operators import geometry, layout, tables
from pagestrata.plans import verbs
from pagestrata.sources import sinks
from pagestrata.sources.pdf import catalog, cmaps, images, metrics, reader, security, writer
from pagestrata.sources.pdf.content import Font, Page, encoding, glyph_text
from pagestrata.sources.pdf.syntax import File, Name, text_of
from pagestrata.streaming import files as streams


def files(spark, **docs):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in docs.items()], "doc_id string, content binary")


def one_page(content, resources=b"", objects=(), catalog_more=b"", page_more=b""):
    out = {
        1: b"<< /Type /Catalog /Pages 2 0 R " + catalog_more + b" >>",
        2: b"<< /Type /Pages /Kids [20 0 R] /Count 1 >>",
        20: b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 200 100] /Contents 21 0 R /Resources << " + resources + b" >> " + page_more + b" >>",
        21: stream(content),
        9: b"<< /Producer (none) >>",
    }
    return build(out | dict(objects))


def run(data, password=""):
    file = File(data, password)
    return Page(file, next(file.pages())).run()


MODEL = "Hello (World) ünï\n\n  second \\ line שלום 𝒳\n" + "\n".join(f"line {i}" for i in range(70))


@pytest.mark.parametrize("kind", [*writer.KINDS, writer.SLOW])
def test_every_kind_of_file_gives_the_same_characters(kind):
    file = File(writer.document(MODEL, kind))
    lines = MODEL.split("\n")
    for n, d in enumerate(file.pages()):
        page = Page(file, d).run()
        want = [(c, 6.0 * i, 6.0 * i + 6, 12.0 * j, 12.0 * j + 10) for j, line in enumerate(lines[64 * n : 64 * n + 64]) for i, c in enumerate(line)]
        assert [(c["text"], c["x0"], c["x1"], page.height - c["y1"], page.height - c["y0"]) for c in page.chars] == want
    assert file.encrypted == (kind in ("rc4", "aes128", "aes256", writer.SLOW)) and file.recovered == (kind == "broken")


@pytest.mark.parametrize("kind", ["rc4", "aes128", "aes256"])
def test_passwords(kind):
    data = writer.document("secret text", kind)
    assert File(data, writer.PASSWORD).security.allows(5)
    with pytest.raises(security.PasswordError):
        File(data, "wrong")


def test_ciphers_against_published_vectors():
    plain = bytes.fromhex("00112233445566778899aabbccddeeff")
    for n, want in ((16, "69c4e0d86a7b0430d8cdb78070b4c55a"), (32, "8ea2b7ca516745bfeafc49904b496089")):
        sealed = security.aes_encrypt(bytes(range(n)), bytes(16), plain)
        assert sealed.hex() == want and security.aes_decrypt(bytes(range(n)), bytes(16), sealed) == plain
    data = bytes(range(256)) * 3
    iv = hashlib.md5(b"iv").digest()
    assert security.unpad(security.aes_decrypt(b"k" * 16, iv, security.aes_encrypt(b"k" * 16, iv, security.pad(data)))) == data
    assert security.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3" and security.rc4(b"Wiki", b"pedia").hex() == "1021bf0420"
    assert security.unpad(b"no padding here!") == b"no padding here!"


def test_saslprep():
    assert security.saslprep("I\u00adX") == "IX" and security.saslprep("\u2168") == "IX" and security.saslprep("a\u00a0b") == "a b"
    for bad in ("\u0007", "\u0627\u0031", "a\u0627"):
        with pytest.raises(ValueError):
            security.saslprep(bad)


def test_fonts_without_widths():
    font = b"/Font << /F1 << /Type /Font /Subtype /Type1 /BaseFont /%s >> >>"
    page = run(one_page(b"BT /F1 10 Tf 10 50 Td (WiX) Tj ET", font % b"Helvetica"))
    assert [(round(c["x0"], 3), round(c["x1"], 3)) for c in page.chars] == [(10, 19.44), (19.44, 21.66), (21.66, 28.33)]
    assert round(page.chars[0]["y0"], 3) == 47.93
    assert run(one_page(b"BT /F1 10 Tf (a) Tj ET", font % b"Unheard")).chars[0]["y0"] == -2.5
    assert metrics.standard_name("Arial,BoldItalic") == "Helvetica-Bold" and metrics.standard_name("Symbol") is None and metrics.width("Times-Roman", "é") == 0.444
    assert not run(one_page(b"BT /F1 10 Tf 3 Tr (hidden) Tj 7 Tr (clip) Tj ET", font % b"Helvetica")).chars


def test_encodings_and_glyph_names():
    assert encoding("StandardEncoding")[39] == "’" and encoding("WinAnsiEncoding")[39] == "'" and encoding("MacRomanEncoding")[0xA5] == "•"
    names = {"A": "A", "eacute": "é", "f_f_i": "ffi", "uni00410042": "AB", "u1F600": "😀", "Scaron.alt": "Š", "ampersand": "&", "seven": "7", "alpha": "α", ".notdef": None, "nosuchname": None, "uniD800": None}
    assert {n: glyph_text(n) for n in names} == names
    assert text_of(b"\x84\xa0") == "—€" and text_of(b"\xfe\xff\x05\xd0") == "א"


def test_codes_of_several_lengths():
    data = b"1 begincodespacerange <00> <80> endcodespacerange 1 begincodespacerange <8140> <9ffc> endcodespacerange 1 beginbfchar <41> <0058> endbfchar 1 beginbfrange <8140> <8142> <0061> endbfrange 1 begincidrange <41> <42> 7 endcidrange /WMode 1 def"
    m = cmaps.parse_cmap(data)
    assert list(m.codes(b"A\x81\x41B")) == [(0x41, 1), (0x8141, 2), (0x42, 1)] and m.texts[0x8141] == "b" and m.cid(0x42) == 8 and m.vertical
    sjis = cmaps.predefined("90ms-RKSJ-V")
    assert sjis.vertical and "".join(sjis.text(c, n) for c, n in sjis.codes("aあ漢".encode("cp932"))) == "aあ漢"
    for name, codec in (("GBK-EUC-H", "gbk"), ("ETen-B5-H", "big5"), ("KSCms-UHC-H", "cp949"), ("UniJIS-UTF16-H", "utf-16-be"), ("UniGB-UTF32-H", "utf-32-be")):
        m = cmaps.predefined(name)
        text = "中" if codec != "cp949" else "한"
        assert "".join(m.text(c, n) for c, n in m.codes(text.encode(codec))) == text
    assert cmaps.predefined("H").text(0x2422, 2) == "あ"


def truetype(tables_):
    head = struct.pack(">HH", 0, len(tables_))
    at, body = 4 + 8 * len(tables_), b""
    for platform, kind, data in tables_:
        head += struct.pack(">HHI", platform, kind, at + len(body))
        body += data
    whole = head + body
    return struct.pack(">IHHHH", 0x10000, 1, 0, 0, 0) + struct.pack(">4sIII", b"cmap", 0, 28, len(whole)) + whole


def test_truetype_tables():
    four = struct.pack(">HHHHHHH", 4, 32, 0, 4, 0, 0, 0) + struct.pack(">2H", 66, 0xFFFF) + b"\0\0" + struct.pack(">2H", 65, 0xFFFF) + struct.pack(">2H", (3 - 65) & 65535, 1) + struct.pack(">2H", 0, 0)
    assert cmaps.truetype_texts(truetype([(3, 1, four)])) == {3: "A", 4: "B"}
    zero = struct.pack(">HHH", 0, 262, 0) + bytes(9 if c == 67 else 0 for c in range(256))
    six = struct.pack(">HHHHH", 6, 12, 0, 48, 2) + struct.pack(">2H", 5, 6)
    twelve = struct.pack(">HHIII", 12, 0, 28, 0, 1) + struct.pack(">III", 0x1F600, 0x1F601, 20)
    assert cmaps.truetype_texts(truetype([(0, 3, zero), (0, 3, six), (3, 10, twelve)])) == {9: "C", 5: "0", 6: "1", 20: "\U0001f600", 21: "\U0001f601"}
    two = struct.pack(">HHH", 2, 0, 0) + struct.pack(">256H", *[8 if h == 0x81 else 0 for h in range(256)]) + struct.pack(">HHhH", 65, 1, 0, 10) + struct.pack(">HHhH", 0x40, 1, 0, 4) + struct.pack(">2H", 2, 3)
    assert cmaps.truetype_texts(truetype([(3, 1, two)])) == {2: "A", 3: chr(0x8140)}
    assert cmaps.truetype_texts(b"damaged") == {}


def test_embedded_and_vertical_fonts():
    four = struct.pack(">HHHHHHH", 4, 32, 0, 4, 0, 0, 0) + struct.pack(">2H", 66, 0xFFFF) + b"\0\0" + struct.pack(">2H", 65, 0xFFFF) + struct.pack(">2H", (3 - 65) & 65535, 1) + struct.pack(">2H", 0, 0)
    program = truetype([(3, 1, four)])
    objects = {
        5: b"<< /Type /Font /Subtype /Type0 /BaseFont /T /Encoding /Identity-V /DescendantFonts [6 0 R] >>",
        6: b"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /T /CIDSystemInfo << /Registry (Adobe) /Ordering (Identity) /Supplement 0 >> /FontDescriptor 7 0 R /DW2 [900 -500] >>",
        7: b"<< /Type /FontDescriptor /Descent -200 /FontFile2 8 0 R >>",
        8: b"<< /Length %d >>\nstream\n" % len(program) + program + b"\nendstream",
    }
    page = run(one_page(b"BT /F1 10 Tf 50 90 Td <000300040009> Tj ET", b"/Font << /F1 5 0 R >>", objects))
    assert [c["text"] for c in page.chars] == ["A", "B", "(cid:9)"]
    a, b = page.chars[:2]
    assert (a["x0"], a["x1"], a["y1"], a["y0"]) == (45, 55, 91, 86) and b["y1"] == 86


def fax(rows, columns):
    """Group 4 data of rows of changes, by vertical and horizontal modes only."""
    white, black = ({n: c for c, n in images.run_codes(k).items()} for k in (False, True))

    def length(n, table):
        out = ""
        while n >= 64:
            part = min(2560, n // 64 * 64)
            out, n = out + table[part], n - part
        return out + table[n]

    bits, above = "", []
    for row in rows:
        edges, a0, dark, at = [*row, columns], -1, False, 0
        while a0 < columns:
            b1 = next((x for i, x in enumerate(above) if x > a0 and (i % 2 == 1) == dark), columns)
            a1 = edges[at] if at < len(edges) else columns
            step = {v: k for k, v in images._MODES.items() if isinstance(v, int)}.get(a1 - b1)
            if step:
                bits, a0, dark, at = bits + step, a1, not dark, at + 1
            else:
                a2 = edges[at + 1] if at + 1 < len(edges) else columns
                tables_ = (black, white) if dark else (white, black)
                bits += "001" + length(a1 - max(a0, 0), tables_[0]) + length(a2 - a1, tables_[1])
                a0, at = a2, at + 2
        above = row
    bits += "000000000001" * 2
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


def test_fax_round_trip():
    import random

    rng = random.Random(4)
    for columns in (9, 64, 300, 3000):
        rows = [sorted(rng.sample(range(1, columns), rng.randint(0, min(8, columns - 1)))) for _ in range(20)]
        rows[3] = [0, *[x for x in rows[3] if x]]
        assert images.fax_rows(fax(rows, columns), columns) == rows
    out = images.fax_decode(fax([[2, 4]], 9), {"K": -1, "Columns": 9})
    assert out == bytes([0b11001111, 0b10000000]) and images.fax_decode(fax([[2, 4]], 9), {"K": -1, "Columns": 9, "BlackIs1": True}) == bytes([0b00110000, 0])
    with pytest.raises(ValueError):
        images.fax_decode(b"", {"K": 0})


def test_images():
    gray, jpeg = bytes(range(6)), b"\xff\xd8 not really"
    seg = struct.pack(">IBBBI", 0, 48, 0, 1, 3) + b"abc"
    image = lambda more, data: b"<< /Type /XObject /Subtype /Image /Width 3 /Height 2 %s /Length %d >>\nstream\n" % (more, len(data)) + data + b"\nendstream"
    objects = {
        5: image(b"/BitsPerComponent 8 /ColorSpace /DeviceGray", gray),
        6: image(b"/Filter /DCTDecode /BitsPerComponent 8 /ColorSpace /DeviceRGB", jpeg),
        7: image(b"/Filter /JBIG2Decode /BitsPerComponent 1", seg),
        8: image(b"/BitsPerComponent 8 /ColorSpace /DeviceCMYK", bytes(24)),
    }
    content = b"q 30 0 0 20 10 10 cm /G Do /J Do /B Do /C Do Q q 5 0 0 5 0 0 cm BI /W 8 /H 1 /BPC 1 /IM true ID \xaa EI Q"
    page = run(one_page(content, b"/XObject << /G 5 0 R /J 6 0 R /B 7 0 R /C 8 0 R >>", objects))
    assert [i["name"] for i in page.images] == ["G", "J", "B", "C", "inline4"]
    assert (page.images[0]["x0"], page.images[0]["y1"], page.images[4]["x1"], page.images[4]["imagemask"]) == (10, 30, 5, True)
    made = [images.export(page.file, i["stream"]) for i in page.images]
    assert [e for e, _ in made] == ["bmp", "jpg", "jb2", "bin", "bmp"] and made[1][1] == jpeg
    head = made[0][1]
    assert head[:2] == b"BM" and struct.unpack_from("<IHHIIii", head, 2) == (len(head), 0, 0, 54 + 1024, 40, 3, 2) and head[-8:] == bytes([3, 4, 5, 0, 0, 1, 2, 0])
    assert made[2][1].startswith(b"\x97JB2\r\n\x1a\n\x01\0\0\0\x01" + seg) and len(images.jbig2_segments(made[2][1][13:])) == 3
    assert images.file_name(7, "a b/c", 2, "jpg") == "page-0007-a_b_c_2.jpg"


FULL = {
    1: b"<< /Type /Catalog /Pages 2 0 R /Outlines 5 0 R /Dests << /old [22 0 R /Fit] >> /Names << /Dests << /Kids [11 0 R] >> /EmbeddedFiles << /Names [(a) 12 0 R] >> /JavaScript << >> >> /StructTreeRoot 14 0 R /Metadata 30 0 R /AcroForm << /Fields [] >> >>",
    2: b"<< /Type /Pages /Kids [20 0 R 22 0 R] /Count 9 /MediaBox [0 0 200 100] /Resources << /Font << /F1 3 0 R >> >> >>",
    3: b"<< /Type /Font /Subtype /Type1 /BaseFont /Courier >>",
    5: b"<< /First 6 0 R >>",
    6: b"<< /Title (One) /Dest (named) /First 8 0 R /Next 7 0 R >>",
    7: b"<< /Title (Web) /A << /S /URI /URI (http://example.org) >> >>",
    8: b"<< /Title (Deep) /A << /S /GoTo /D [20 0 R /Fit] >> >>",
    9: b"<< /Title (T) /Count 3 >>",
    11: b"<< /Limits [(a) (z)] /Names [(named) [22 0 R /XYZ 0 0 0]] >>",
    12: b"<< /Type /Filespec /F (dir/a.txt) /EF << /F 13 0 R >> >>",
    13: b"<< /Length 5 >>\nstream\nhello\nendstream",
    14: b"<< /Type /StructTreeRoot /RoleMap << /Head /H1 >> /ClassMap << /wide << /Width 10 >> >> /K 15 0 R >>",
    15: b"<< /S /Document /K [16 0 R 17 0 R] >>",
    16: b"<< /S /Head /Pg 20 0 R /C /wide /A << /O /Layout >> /T (title) /K [0] >>",
    17: b"<< /S /P /K [<< /Type /MCR /Pg 20 0 R /MCID 1 >> << /Type /OBJR /Obj 9 0 R >>] /Lang (en) >>",
    20: b"<< /Type /Page /Parent 2 0 R /Contents 21 0 R /Annots [24 0 R 25 0 R] >>",
    21: stream(b"/H BDC BT /F1 10 Tf 10 80 Td (no) Tj ET EMC /P << /MCID 0 >> BDC BT /F1 10 Tf 10 60 Td (one) Tj ET EMC /P << /MCID 1 >> BDC BT /F1 10 Tf 10 40 Td (two) Tj ET EMC"),
    22: b"<< /Type /Page /Parent 2 0 R /Contents 23 0 R /Rotate 90 /Annots [24 0 R] >>",
    23: stream(b"BT /F1 10 Tf 10 80 Td (second) Tj ET"),
    24: b"<< /Subtype /Link /Rect [10 20 50 40] /A << /S /URI /URI (http://example.org/x) >> /T (tip) >>",
    25: b"<< /Subtype /Text /Rect [1 2 3 4] /Contents <FEFF0041> >>",
    30: b"<< /Type /Metadata /Length 4 >>\nstream\n<x/>\nendstream",
}


def test_what_a_file_says_of_itself(spark):
    f = files(spark, a=build(FULL))
    assert [(r["level"], r["title"], r["page_no"], r["dest"], r["uri"]) for r in reader.outline(f).orderBy("position").collect()] == [(1, "One", 2, "named", None), (2, "Deep", 1, None, None), (1, "Web", None, None, "http://example.org")]
    assert {(r["name"], r["page_no"]) for r in reader.named_destinations(f).collect()} == {("old", 2), ("named", 2)}
    assert [(r["name"], bytes(r["data"])) for r in reader.embedded_files(f).collect()] == [("a.txt", b"hello")]
    d = reader.documents(f).first()
    assert (d["page_count"], d["declared_pages"], d["form_type"], d["has_javascript"], d["xmp"], d["tagged"], d["info"]["Count"], d["version"]) == (2, 9, "acroform", True, "<x/>", True, "3", "1.7")
    links = {r["page_no"]: r for r in reader.hyperlinks(f).collect()}
    assert (links[1]["x0"], links[1]["top"], links[1]["bottom"], links[1]["title"]) == (10, 60, 80, "tip")
    assert (links[2]["x0"], links[2]["x1"], links[2]["y0"], links[2]["y1"]) == (20, 40, 150, 190)
    assert [r["contents"] for r in reader.annotations(f).filter("subtype = 'Text'").collect()] == ["A"]
    xml = {r["number"]: r["xml"] for r in reader.objects(f, "text").collect()}
    assert xml[13] == '<object id="13">\n<stream>\n<props>\n<dict size="1">\n<key>Length</key>\n<value><number>5</number></value>\n</dict>\n</props>\n<data size="5">hello</data>\n</stream>\n</object>' and '<ref id="1" />' in xml[0]


def test_structure(spark):
    f = files(spark, a=build(FULL))
    elements, chars = reader.structure(f), reader.chars(f)
    got = elements.orderBy("id").collect()
    assert [(r["id"], r["parent"], r["type"], r["page_no"], [m["mcid"] for m in r["mcids"]]) for r in got] == [(0, None, "Document", None, []), (1, 0, "H1", 1, [0]), (2, 0, "P", 1, [1])]
    assert got[1]["attributes"] == {"Width": "10", "O": "Layout"} and (got[1]["title"], got[2]["lang"]) == ("title", "en")
    boxes = {r["id"]: r for r in reader.element_boxes(elements, chars).collect()}
    assert boxes[0]["text"] == "onetwo" and boxes[1]["text"] == "one" and boxes[0]["top"] < boxes[2]["top"]
    assert [r["id"] for r in reader.find_elements(elements, "P").collect()] == [2] and reader.find_elements(elements, lambda e: F.col("lang") == "en", under=0).count() == 1
    texts = {r["id"]: r["json"] for r in sinks.structure_json(elements, reader.mcid_text(chars)).collect()}
    assert '"text":["one"]' in texts[1]
    assert "<P MCID=\"0\">one</P>" in sinks.document_tagged(chars, reader.pages(f)).first()["xml"]


def test_failures_stay_with_their_page(spark):
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>",
        2: b"<< /Type /Pages /Kids [20 0 R 22 0 R] /Count 2 /MediaBox [0 0 200 100] /Resources << /Font << /F1 << /Type /Font /Subtype /Type1 /BaseFont /Courier >> >> >> >>",
        20: b"<< /Type /Page /Parent 2 0 R /Contents 21 0 R >>",
        21: b"<< /Filter /Unheard /Length 3 >>\nstream\nabc\nendstream",
        22: b"<< /Type /Page /Parent 2 0 R /Contents 23 0 R >>",
        23: stream(TEXT),
    }
    locked = writer.document("x", "rc4").replace(b"/P -44", b"/P -60")
    f = files(spark, half=build(objects), shut=locked, fine=document([TEXT]))
    assert {r["doc_id"] for r in reader.chars(f).collect()} == {"half", "fine"}
    assert reader.chars(f).filter("doc_id = 'half'").first()["page_no"] == 2
    problems = {(r["doc_id"], r["page_no"]): r["error"] for r in reader.errors(f).collect()}
    assert set(problems) == {("half", 1), ("shut", None)} and "Unheard" in problems["half", 1]
    assert reader.documents(f).filter("doc_id = 'shut'").first()["error"]
    with pytest.raises(Exception, match="Unheard"):
        reader.chars(f.filter("doc_id = 'half'"), strict=True).collect()
    assert reader.extractable(files(spark, a=document([TEXT]))).count() == 1


def test_repair_and_turns(spark):
    data = document([TEXT]).replace(b"[0 0 200 100]", b"[200 100 0 0]")
    fixed = catalog.repair(data)
    assert len(fixed) == len(data) and b"[0 0 200 100]" in fixed and catalog.repair(fixed) == fixed
    assert b"/MediaBox [1 2 x 4]" in catalog.repair(b"/MediaBox [1 2 x 4]")
    f = files(spark, a=data)
    assert bytes(reader.repair(f).first()["content"]) == fixed
    r = reader.pages(f, turn=90).first()
    assert (r["rotate"], r["width"], r["height"]) == (90, 100, 200)


def test_probe_and_verbs(spark, tmp_path):
    f = files(spark, grid=document([GRID, TEXT]), text=document([TEXT]))
    assert {(r["doc_id"], r["page_no"]) for r in reader.edge_pages(f).filter("has_edges").collect()} == {("grid", 1)}
    for probe in ("auto", "never"):
        assert [r["rows"] for r in verbs.extract_tables(f, probe=probe).collect()] == [[["A", "B"], ["C", "D"]]]
    assert verbs.extract_tables(f, crop=(0.0, 0.0, 90.0, 40.0)).count() <= 1
    assert tables.should_probe(tables.TableSettings()) and not tables.should_probe(tables.TableSettings(vertical_strategy="text"))
    lines, cells = verbs.layout_and_tables(f)
    assert cells.count() == 4 and lines.filter("doc_id = 'text'").count() == 2
    lines.objects.unpersist()
    meta = verbs.extract_table_metadata(f).orderBy("row_index", "column_index").collect()
    assert [(r["text"], r["row_span"]) for r in meta] == [("A", 1), ("B", 1), ("C", 1), ("D", 1)]
    for form, part in (("html", "Page 1"), ("xml", "<textline"), ("hocr", "ocrx_word"), ("tag", "Hello, World"), ("text", "Hello, World")):
        out = verbs.extract_text_to(f, form).filter("doc_id = 'text'").first()
        assert part in out[1], form
    assert 'linewidth="1"' in verbs.extract_text_to(f, "xml").filter("doc_id = 'grid'").first()["xml"]
    for mode in ("exact", "loose"):
        assert "font-family:Courier" in verbs.extract_text_to(f, "html", mode=mode).first()["html"]
    doc = verbs.Document.open(spark, document([TEXT, GRID, TEXT]))
    assert [r["page_no"] for r in doc.select("1,3").pages.orderBy("page_no").collect()] == [1, 3]
    assert doc.page(3).chars.select("doctop").agg(F.min("doctop")).first()[0] > 200
    found = doc.search("(W)or(x)?ld", case=True).orderBy("page_no").collect()
    assert [(r["page_no"], r["text"], r["groups"], round(r["x1"] - r["x0"])) for r in found] == [(1, "World", ["W", None], 30), (3, "World", ["W", None], 30)]
    assert doc.summaries().filter("page_no = 2").first()["shape_count"] == 6 and doc.table_rows().count() == 2 and doc.edges.count() == 6
    listed = doc.to_dict().first()
    assert [len(p["chars"]) for p in listed["pages"]] == [18, 4, 18]
    (tmp_path / "a.pdf").write_bytes(document([TEXT, GRID]))
    args = cli.parser().parse_args(["tables", str(tmp_path / "a.pdf"), "--format", "csv", "--pages", "2"])
    assert cli.run(spark, args).first()["csv"] == "--- Page 2 Table 1 ---\nA,B\nC,D\n"
    args = cli.parser().parse_args(["text", str(tmp_path / "a.pdf"), "--maxpages", "1", "--boxes-flow", "disabled"])
    assert cli.run(spark, args).first()["text"].count("\f") == 1
    with pytest.raises(ValueError):
        reader.check_path(" ")


def test_streams_of_rows(spark):
    f = files(spark, a=document([TEXT, GRID, TEXT]))
    cursor = streams.Cursor(reader.pages(f), "doc_id", "page_no")
    assert cursor.next()["page_no"] == 1 and [r["page_no"] for r in cursor] == [2, 3] and cursor.closed and cursor.next() is None
    other = streams.Cursor(reader.pages(f), "doc_id", "page_no")
    other.next()
    other.cancel()
    assert other.closed and list(other) == []

    async def collect():
        return [r["page_no"] async for r in streams.rows_async(reader.pages(f), "page_no")]

    assert asyncio.run(collect()) == [1, 2, 3]
    pages = streams.PageList(reader.pages(f), "a")
    assert (len(pages), pages[-1]["page_no"], [r["page_no"] for r in pages[::2]], [r["page_no"] for r in pages]) == (3, 3, [1, 3], [1, 2, 3])
    with pytest.raises(IndexError):
        pages[3]


def test_lines_that_run_down(spark):
    rows = [("a", 1, i, c, 10.0, 20.0, 90.0 - 10 * i, 100.0 - 10 * i) for i, c in enumerate("down")]
    rows += [("a", 1, 10 + i, c, 50.0 + 10 * i, 60.0 + 10 * i, 40.0, 50.0) for i, c in enumerate("across")]
    rows += [("a", 1, 30, "x", 150.0, 160.0, 0.0, 10.0)]
    chars = spark.createDataFrame(rows, "doc_id string, page_no int, seq long, text string, x0 double, x1 double, y0 double, y1 double")
    got = [(r["text"], r["vertical"]) for r in layout.layout_lines(chars, layout.LayoutSettings(detect_vertical=True)).orderBy("line").collect()]
    assert got == [("down\n", True), ("across\n", False), ("x\n", False)]
    flat = [r["text"] for r in layout.layout_lines(chars).orderBy("line").collect()]
    assert flat == ["d\n", "o\n", "w\n", "n\n", "across\n", "x\n"]


def test_reading_order_of_columns():
    column = lambda x: [(x, 100.0 - 12 * i, x + 80, 110.0 - 12 * i, False) for i in range(4)]
    boxes = [*column(100.0), *column(0.0)]
    assert layout.reading_order(boxes, 0.5) == [4, 5, 6, 7, 0, 1, 2, 3]
    assert layout.reading_order(boxes, None) == [1, 3, 5, 7, 0, 2, 4, 6]


def test_geometries_of_pages(spark):
    pages = spark.createDataFrame([("a", 1), ("a", 2)], "doc_id string, page_no int")
    boxes = spark.createDataFrame([("a", 1, 0.0, 0.0, 5.0, 5.0), ("a", 2, 0.0, 0.0, 6.0, 6.0)], "doc_id string, page_no int, x0 double, top double, x1 double, bottom double")
    assert geometry.with_geometries(pages, boxes).count() == 2
    for wrong in (boxes.filter("page_no = 1"), boxes.unionByName(boxes)):
        with pytest.raises(Exception, match="geometries"):
            geometry.with_geometries(pages, wrong).count()
    marks = sinks.overlay(boxes, "box", scale=2.0)
    svg = sinks.overlay_svg(marks, pages.withColumn("width", F.lit(10.0)).withColumn("height", F.lit(10.0)), 2.0).orderBy("page_no").first()["svg"]
    assert '<rect x="0.00" y="0.00" width="10.00" height="10.00"' in svg


RICH = ["file_outline", "file_destinations", "file_links", "file_metadata", "file_structure", "file_html", "file_element_texts", "file_figures", "file_images", "file_image_exports", "file_labels"]


@pytest.mark.parametrize("name", RICH)
def test_files_of_a_small_table_are_work_for_all_tasks(spark, tmp_path, name):
    from pagestrata.plans import file_queries, queries  # noqa: F401 - registers its queries

    spark.range(1, 41).selectExpr("id AS p_partkey").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    got = queries.QUERIES[name](spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and got.count() > 0


def test_cross_references_of_any_spacing():
    data = writer.rich_document(5, 2)
    loose = data.replace(b" 00000 n \n", b" 00000 n\r\n")
    odd = data.replace(b" 00000 n \n", b"  0    n \n")
    assert len(data) == len(loose) == len(odd)
    for x in (data, loose, odd):
        file = File(x)
        assert not file.recovered and file.places[1][1] == data.index(b"1 0 obj") and len(file.page_objects()) == 2


def test_marks_of_elements_count_for_all_above_in_one_pass(spark):
    rows = [("a", 0, None, []), ("a", 1, 0, [(1, 0)]), ("a", 2, 1, [(1, 1), (2, 0)]), ("b", 0, None, [(1, 0)])]
    elements = spark.createDataFrame(rows, "doc_id string, id int, parent int, mcids array<struct<page_no:int,mcid:int>>")
    got = sorted(map(tuple, reader._marks_above(elements).collect()))
    assert got == sorted([("a", 1, 1, 0), ("a", 0, 1, 0), *[(d, i, p, m) for d, i in (("a", 2), ("a", 1), ("a", 0)) for p, m in ((1, 1), (2, 0))], ("b", 0, 1, 0)])


def test_lexer_keeps_escaped_names_and_comments_whole():
    from pagestrata.sources.pdf.syntax import Lexer, Ref

    lex = Lexer(b"/Fo#20o /A#42 % no token here\n<< /K [1 0 R 2 -.5 true] /S <4a4> >> 12abc (a(b)) (c) /N% last")
    got = [lex.object() for _ in range(8)]
    assert got == ["Fo o", "AB", {"K": [Ref(1, 0), 2, -0.5, True], "S": b"J@"}, b"12abc", b"a(b)", b"c", "N", None]


def test_figures_and_their_lines_come_of_one_parse(spark, tmp_path):
    from pagestrata.plans import file_queries, queries  # noqa: F401 - registers its queries

    spark.range(1, 9).selectExpr("id AS p_partkey").write.parquet(str(tmp_path / "part.parquet"))
    got = queries.QUERIES["file_figures"](spark, str(tmp_path))
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 2  # one writes, one reads
    assert got.filter("lines = 1").count() == sum(k % 3 + 1 for k in range(1, 9))


def test_html_of_one_parse_is_that_of_rows(spark):
    """Each file is parsed once; the same documents come as by rows of characters."""
    rows = [("r", writer.rich_document(3, 2)), ("s", writer.rich_document(8, 3)), ("t", writer.document("a  b & <c>\n\n\n  \nfar\n" + "x y\n" * 70)), ("bad", b"%PDF-")]
    files = spark.createDataFrame([(k, bytearray(v)) for k, v in rows], "doc_id string, content binary")
    frames, found = reader.pages(files), reader.chars(files)
    lines, placed = layout.layout_boxes(layout.layout_lines(found)), layout.line_chars(found)
    for options in ({}, {"mode": "loose", "scale": 1.25}, {"mode": "exact", "fontscale": 0.75, "gap": 7.5}):
        got = verbs.extract_text_to(files, "html", **options)
        assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
        wanted = sinks.document_html(placed, lines, frames, **options)
        assert dict(map(tuple, got.collect())) == dict(map(tuple, wanted.collect()))
    with pytest.raises(ValueError, match="mode"):
        verbs.extract_text_to(files, "html", mode="other")


def test_characters_with_some_columns_only(spark):
    files = spark.createDataFrame([("a", bytearray(writer.document("a b\nc")))], "doc_id string, content binary")
    some = ["doc_id", "page_no", "seq", "text", "x0", "top", "doctop"]
    got = reader.chars(files, columns=some)
    assert got.columns == some and got.orderBy("seq").collect() == reader.chars(files).select(*some).orderBy("seq").collect() and got.count() == 4
