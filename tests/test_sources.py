import hashlib
import io
import json
import zipfile

from pyspark.sql import functions as F

from leafmill.api import Engine
from leafmill.operators import pagemd
from leafmill.plans import answer
from leafmill.queries import arrivals
from leafmill.sources import detect, files, html, markdown, office, sinks


def xlsx(rows):
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("xl/workbook.xml", '<workbook xmlns:r="r"><sheets><sheet name="Sales" r:id="rId1"/></sheets></workbook>')
        f.writestr("xl/_rels/workbook.xml.rels", '<R><Relationship Id="rId1" Target="worksheets/s.xml"/></R>')
        f.writestr("xl/sharedStrings.xml", "<sst>" + "".join(f"<si><t>{s}</t></si>" for s in ("region", "units", "north")) + "</sst>")
        f.writestr("xl/worksheets/s.xml", "<worksheet><sheetData>" + rows + "</sheetData></worksheet>")
    return z.getvalue()


def test_xlsx():
    data = xlsx('<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row r="3"><c r="A3" t="s"><v>2</v></c><c r="C3"><v>7.5</v></c></row>')
    assert office.read_xlsx(data)[0]["grid"] == [["region", "units"], [], ["north", "", "7.5"]]


def test_pptx():
    z = io.BytesIO()
    ns = 'xmlns:a="a" xmlns:p="p" xmlns:r="r"'
    shape = lambda y, t, ph="": f'<p:sp><p:nvSpPr><p:nvPr>{ph}</p:nvPr></p:nvSpPr><p:spPr><a:xfrm><a:off x="1" y="{y}"/></a:xfrm></p:spPr><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp>'
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("ppt/presentation.xml", f'<p:presentation {ns}><p:sldIdLst><p:sldId r:id="r1"/></p:sldIdLst></p:presentation>')
        f.writestr("ppt/_rels/presentation.xml.rels", '<R><Relationship Id="r1" Target="slides/s1.xml"/></R>')
        f.writestr("ppt/slides/s1.xml", f"<p:sld {ns}><p:cSld><p:spTree>{shape(50, 'below')}{shape(5, 'Head', '<p:ph type=\"title\"/>')}</p:spTree></p:cSld></p:sld>")
    got = office.read_pptx(z.getvalue())
    assert [(b["type"], b["text"]) for b in got] == [("title", "Head"), ("text", "below")]


def test_docx():
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("word/document.xml", '<w:document xmlns:w="w"><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Text</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    assert [(b["type"], b["text"], b["text_level"], b["grid"]) for b in office.read_docx(z.getvalue())] == [("title", "Head", 2, None), ("text", "Text", None, None), ("table", None, None, [["a"]])]


PAGE = """<html><head><style>x{}</style></head><body><!-- no --><script>var a;</script><h2>Top</h2>Loose <b>text</b>
<p>See <a href="http://x/y">here</a> and <a href="#a">there</a>.</p><ul><li>one<ul><li>inner</li></ul></li><li>two</li></ul>
<table><tr><td colspan="2">wide</td></tr><tr><td rowspan="2">a</td><td>b</td></tr><tr><td>c</td></tr></table>
<pre>x = 1
y</pre><img src="i.png" width="8" height="8"><a href="u"><img alt="pic" src="j.png"></a>
<math><semantics><mi>q</mi><annotation encoding="application/x-tex">a^2</annotation></semantics></math></body></html>"""


def test_html_blocks():
    got = [(b["type"], b["text"], b["grid"], b["depth"]) for b in html.blocks_of(PAGE)]
    assert ("title", "Top", None, None) in got and ("text", "Loose text", None, None) in got
    assert ("text", "See here (http://x/y) and there.", None, None) in got
    assert [(g[1], g[3]) for g in got if g[0] == "list"] == [("inner", 1), ("one", 0), ("two", 0)]
    assert next(g[2] for g in got if g[0] == "table") == [["wide", ""], ["a", "b"], ["a", "c"]]
    assert ("code", "x = 1\ny", None, None) in got and ("equation", "a^2", None, None) in got and ("image", "pic", None, None) in got
    assert not any("var a" in (g[1] or "") or "no" == g[1] for g in got)
    assert html.blocks_of(None) == [] and html.blocks_of("") == []


def test_html_of_all_blocks(spark, tmp_path):
    texts = [("text", "Zwölf  Häuser\nam\u00a0Fluss"), ("code", "if a < b:\n    x &= 1"), ("list", "- a\r\n- b"), ("title", "Plain"), ("caption", " \t\u00a0\n"), ("header", ""), ("number", "12"), ("text", None)]
    rows = [(i, 1, 0, k, x, f"2024-01-0{d}") for i, (k, x) in enumerate(texts) for d in (1, 2)]
    df = spark.createDataFrame(rows, "block_id bigint, document_id bigint, page_idx int, type string, text string, received_at string")
    df.withColumn("received_at", F.col("received_at").cast("timestamp")).write.parquet(str(tmp_path / "blocks.parquet"))
    got = arrivals.html_blocks(spark, str(tmp_path)).collect()
    want = {0: "Zwölf Häuser am Fluss", 1: "if a < b: x &= 1", 2: "- a - b", 3: "Plain", 6: "12"}
    assert {(r["block_id"], r["ordinal"], r["type"]) for r in got} == {(i, o, k) for i in want for o, k in ((0, "title"), (1, "text"))} and len(got) == 10
    assert {r["block_id"]: r["digest"] for r in got if r["ordinal"]} == {i: hashlib.md5(f"{x} up".encode()).hexdigest() for i, x in want.items()}


def test_markdown_blocks():
    md = "# One\n\npara **bold** [l](http://u)\nmore\n\n- a\n  - b\n\n```py\nx\n```\n\n| h | i |\n|---|---|\n| 1 | 2 |\n\n$$\na+b\n$$\nTitle\n===\n"
    got = [(b["type"], b["text"] or b["grid"]) for b in markdown.blocks_of(md)]
    assert got == [("title", "One"), ("text", "para bold l (http://u) more"), ("list", "a"), ("list", "b"), ("code", "x"), ("table", [["h", "i"], ["1", "2"]]), ("equation", "a+b"), ("title", "Title")]


def test_csv_and_json():
    assert files.grid_of_csv('\n\na,b\n1,"x\ny",9\n2\n', ",") == [["a", "b"], ["1", "x\ny"], ["2", ""]]
    got = dict(files.grids_of_json(json.dumps([{"a": 1, "b": {"c": "é"}, "l": [{"x": 1}, {"x": 2, "y": [1]}], "e": []}])))
    assert got["root"][0] == ["_id", "a", "b.c", "e"] and got["root.l"] == [["_id", "root_id", "x", "y"], ["1", "1", "1", ""], ["2", "1", "2", "[1]"]]
    assert office.read_xml("<r><a k='1'>t</a><a/></r>") == {"r": {"a": [{"@k": "1", "#text": "t"}, None]}}


def test_detect(spark):
    rows = [("f.csv", b"a,b\n1,2"), ("f", b"%PDF-1.4"), ("x", b'{"a":1}'), ("y", b"a\tb\n1\t2\n"), ("z.txt", b"plain"), ("w", b"<html><p>x</p>")]
    df = spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary")
    assert [r[0] for r in df.select(detect.kind(F.col("path"), F.col("content"))).collect()] == ["csv", "pdf", "json", "tsv", "text", "html"]


def test_page_markdown(spark):
    page = "```markdown\n<think>==TEXT==\nHello\n---\n==LIST==\n- a\n- b\n==TABLE==\n| x | y |\n| 1 | 2 |\n==CODE==\n```\n==LIST==\n```\n```"
    df = spark.createDataFrame([(1, page)], "k int, text string")
    clean = df.withColumn("text", pagemd.strip_meta(pagemd.strip_fence(pagemd.strip_think(F.col("text")))))
    got = {r["section"]: (r["tag"], r["content"]) for r in pagemd.sections(clean, ["k"]).collect()}
    assert got[1][0] == "TEXT" and got[2] == ("LIST", "- a\n- b") and "TABLE" == got[3][0] and got[4][0] == "CODE" and "==LIST==" in got[4][1]
    g = spark.createDataFrame([("| x | y |\n|---|---|\n| 1 | 2 |",)], "c string").select(pagemd.markdown_grid(F.col("c"))).first()[0]
    assert g == [["x", "y"], ["1", "2"]]


def test_engine_end_to_end(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "sales.csv").write_text("region,units,price\nnorth,5,1.50\nsouth,7,2.25\nnorth,1,9.00\n")
    (src / "notes.md").write_text("# Harbour\n\nThe harbour authority approved the annual statement.\n")
    (src / "broken.xlsx").write_bytes(b"PK\x03\x04 nonsense")
    engine = Engine(spark, str(tmp_path / "store"))
    lib = engine.create_library("L")
    assert lib.ingest(str(src)) == 4 and lib.ingest(str(src)) == 0
    assert lib.progress() == {"ingested": 2, "failed": 1}
    assert sorted(lib.sql("SELECT c0, SUM(c1) AS n FROM t0 GROUP BY c0").rows) == [("north", 6), ("south", 7)]
    said = "".join(lib.ask("What is the total of units by region in sales?"))
    assert "north | 6" in said and "[sales.csv]" in said
    assert "annual statement" in "".join(lib.ask("Who approved the annual statement of the harbour?"))
    leaves = lib.tree().collect()
    assert {r["kind"] for r in leaves} >= {"paragraph", "table"} and ["Harbour"] in [r["heading_path"] for r in leaves]  # a heading is no leaf, but stands above some
    assert [(r["number"], r["label"], r["n_rows"], [t["dtype"] for t in r["types"]]) for r in lib.tables().collect()] == [(0, "sales.csv", 3, ["string", "integer", "decimal"])]
    notes = next(r["path"] for r in lib.documents().collect() if r["filename"] == "notes.md")
    got = lib.result(notes)
    assert got["status"] == "ingested" and got["tables"] == 0 and [b["text"] for b in got["tree"]["blocks"]] == ["The harbour authority approved the annual statement."]
    lib.export_markdown(str(tmp_path / "md"))
    assert "## Harbour\n\nThe harbour authority" in "\n".join(r[0] for r in spark.read.text(str(tmp_path / "md")).collect())
    (src / "sales2.csv").write_text("region,units\neast,2\n")
    assert lib.ingest(str(src)) == 1 and lib.sql("SELECT SUM(c1) AS n FROM t1").rows == [(2,)]
    assert lib.sql("SELECT 1 AS one").sources == []
    engine.delete_library(1)
    assert engine.libraries().count() == 0


def test_sink_guard_and_idempotence(spark, tmp_path):
    import pytest

    with pytest.raises(ValueError, match="escapes"):
        sinks.object_path("/a/b", "../c")
    df = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "k int, v string")
    assert sinks.append_missing(df, str(tmp_path / "t"), ["k"]) == 2
    assert sinks.append_missing(df, str(tmp_path / "t"), ["k"]) == 0


def test_answer_helpers():
    assert answer.labels_of([("a.csv", None), ("b.xlsx", "S"), ("a.csv", None)]) == ["a.csv #1", "b.xlsx (S)", "a.csv #2"]
    assert answer.fabricated("x [a p3] y [b] [a]", ["a"]) == ["b"]
    assert answer.last_object('say {"a": 1} then {"b": {"c": "}"}} end') == {"b": {"c": "}"}}
    assert answer.walk([[1], [], [], [4]], lambda w: w) == [1]
    t = answer.TableInfo("f", ["h0", "h1"], [("string", 0), ("integer", 0)])
    assert answer.readable("SELECT t0.c1 FROM t0", [t]) == 'SELECT "h1" FROM "f"'.replace('"h1"', '"h1"')
    assert answer.inline_refs({"$defs": {"A": {"type": "x"}}, "p": {"$ref": "#/$defs/A"}}) == {"p": {"type": "x"}}


def test_questions_do_not_share_views(spark, tmp_path):
    """Two libraries asked in turn: each question has its tables in a session of its own."""
    src = [tmp_path / "a", tmp_path / "b"]
    engine = Engine(spark, str(tmp_path / "store"))
    libs = []
    for folder, n in zip(src, (3, 4), strict=True):
        folder.mkdir()
        (folder / "sales.csv").write_text(f"region,units\nnorth,{n}\n")
        libs.append(engine.create_library(folder.name))
        libs[-1].ingest(str(folder))
    spark.range(1).createOrReplaceTempView("t0")
    first = libs[0].ask("total units in sales")
    assert "3" in next(first) and "4" in next(libs[1].ask("total units in sales"))
    assert spark.table("t0").columns == ["id"]
    spark.catalog.dropTempView("t0")


def test_walk_and_sources():
    assert answer.walk([[1], [], [2], [], [], [3]], lambda w: w) == [1, 2]
    assert answer.sources("SELECT * FROM x", ["a", "b"], ["file", "v"], [("f.csv", 1), ("g.csv", 2), ("f.csv", 3)]) == ["f.csv", "g.csv"]
    assert answer.sources("SELECT 1", ["a", "b"]) == ["a", "b"] and answer.sources("SELECT t1.c0 FROM t1", ["a", "b"]) == ["b"]


def _png(pixels, channels=1, kind=0):
    import struct
    import zlib

    high, wide = len(pixels), len(pixels[0]) // channels
    raw, above = b"", [0] * (wide * channels)
    for line in pixels:
        out = []
        for i, v in enumerate(line):
            left, up, corner = line[i - channels] if i >= channels else 0, above[i], above[i - channels] if i >= channels else 0
            guess = left + up - corner
            paeth = min((left, up, corner), key=lambda x: (abs(guess - x), (left, up, corner).index(x)))
            out.append((v - (0, left, up, (left + up) // 2, paeth)[kind]) % 256)
        raw += bytes([kind, *out])
        above = line
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", wide, high, 8, {1: 0, 3: 2}[channels], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_blank_pages(spark, tmp_path):
    from leafmill.sources import images

    drawn = [[10, 200, 30, 255], [0, 90, 180, 7], [255, 254, 3, 60]]
    for kind in range(5):
        assert images.png_pixels(_png(drawn, 1, kind)).astype(int).tolist() == drawn
    assert images.png_pixels(_png([[9, 9, 9, 200, 200, 200]], 3, 1)).round().astype(int).tolist() == [[9, 200]]
    assert images.is_blank(_png([[250, 251], [250, 250]])) and not images.is_blank(_png(drawn)) and not images.is_blank(b"\xff\xd8 no png") and not images.is_blank(_png(drawn)[:40])
    src = tmp_path / "in"
    src.mkdir()
    (src / "blank.png").write_bytes(_png([[255] * 8] * 8))
    (src / "drawn.png").write_bytes(_png(drawn))

    def pages(content, kind):
        return ["==LIST==\n- one\n- two\n==FORM==\nName: Ann\n\nAge: 4\n==TABLE==\n|a|b|\n|-|-|\n|1|2|"]

    engine = Engine(spark, str(tmp_path / "store"), pages=pages)
    lib = engine.create_library("L")
    assert lib.ingest(str(src)) == 1
    assert [(r["type"], r["text"], r["grid"]) for r in lib.blocks().orderBy("ordinal").collect()] == [("list_item", "- one", None), ("list_item", "- two", None), ("text", "Name: Ann", None), ("text", "Age: 4", None), ("table", None, [["a", "b"], ["1", "2"]])]


def test_equal_pictures_are_read_once(spark):
    from leafmill.sources import images

    seen = []
    df = spark.createDataFrame([(1, bytearray(b"x")), (2, bytearray(b"y")), (3, bytearray(b"x")), (4, None)], "id int, content binary")

    def reader(r):
        seen.append(r.count())
        return r.select("digest", F.decode("content", "UTF-8").alias("said"))

    assert {r["id"]: r["said"] for r in images.read_once(df, reader).collect()} == {1: "x", 2: "y", 3: "x"} and seen == [2]
