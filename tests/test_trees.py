from pyspark.sql import functions as F

from leafmill.operators import tree as T

SCHEMA = "block_id bigint, document_id bigint, page_idx int, type string, text string, text_level int, grid array<array<string>>"


def frame(spark):
    return spark.createDataFrame(
        [
            (1, 1, 0, "header", "Report 1", None, None), (2, 1, 0, "title", "A", 1, None), (3, 1, 0, "text", "- x", None, None), (4, 1, 0, "list", "2. y", None, None), (5, 1, 0, "number", "1", None, None),
            (6, 1, 1, "header", "Report  2", None, None), (7, 1, 1, "title", "B", 2, None), (8, 1, 1, "list", "z", None, None), (9, 1, 1, "table", None, None, [["h", "i"], ["1", "2"]]), (10, 1, 2, "header", "One off", None, None),
            (11, 1, 2, "table", None, None, [["h", "i"], ["3", "4"]]), (12, 1, 2, "title", "C", 1, None), (13, 1, 2, "text", "  ", None, None), (14, 1, 2, "text", "end", None, None),
        ],
        SCHEMA,
    )


def test_paratext_and_accounting(spark):
    b = frame(spark)
    fates = {r["block_id"]: r["fate"] for r in T.split_paratext(b).collect()}
    assert fates[1] == fates[6] == "paratext" and fates[10] == "rescued" and fates[5] == "dropped" and fates[13] == "empty"
    assert T.drop_accounting(b).first().asDict() == {"document_id": 1, "blocks_in": 14, "paratext": 3, "empty_image": 0, "empty_block": 1, "kept": 10}


def test_headings_lists_and_stitching(spark):
    b = frame(spark)
    paths = {r["block_id"]: r["heading_path"] for r in T.heading_path(b).collect()}
    assert paths[3] == ["A"] and paths[8] == ["A", "B"] and paths[14] == ["C"] and paths[1] == []
    groups = {r["first_block"]: (r["n_items"], r["content"]) for r in T.list_groups(b).collect()}
    assert groups == {3: (2, "x\n2. y"), 8: (1, "z")}  # a bullet goes, a number stays
    assert [tuple(r) for r in T.stitch(b).collect()] == [(1, 9, 2, 3)]


def test_collapse_loops(spark):
    line = "x" * 40
    t = spark.createDataFrame([(1, "\n".join(["a", line, line, "b", line, "b"])), (2, line + "\n" + line), (3, None)], "doc_id int, text string")
    assert [tuple(r) for r in T.collapse_loops(t).collect()] == [(1, 1, f"a\n{line}\nb\nb")]


def test_clean_text_and_math(spark):
    t = spark.createDataFrame([("exam- ple  of\ntext",), ("(12)",), ("∑ ≤",), (None,)], "t string")
    assert [r[0] for r in t.select(T.clean_text(F.col("t"))).collect()][0] == "example of text"
    assert [r[0] for r in t.select(T.is_math(F.col("t"))).collect()] == [False, True, True, False]


def test_empty_tables(spark):
    b = frame(spark).limit(0)
    for f in (T.split_paratext, T.heading_path, T.list_groups, T.page_ordinal, T.recurring_keys, T.stitch, T.build_tree):
        assert f(b).count() == 0


def test_furniture_images_and_titles(spark):
    rows = [
        (1, 1, 0, "footer", "Page footer 1", None, None), (2, 1, 1, "footer", "Page footer 2", None, None), (3, 1, 0, "aside_text", "A note", None, None), (4, 1, 0, "header_image", None, None, None), (5, 1, 0, "image", " ", None, None),
        (6, 1, 0, "chart", "Sales by year", None, None), (7, 1, 0, "doc_title", "The\nReport", None, None), (8, 1, 0, "header", "12 34", None, None), (9, 1, 1, "footer", "\\frac{a}{b}", None, None),
        (10, 1, 1, "table", "<p>Saved &amp; text</p>", None, [["", " "]]), (11, 1, 1, "table", "<td></td>", None, None), (12, 1, 1, "table", None, None, [["one"], ["two"]]), (13, 1, 1, "table", None, None, [["∑∫", "(3)"]]),
    ]
    b = spark.createDataFrame(rows, SCHEMA)
    fates = {r["block_id"]: r["fate"] for r in T.split_paratext(b).collect()}
    assert fates == {1: "paratext", 2: "paratext", 3: "rescued", 4: "empty_image", 5: "empty_image", 6: "kept", 7: "title", 8: "dropped", 9: "rescued", 10: "kept", 11: "empty", 12: "kept", 13: "kept"}
    assert [tuple(r) for r in T.document_title(b).collect()] == [(1, "The Report")]
    leaves = {r["block_id"]: (r["kind"], r["text"] or r["latex"]) for r in T.build_tree(b).collect()}
    assert leaves == {3: ("paragraph", "A note"), 6: ("paragraph", "Sales by year"), 9: ("equation", "\\frac{a}{b}"), 10: ("paragraph", "Saved &amp; text"), 12: ("paragraph", "one two"), 13: ("equation", "∑∫ (3)")}
    assert T.drop_accounting(b).first()["empty_image"] == 2


def test_tree_of_lists_and_headings(spark):
    rows = [
        (1, 1, 0, "paragraph_title", "Part one.\nFirst\nsection", 1, None), (2, 1, 0, "text", "- a", 1, None), (3, 1, 0, "list_item", "3) b\nb", None, None), (4, 1, 0, "list", " ", None, None), (5, 1, 0, "list", "• c", 2, None),
        (6, 1, 1, "list", "d", None, None), (7, 1, 1, "reference", "Works", 2, None), (8, 1, 1, "display_formula", "x\r\ny", None, None), (9, 1, 1, "algorithm", "if x\r\n  y", None, None), (10, 1, 1, "text", "one\n two", None, None),
    ]
    got = {r["block_id"]: r for r in T.raw_payload(T.build_tree(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert {k: (r["kind"], r["ordinal"], r["heading_path"]) for k, r in got.items()} == {
        2: ("list", 1, ["First section"]), 5: ("list", 2, ["First section"]), 6: ("list", 1, ["First section"]), 8: ("equation", 2, ["First section", "Works"]), 9: ("code", 3, ["First section", "Works"]), 10: ("paragraph", 4, ["First section", "Works"]),
    }
    assert got[2]["raw"] == '{"items":[{"ordinal":0,"content":"a","depth":1},{"ordinal":1,"content":"3) b b","depth":0}]}'
    assert got[8]["raw"] == '{"latex":"x\\ny"}' and got[9]["raw"] == '{"text":"if x\\n  y"}' and got[10]["raw"] == '{"text":"one two"}'


def test_loops_end_at_breaks_and_spare_tables(spark):
    part = "the same forty characters, again and again"
    t = spark.createDataFrame([(1, "text", f"{part}\\\\ {part} \n{part}\nx"), (2, "table", "\n".join([part] * 4)), (3, "text", None)], "block_id int, type string, text string")
    got = {r["block_id"]: r["text"] for r in T.collapse_blocks(t).collect()}
    assert got == {1: f"{part}\nx", 2: "\n".join([part] * 4), 3: None}


def test_composed(spark):
    t = spark.createDataFrame([("Cafe\u0301 au lait",), ("plain",), (None,)], "t string")
    assert [r[0] for r in t.select(T.clean_text(F.col("t"))).collect()] == ["Caf\u00e9 au lait", "plain", None]
    assert [r[0] for r in t.select(T.clean_name(F.lit("my_old--file name"))).collect()][0] == "my old file name"
