"""Blocks to a content tree: repetition, paratext, kinds, lists, headings, ordinals, search text.

Every function takes and gives DataFrames; windows are partitioned by document
(and page), so a shuffle by document serves all of them.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Kinds of block types; others are paragraphs (fixed values). ``list`` is this data model's own.
KINDS = {"paragraph_title": "heading", "reference": "heading", "title": "heading", "algorithm": "code", "code": "code", "list_item": "list", "list": "list", "display_formula": "equation", "equation": "equation", "table": "table"}
#: Types of page furniture, and of pictures that say nothing without a text (fixed values).
PARATEXT = ["header", "footer", "number", "aside_text", "header_image", "footer_image"]
IMAGES = ["image", "header_image", "footer_image", "seal", "chart"]
TITLE = "doc_title"
#: What makes a text mathematical (fixed values).
MATH_MARKS = ["\\(", "\\[", "\\frac", "\\sum", "\\int", "\\sqrt", "\\left", "\\leq", "\\geq", "$$"]
MATH_GLYPHS = "∑∫≤≥≠±∞√αβγδεφζηθλμπσωτχψ→∈∀∃∂∇⊂⊆∪∩·×÷"
#: How a list item opens, the bullet that is taken from it (a number stays), and where a heading of several lines parts (fixed patterns).
MARKER = r"^\s*([●○•▪◦‣·*]\s|[-–—]\s|\(?[0-9]{1,3}[.)]\s|\(?[A-Za-z][.)]\s|\([A-Za-z0-9]+\)\s)"
BULLET = r"^\s*[●○•▪◦‣·*–—-]\s+"
HEADING_BREAK = r"([\"”:.?)])\s*\n\s*"
LOOP_CHARS, LOOP_TIMES = 40, 3


def delivered(blocks: DataFrame) -> DataFrame:
    """Each block once; deliveries of a block differ in their time only."""
    return blocks.dropDuplicates(["block_id"])


def stripped(text: Column) -> Column:
    """White space away at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def flat(text: Column) -> Column:
    """Line breaks, with the blanks around them, as one blank."""
    return stripped(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s*[\r\n]+\s*", " "))


def plain_lines(text: Column) -> Column:
    """Line breaks of one kind."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n")


def without_loops(text: Column) -> tuple[Column, Column]:
    """A text without the repeats of segments of 40 characters or more that occur three times or more, and how many such segments there are.

    Segments end at line breaks and at ``\\\\``.
    """
    parts = F.split(text, r"\\\\|\n", -1)
    # each step is an element of an array, so that the next one reads it instead of making it again for every segment
    step = F.transform(F.array(parts), lambda p: F.struct(p.alias("parts"), F.transform(p, stripped).alias("heads")))
    step = F.transform(step, lambda s: F.struct(s["parts"].alias("parts"), s["heads"].alias("heads"), F.array_sort(F.filter(s["heads"], lambda x: F.char_length(x) >= LOOP_CHARS)).alias("seen")))
    # sorted, a segment that occurs so often stands so far from itself
    again = lambda s: F.array_distinct(F.filter(s["seen"], lambda x, i: x == F.get(s["seen"], i + (LOOP_TIMES - 1))))
    step = F.transform(step, lambda s: F.struct(s["parts"].alias("parts"), s["heads"].alias("heads"), again(s).alias("looped")))
    kept = lambda s: F.filter(s["parts"], lambda x, i: ~F.array_contains(s["looped"], F.get(s["heads"], i)) | (F.array_position(s["heads"], F.get(s["heads"], i)) == i + 1))
    made = F.transform(step, lambda s: F.struct(F.size(s["looped"]).alias("n"), F.when(F.size(s["looped"]) > 0, F.array_join(kept(s), "\n")).alias("text")))[0]
    return F.coalesce(made["text"], text), made["n"]


def collapse_loops(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts that repeat themselves, with the repeats dropped."""
    made, n = without_loops(F.col(text))
    both = F.explode(F.array(F.struct(n.cast("int").alias("n_looped"), made.alias("collapsed"))))
    return texts.where(F.col(text).isNotNull()).select(key, both.alias("made")).select(key, "made.*").where("n_looped > 0")


def collapse_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks with repeats dropped from their texts; tables are left as they are."""
    return blocks.withColumn("text", F.when(F.coalesce(F.col("type") == "table", F.lit(False)) | F.col("text").isNull(), F.col("text")).otherwise(without_loops(F.col("text"))[0]))


def paratext_key(text: Column) -> Column:
    """Digits away, blanks folded, lower-case."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(text, "[0-9]", ""), r"\s+", " ")))


def recurring_keys(blocks: DataFrame) -> DataFrame:
    """Keys of page furniture, but page numbers, on two or more pages of a document, with the first text of each."""
    heads = blocks.where(F.col("type").isin(PARATEXT) & (F.col("type") != "number")).withColumn("key", paratext_key(F.col("text"))).where(F.col("key") != "")
    return heads.groupBy("document_id", "key").agg(F.countDistinct("page_idx").cast("int").alias("pages"), F.min(F.struct("page_idx", "block_id", "text")).alias("first")).where("pages >= 2").select("document_id", "key", "pages", F.col("first.text").alias("first_text"))


def split_paratext(blocks: DataFrame) -> DataFrame:
    """What becomes of each block: paratext, rescued, dropped, title, empty image, empty or kept."""
    keyed = blocks.withColumn("key", paratext_key(F.coalesce("text", F.lit(""))))
    again = recurring_keys(blocks).select("document_id", "key", F.lit(True).alias("again"))
    b = keyed.join(again, ["document_id", "key"], "left")
    blank = stripped(F.coalesce("text", F.lit(""))) == ""
    furniture = F.col("type").isin(PARATEXT)
    fate = (
        F.when(F.col("type").isin([t for t in IMAGES if t in PARATEXT]) & blank, "empty_image")
        .when(furniture & (blank | (F.col("type") == "number") | (F.col("key") == "")), "dropped")
        .when(furniture & F.coalesce("again", F.lit(False)), "paratext")
        .when(furniture, "rescued")
        .when(F.col("type").isin(IMAGES) & blank, "empty_image")
        .when(F.col("type") == TITLE, "title")
        .when((F.col("type") == "table") & (region_type(F.col("grid"), F.col("text")) == "nothing"), "empty")
        .when((F.coalesce(F.col("type"), F.lit("")) != "table") & blank & F.col("grid").isNull(), "empty")
        .otherwise("kept")
    )
    return b.select("block_id", "document_id", fate.alias("fate"))


def drop_accounting(blocks: DataFrame) -> DataFrame:
    """Per document: blocks in, paratext, empty images, empty blocks, kept; they add up or the job fails."""
    fate = F.col("fate")
    f = split_paratext(blocks).groupBy("document_id").agg(
        F.count(F.lit(1)).alias("blocks_in"), F.count_if(fate.isin("paratext", "dropped")).alias("paratext"), F.count_if(fate == "empty_image").alias("empty_image"),
        F.count_if(fate == "empty").alias("empty_block"), F.count_if(fate.isin("kept", "rescued", "title")).alias("kept"),
    )
    return f.withColumn("checked", F.assert_true(F.col("blocks_in") == F.col("paratext") + F.col("empty_image") + F.col("empty_block") + F.col("kept"))).drop("checked")


def is_math(text: Column) -> Column:
    """A LaTeX mark, a lone formula number, or two mathematical glyphs."""
    glyphs = F.char_length(text) - F.char_length(F.translate(text, MATH_GLYPHS, ""))
    marks = [text.contains(m) for m in MATH_MARKS]
    return F.coalesce(reduce(lambda x, y: x | y, marks) | stripped(text).rlike(r"^\([0-9]+\)$") | (glyphs >= 2), F.lit(False))


def grid_class(grid: Column) -> Column:
    """empty, equation, prose or table."""
    cells = _cells(grid)
    width = F.array_max(F.transform(grid, lambda r: F.size(r)))
    return F.when(grid.isNull() | (F.size(cells) == 0), "empty").when(F.forall(cells, is_math), "equation").when(width <= 1, "prose").otherwise("table")


def _cells(grid: Column) -> Column:
    return F.filter(F.flatten(grid), lambda c: c.isNotNull() & (F.trim(c) != ""))


def _salvaged(text: Column) -> Column:
    """What an empty table region holds besides its tags."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]*>", " "), r"\s+", " "))


def region_type(grid: Column, text: Column) -> Column:
    """What a table region is: table, equation, text, or nothing."""
    found = grid_class(grid)
    return F.when(found == "empty", F.when(_salvaged(text) == "", "nothing").otherwise("text")).when(found == "prose", "text").otherwise(found)


def reclassify(blocks: DataFrame) -> DataFrame:
    """Table regions under the type they turn out to have, with their cells as text; empty ones are salvaged or dropped."""
    is_table = F.coalesce(F.col("type") == "table", F.lit(False))
    made = region_type(F.col("grid"), F.col("text"))
    cells = F.array_join(F.coalesce(_cells(F.col("grid")), F.array().cast("array<string>")), " ")
    text = F.when(is_table & made.isin("equation", "text"), F.when(cells != "", cells).otherwise(_salvaged(F.col("text")))).otherwise(F.col("text"))
    return blocks.withColumns({"type": F.when(is_table, made).otherwise(F.col("type")), "text": text}).where("type <> 'nothing' or type is null")


def kind(kind_of: Column) -> Column:
    """A block type's kind."""
    out = F.lit("paragraph")
    for t, k in KINDS.items():
        out = F.when(kind_of == t, k).otherwise(out)
    return out


def is_list_item(blocks_type: Column, text: Column) -> Column:
    """A list block with text, or a paragraph that opens with a marker."""
    return F.coalesce((stripped(text) != "") & ((kind(blocks_type) == "list") | ((kind(blocks_type) == "paragraph") & text.rlike(MARKER))), F.lit(False))


def item_text(text: Column) -> Column:
    """A list item's content: its bullet goes, its number stays."""
    return flat(F.regexp_replace(stripped(F.coalesce(text, F.lit(""))), BULLET, ""))


def list_groups(blocks: DataFrame) -> DataFrame:
    """Consecutive list items of one page as one leaf, each with its depth: gaps and islands."""
    w = Window.partitionBy("document_id", "page_idx").orderBy("block_id")
    b = blocks.withColumn("item", is_list_item(F.col("type"), F.coalesce("text", F.lit(""))))
    b = b.withColumn("opens", F.when(F.col("item") & ~F.coalesce(F.lag("item").over(w), F.lit(False)), 1).otherwise(0))
    b = b.withColumn("grp", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("item")
    entry = F.struct("block_id", item_text(F.col("text")).alias("content"), F.coalesce("text_level", F.lit(0)).alias("depth"))
    b = b.groupBy("document_id", "page_idx", "grp").agg(F.count(F.lit(1)).alias("n_items"), F.min("block_id").alias("first_block"), F.array_sort(F.collect_list(entry)).alias("entries"))
    items = F.transform("entries", lambda x, i: F.struct(i.alias("ordinal"), x["content"].alias("content"), x["depth"].alias("depth")))
    return b.select("document_id", "page_idx", "grp", "n_items", "first_block", items.alias("items"), F.array_join(F.col("entries.content"), "\n").alias("content"))


def heading_text(text: Column) -> Column:
    """The last part of a heading: its lines are one but after the end of a sentence, a quotation or a bracket, and later parts replace earlier ones."""
    parts = F.split(F.regexp_replace(plain_lines(text), HEADING_BREAK, "$1\x00"), "\x00", -1)
    parts = F.filter(F.transform(parts, lambda x: stripped(F.regexp_replace(x, r"\s*\n\s*", " "))), lambda x: x != "")
    return F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))


def heading_path(blocks: DataFrame, levels: int = 6) -> DataFrame:
    """Each block's headings from the outermost in: for every level the last heading since a shallower one; levels beyond ``levels`` count as that.

    One window per document in order; the state is a heading and its place per level, so
    a level's heading counts if no shallower heading came after it.
    """
    w = Window.partitionBy("document_id").orderBy("page_idx", "block_id").rowsBetween(Window.unboundedPreceding, 0)
    b = blocks.withColumn("seq", F.row_number().over(Window.partitionBy("document_id").orderBy("page_idx", "block_id")))
    level = F.when(kind(F.col("type")) == "heading", F.greatest(F.lit(1), F.least(F.lit(levels), F.coalesce("text_level", F.lit(1)))))
    b = b.withColumn("level", level)
    for i in range(1, levels + 1):
        b = b.withColumn(f"h{i}", F.last(F.when(F.col("level") == i, F.struct("seq", heading_text(F.col("text")).alias("text"))), ignorenulls=True).over(w))
    path = []
    for i in range(1, levels + 1):
        last_shallower = F.greatest(*[F.coalesce(F.col(f"h{j}.seq"), F.lit(0)) for j in range(1, i)], F.lit(0)) if i > 1 else F.lit(0)
        path.append(F.when(F.col(f"h{i}").isNotNull() & (F.col(f"h{i}.seq") > last_shallower), F.col(f"h{i}.text")))
    return b.select("block_id", "document_id", F.array_compact(F.array(*path)).alias("heading_path"))


def page_ordinal(blocks: DataFrame) -> DataFrame:
    """A block's place on its page, from 0."""
    w = Window.partitionBy("document_id", "page_idx").orderBy("block_id")
    return blocks.select("block_id", (F.row_number().over(w) - 1).cast("int").alias("ordinal"))


def block_ordinal(nodes: DataFrame) -> DataFrame:
    """A node's place in its document by page (or sheet) and ordinal, from 1."""
    w = Window.partitionBy("document_id").orderBy(F.coalesce("page_no", "sheet_no").asc_nulls_last(), F.col("ordinal").asc_nulls_last(), "content_id")
    return nodes.select("content_id", F.row_number().over(w).cast("bigint").alias("place"))


@F.pandas_udf(StringType())
def _composed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None else unicodedata.normalize("NFC", t))


def composed(text: Column) -> Column:
    """Unicode's composed form; only texts with marks that may compose are taken out of the JVM."""
    return F.coalesce(_composed(F.when(text.rlike(r"[\p{M}\u1100-\u11FF\u2000-\u2001\u2126\u212A-\u212B\uF900-\uFAFF]"), text)), text)


def clean_text(text: Column) -> Column:
    """Composed, hyphenated breaks joined, blanks folded."""
    return F.trim(F.regexp_replace(F.regexp_replace(composed(text), r"(?<=[a-z])-\s+(?=[a-z])", ""), r"\s+", " "))


def clean_name(text: Column) -> Column:
    """Composed, underlines and hyphens as blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(composed(text), "[_-]+", " "), r"\s+", " "))


def stem(name: Column) -> Column:
    """A file's name without what follows its last dot."""
    return F.regexp_replace(name, r"\.[^.]*$", "")


def joined_lines(*parts: Column) -> Column:
    """The parts that aren't empty, one a line."""
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), "\n")


_ITEMS = "array<struct<ordinal:int,content:string,depth:int>>"


def leaf_text(raw: Column, latex: Column, kind_of: Column) -> Column:
    """A leaf as one text: a formula, numbered items, or its text."""
    items = F.from_json(F.get_json_object(raw, "$.items"), _ITEMS)
    numbered = F.array_join(F.transform(items, lambda x: F.concat((F.coalesce(x["ordinal"], F.lit(0)) + 1).cast("string"), F.lit(". "), F.coalesce(x["content"], F.lit("")))), " ")
    return F.coalesce(F.when(kind_of == "equation", latex).when(kind_of == "list", numbered).otherwise(F.get_json_object(raw, "$.text")), F.lit(""))


def search_text(nodes: DataFrame, documents: DataFrame, libraries: DataFrame) -> DataFrame:
    """Library, file, heading, for formulas the nearest paragraph of the three blocks before it on its page, and body, one a line; tables have none of these."""
    w = Window.partitionBy("document_id", "page_no").orderBy("ordinal", "content_id")
    n = nodes.withColumn("kind", kind(F.col("type")))
    n = n.withColumn("body", leaf_text(F.col("raw"), F.col("latex"), F.col("kind")))
    paragraph = F.when((F.col("kind") == "paragraph") & (F.trim("body") != ""), F.col("body"))
    n = n.withColumn("near", F.when(F.col("kind") == "equation", F.last(paragraph, ignorenulls=True).over(w.rowsBetween(-3, -1))))
    d = documents.select(F.col("doc_id").alias("document_id"), "library_id", "filename").dropDuplicates(["document_id"])
    n = n.where("kind <> 'table'").join(d, "document_id").join(libraries.select("library_id", F.col("name").alias("library")).dropDuplicates(["library_id"]), "library_id", "left")
    return n.select("content_id", joined_lines(clean_name(F.col("library")), clean_name(stem(F.col("filename"))), clean_text(F.col("heading")), clean_text(F.col("near")), clean_text(F.col("body"))).alias("made"))


def table_search_text(tables: DataFrame, libraries: DataFrame) -> DataFrame:
    """Library, file, sheet, title, caption, notes and headers of a table, one a line; never its rows. Columns that a catalogue lacks are left out."""
    given = set(tables.columns)
    name = [clean_name(stem(F.col("filename")))] if "filename" in given else []
    texts = [clean_text(F.col(c)) for c in ("sheet", "title", "caption") if c in given]
    lists = [c for c in ("notes", "headers") if c in given]
    t = tables.join(libraries.select("library_id", F.col("name").alias("library")).dropDuplicates(["library_id"]), "library_id", "left")
    # folded within arrays by expressions, composed as one text
    more = [clean_lines(F.array_join(F.filter(F.col(c), lambda x: x.isNotNull()), "\n")) for c in lists]
    return t.select("table_id", joined_lines(clean_name(F.col("library")), *name, *texts, *more).alias("made"))


def clean_lines(text: Column) -> Column:
    """Each line cleaned, empty ones left out."""
    lines = F.transform(F.split(composed(text), "\n", -1), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"(?<=[a-z])-\s+(?=[a-z])", ""), r"\s+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def stitch(blocks: DataFrame, least: float = 0.6) -> DataFrame:
    """Grids that go on over pages joined: same width, later page, alike headers; a repeated header row is dropped.

    Only first rows and row counts decide, so that is all that a document's group holds.
    """
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        from difflib import SequenceMatcher

        frame = frame.sort_values(["page_idx", "block_id"])
        out: list[dict] = []
        for r in frame.itertuples():
            head = [(c or "").lower() for c in r.head]
            last = out[-1] if out else None
            if last and last["width"] == len(head) and r.page_idx > last["page"] and SequenceMatcher(None, " ".join(last["head"]), " ".join(head)).ratio() >= least:
                last["rows"] += r.n - (1 if last["head"] == head else 0)
                last["blocks"].append(r.block_id)
                last["page"] = r.page_idx
            else:
                out.append({"head": head, "width": len(head), "page": r.page_idx, "rows": r.n, "blocks": [r.block_id]})
        return pd.DataFrame([{"document_id": frame["document_id"].iloc[0], "first_block": o["blocks"][0], "n_blocks": len(o["blocks"]), "n_rows": o["rows"]} for o in out], columns=["document_id", "first_block", "n_blocks", "n_rows"])

    grids = blocks.where(F.col("grid").isNotNull() & (F.size("grid") > 0)).select("document_id", "page_idx", "block_id", F.coalesce(F.get("grid", F.lit(0)), F.array().cast("array<string>")).alias("head"), F.size("grid").alias("n"))
    return grids.groupBy("document_id").applyInPandas(run, "document_id bigint, first_block bigint, n_blocks int, n_rows int")


def document_title(blocks: DataFrame, type_of_title: str = TITLE) -> DataFrame:
    """Each document's title: its first title block that has a text."""
    b = blocks.where((F.col("type") == type_of_title) & F.col("text").isNotNull())
    return b.groupBy("document_id").agg(F.min_by(flat(F.col("text")), F.struct("page_idx", "block_id")).alias("title"))


def build_tree(blocks: DataFrame) -> DataFrame:
    """Leaves of the documents: lists of a page's consecutive items, tables and other blocks, each with its place on the page and the headings above it.

    Headings and titles are no leaves. Leaves are named by their first block; ``items``
    is set for lists, ``latex`` for equations, ``text`` for the others but tables.
    """
    kept = blocks.join(split_paratext(blocks).where("fate in ('kept', 'rescued', 'empty')").select("block_id", "fate"), "block_id")
    # a rescued header or footer is a paragraph or a formula
    rescued = F.col("fate") == "rescued"
    kept = kept.withColumns({"type": F.when(rescued, F.when(is_math(F.col("text")), "equation").otherwise("text")).otherwise(F.col("type")), "text": F.when(rescued, stripped(F.col("text"))).otherwise(F.col("text"))})
    kept = reclassify(kept)
    lists = list_groups(kept).select("first_block", "items", F.col("content").alias("list_content"))
    paths = heading_path(kept).drop("document_id")
    item = is_list_item(F.col("type"), F.coalesce("text", F.lit("")))
    b = kept.withColumn("kind", F.when(item, "list").otherwise(kind(F.col("type")))).join(paths, "block_id").join(lists, F.col("block_id") == F.col("first_block"), "left")
    # an empty block ends a list, but is no leaf
    leaves = b.where("fate <> 'empty' and kind <> 'heading' and (kind <> 'list' or first_block is not null)").drop("first_block")
    place = F.row_number().over(Window.partitionBy("document_id", "page_idx").orderBy("block_id"))
    text = F.when(F.col("kind") == "code", plain_lines(F.col("text"))).when(F.col("kind") == "paragraph", flat(F.col("text")))
    return leaves.select(
        "document_id", "block_id", "page_idx", (F.col("page_idx") + 1).alias("page_no"), place.cast("int").alias("ordinal"), "kind", "heading_path", F.try_element_at("heading_path", F.lit(-1)).alias("heading"),
        text.alias("text"), "items", "list_content", F.when(F.col("kind") == "equation", plain_lines(F.col("text"))).alias("latex"),
    )


def raw_payload(leaves: DataFrame) -> DataFrame:
    """What is stored of a leaf: latex, items or text; nothing for a table."""
    raw = F.when(F.col("kind") == "equation", F.to_json(F.struct("latex"))).when(F.col("kind") == "list", F.to_json(F.struct("items"))).when(F.col("kind") != "table", F.to_json(F.struct("text")))
    return leaves.withColumn("raw", raw)
