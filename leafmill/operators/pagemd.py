"""Tagged page markdown, as a page reader gives it, to blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tags of the page format (fixed values).
TAGS = ["TEXT", "EXTRA", "LIST", "TABLE", "FORM", "CODE", "EQUATION", "VISUAL", "PARATEXT"]
#: Lines in which a reader talks about itself instead of the page (fixed patterns).
META = [
    r"(?i)^here is the (content|text|transcription)\b", r"(?i)^this transcription includes\b", r"(?i)^i (cannot|can't|am unable to)\b",
    r"(?i)^the (provided )?image (is|appears)\b.*(blank|empty)", r"(?i)^there is no (visible )?(text|content)\b", r"(?i)^therefore,.*(cannot|no markdown|no table)\b",
]


def strip_think(text: Column) -> Column:
    """Think marks away, what they hold stays."""
    return F.regexp_replace(text, r"</?think>", "")


def strip_fence(text: Column) -> Column:
    """A fence around the whole response away; fences inside must pair up, else the first one closes earlier."""
    inner = F.regexp_extract(text, r"(?s)^\s*```[a-zA-Z]*\n(.*?)\n?```\s*$", 1)
    return F.when(text.rlike(r"(?s)^\s*```[a-zA-Z]*\n.*```\s*$") & (F.regexp_count(inner, F.lit("(?m)^```")) % 2 == 0), inner).otherwise(text)


def strip_meta(text: Column) -> Column:
    """Rules and self-talk away."""
    lines = F.split(text, "\n", -1)
    bad = lambda x: (F.trim(x) == "---") | F.coalesce(*[F.when(F.trim(x).rlike(p), True) for p in META], F.lit(False))
    return F.array_join(F.filter(lines, lambda x: ~bad(x)), "\n")


def lines_of(pages: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Lines in order, each with its fence state and its tag: windows within one page."""
    w = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    lines = pages.select(*keys, F.posexplode(F.split(F.col(text), "\n", -1)).alias("line_no", "line"))
    fence = F.col("line").startswith("```")
    lines = lines.withColumn("fences", F.sum(fence.cast("int")).over(w)).withColumn("in_code", fence | (F.col("fences") % 2 == 1))
    named = F.regexp_extract("line", r"^==([A-Z]+)==\s*$", 1)
    tag = F.when(~F.col("in_code") & named.isin(TAGS), named)
    lines = lines.withColumn("own_tag", tag).withColumn("tag", F.coalesce(F.last("own_tag", ignorenulls=True).over(w), F.lit("TEXT")))
    return lines.withColumn("section", F.sum(F.col("own_tag").isNotNull().cast("int")).over(w))


def sections(pages: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Tagged stretches of each page in order: section, tag, content."""
    lines = lines_of(pages, keys, text).where("own_tag is null")
    s = lines.groupBy(*keys, "section", "tag").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("content"))
    return s.where(F.trim("content") != "")


def section_blocks(sections_of: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks of tagged stretches: type, text, grid and their order on the page.

    A list gives an item a line; a table or form its grid or, without one, paragraphs;
    code stays whole; formulas, pictures, page furniture and text are paragraphs.
    """
    grid = markdown_grid(F.col("content"))
    tabular = F.col("tag").isin("TABLE", "FORM") & (F.size(grid) > 0)
    lines = F.split(F.col("content"), "\n", -1)
    paragraphs_of = F.split(F.col("content"), r"\n\s*\n", -1)
    parts = F.when(F.col("tag") == "LIST", lines).when(F.col("tag") == "CODE", F.array("content")).when(tabular, F.array(F.lit(None).cast("string"))).otherwise(paragraphs_of)
    clean = F.filter(F.transform(parts, lambda x: F.when(F.col("tag") == "CODE", x).otherwise(F.regexp_replace(x, r"^\s+|\s+$", ""))), lambda x: tabular | (x != ""))
    kind_of = F.when(F.col("tag") == "LIST", "list_item").when(tabular, "table").when(F.col("tag") == "CODE", "code").when(F.col("tag") == "EQUATION", "equation").when(F.col("tag") == "VISUAL", "image").when(F.col("tag") == "PARATEXT", "header").otherwise("text")
    rows = sections_of.select(*keys, "section", kind_of.alias("type"), F.when(tabular, grid).alias("grid"), F.posexplode(clean).alias("part", "text"))
    w = Window.partitionBy(*keys).orderBy("section", "part")
    return rows.select(*keys, (F.row_number().over(w) - 1).cast("int").alias("ordinal"), "type", "text", "grid")


def markdown_grid(content: Column) -> Column:
    """Rows of a pipe table; only a separator row is left out."""
    rows = F.filter(F.split(content, "\n"), lambda x: x.contains("|") & ~F.trim(x).rlike(r"^[\s|:-]+$"))
    return F.transform(rows, lambda r: F.transform(F.split(F.regexp_replace(F.trim(r), r"^\||\|$", ""), r"\|", -1), lambda c: F.trim(c)))


def plain_blocks(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Markdown without tags: headings, pipe runs and paragraphs as islands of lines."""
    w = Window.partitionBy(*keys).orderBy("line_no")
    x = texts.select(*keys, F.posexplode(F.split(F.col(text), "\n", -1)).alias("line_no", "line"))
    kind = F.when(F.trim("line") == "", "blank").when(F.col("line").rlike(r"^#{1,6} \S"), "title").when(F.trim("line").startswith("|"), "table").otherwise("text")
    x = x.withColumn("kind", kind)
    opens = (F.col("kind") == "title") | ~F.coalesce(F.lag("kind").over(w) == F.col("kind"), F.lit(False))
    x = x.withColumn("island", F.sum(opens.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("kind <> 'blank'")
    level = F.length(F.regexp_extract(F.min("line"), "^(#+) ", 1))
    return x.groupBy(*keys, "island", "kind").agg(F.when(F.col("kind") == "title", level).cast("int").alias("text_level"), F.count(F.lit(1)).alias("n_lines"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda v: F.regexp_replace(v["line"], "^#+ ", "")), "\n").alias("content"))


def paragraphs(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Plain text split at blank lines."""
    parts = F.filter(F.transform(F.split(F.col(text), r"\n[ \t\r]*\n", -1), lambda p: F.trim(F.regexp_replace(p, r"^\s+|\s+$", ""))), lambda p: p != "")
    return texts.select(*keys, F.posexplode(parts).alias("ordinal", "paragraph"))
