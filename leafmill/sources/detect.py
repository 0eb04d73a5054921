"""Which kind of file: by magic bytes, by extension, by a look at the text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: First bytes in hexadecimal (fixed values), and kinds by extension.
MAGIC = {"25504446": "pdf", "89504E47": "image", "FFD8FF": "image", "47494638": "image", "52494646": "image", "49492A00": "image", "4D4D002A": "image", "D0CF11E0": "office", "7B5C727466": "office"}
ZIPPED = {"xlsx": "sheet", "xlsm": "sheet", "ods": "office", "pptx": "slides", "docx": "document", "odt": "office", "odp": "office", "epub": "office"}
PLAIN = {"csv": "csv", "tsv": "tsv", "tab": "tsv", "json": "json", "jsonl": "json", "xml": "xml", "svg": "svg", "html": "html", "htm": "html", "xhtml": "html", "md": "markdown", "markdown": "markdown", "txt": "text", "doc": "office", "rtf": "office", "ppt": "office"}
HEAD = 65536
#: How markup begins (a fixed pattern).
MARKUP = r"(?i)^(<!doctype html|<html|<\?xml|<[a-z]+[\s>/])"


def extension(path: Column) -> Column:
    """Lower-case suffix of a path."""
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]{1,9})$", 1))


def magic(content: Column) -> Column:
    """Kind by the first bytes, or null; a zip archive gives ``zip``."""
    head = F.hex(F.substring(content, 1, 8))
    out = F.when(head.startswith("504B0304"), "zip")
    for prefix, kind in MAGIC.items():
        out = out.when(head.startswith(prefix), kind)
    return out


def separated(text: Column, sep: str, lines: int = 20) -> Column:
    """Two or more of the first lines that aren't blank hold one and the same positive number of separators."""
    head = F.slice(F.split(F.substring(text, 1, HEAD), "\r?\n"), 1, lines)
    n = F.transform(F.filter(head, lambda x: F.trim(x) != ""), lambda x: F.length(x) - F.length(F.replace(x, F.lit(sep), F.lit(""))))
    return (F.size(n) >= 2) & (F.array_min(n) == F.array_max(n)) & (F.array_min(n) > 0)


def sniff(text: Column) -> Column:
    """json, html, csv, tsv or text, by the first 64 Ki characters."""
    t = F.regexp_replace(F.substring(text, 1, HEAD), r"^[\s\uFEFF]+", "")
    return F.when(F.substring(t, 1, 1).isin("{", "["), "json").when(t.rlike(MARKUP), "html").when(separated(text, ","), "csv").when(separated(text, "\t"), "tsv").otherwise("text")


def kind(path: Column, content: Column) -> Column:
    """The reader a file goes to."""
    ext = extension(path)
    plain, zipped = F.lit(None).cast("string"), F.lit("office")
    for e, k in PLAIN.items():
        plain = F.when(ext == e, k).otherwise(plain)
    for e, k in ZIPPED.items():
        zipped = F.when(ext == e, k).otherwise(zipped)
    m = magic(content)
    return F.when(m == "zip", zipped).otherwise(F.coalesce(m, plain, sniff(F.make_valid_utf8(F.substring(content, 1, HEAD).cast("string")))))
