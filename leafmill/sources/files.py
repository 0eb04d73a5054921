"""Files to blocks and grids: one pass over ``binaryFile`` rows, a reader for each kind.

A file that can't be read becomes a row with an error, never a failed job.
Page images and PDFs go to a ``PageReader``; formats that need an external
converter go to a ``Converter``. Without one they are reported, not guessed.
"""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import cut
from ..plans.ordering import numbered
from . import detect, html, images, markdown, office

SCHEMA = "path string, kind string, page_idx int, ordinal int, type string, text string, text_level int, grid array<array<string>>, error string"


class PageReader(Protocol):
    """Reads the pages of an image or PDF as tagged markdown."""

    def __call__(self, content: bytes, kind: str) -> list[str]: ...


class Converter(Protocol):
    """Turns an office format into one of the readable kinds: its kind and bytes."""

    def __call__(self, content: bytes, path: str) -> tuple[str, bytes]: ...


def grid_of_csv(text: str, sep: str) -> list[list[str]]:
    """Cells of delimited text: leading blank lines skipped, longer rows cut to the header's width."""
    rows = [r for r in csv.reader(io.StringIO(text.lstrip("﻿").lstrip("\r\n")), delimiter=sep) if r]
    if not rows:
        return []
    n = len(rows[0])
    return [(r + [""] * n)[:n] for r in rows]


def grids_of_json(text: str) -> list[tuple[str, list[list[str]]]]:
    """Entity grids: nested objects dotted, lists of objects as child entities with the parent's id."""
    tables: dict[str, list[dict]] = {}

    def plain(v) -> str:
        return "" if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)

    def add(name: str, obj: dict, parent: tuple[str, int] | None) -> None:
        own = len(tables.setdefault(name, [])) + 1
        record: dict = {"_id": str(own)} | ({f"{parent[0]}_id": str(parent[1])} if parent else {})
        tables[name].append(record)

        def walk(o: dict, prefix: str) -> None:
            for k, v in o.items():
                if isinstance(v, dict):
                    walk(v, f"{prefix}{k}.")
                elif isinstance(v, list) and v and all(isinstance(x, dict) for x in v):
                    for x in v:
                        add(f"{name}.{prefix}{k}", x, (name, own))
                else:
                    record[prefix + k] = plain(v)

        walk(obj, "")

    value = json.loads(text)
    for x in value if isinstance(value, list) else [value]:
        add("root", x if isinstance(x, dict) else {"value": x}, None)
    out = []
    for name, records in tables.items():
        keys = list(dict.fromkeys(k for r in records for k in r))
        out.append((name, [keys, *[[r.get(k, "") for k in keys] for r in records]]))
    return out


def read_one(path: str, kind: str, content: bytes, pages: PageReader | None, convert: Converter | None) -> list[dict]:
    """Blocks of one file."""
    text = content.decode("utf-8", "replace") if kind in ("csv", "tsv", "json", "xml", "html", "markdown", "text") else ""
    if kind in ("csv", "tsv"):
        return [{"page_idx": 0, "type": "table", "grid": grid_of_csv(text, "," if kind == "csv" else "\t")}]
    if kind == "json":
        return [{"page_idx": 0, "type": "table", "text": n, "grid": g} for n, g in grids_of_json(text)]
    if kind == "xml":
        return [{"page_idx": 0, "type": "table", "text": n, "grid": g} for n, g in grids_of_json(json.dumps(office.read_xml(content)))]
    if kind == "html":
        return [{"page_idx": 0, **b} for b in html.blocks_of(text)]
    if kind == "markdown":
        return [{"page_idx": 0, **b} for b in markdown.blocks_of(text)]
    if kind == "text":
        import re

        return [{"page_idx": 0, "type": "text", "text": p.strip()} for p in re.split(r"\n[ \t\r]*\n", text) if p.strip()]
    if kind == "sheet":
        return [{"page_idx": i, "type": "table", "text": s["sheet"], "grid": s["grid"]} for i, s in enumerate(office.read_xlsx(content))]
    if kind == "slides":
        return office.read_pptx(content)
    if kind == "document":
        return office.read_docx(content)
    if kind in ("pdf", "image"):
        if kind == "image" and images.is_blank(content):  # a blank page has no blocks and needs no reader
            return []
        if pages is None:
            raise ValueError(f"no page reader for {kind}")
        return [{"page_idx": i, "type": "page", "text": md} for i, md in enumerate(pages(content, kind))]
    if convert is None:
        raise ValueError(f"no converter for {kind}")
    return read_one(path, *convert(content, path), pages, None)


def read(files: DataFrame, pages: PageReader | None = None, convert: Converter | None = None) -> DataFrame:
    """Blocks of all files of a ``binaryFile`` frame, in Arrow batches."""
    kinds = files.select("path", detect.kind(F.col("path"), F.col("content")).alias("kind"), "content")

    def run(frames):
        for f in frames:
            out = []
            for path, kind, content in zip(f["path"], f["kind"], f["content"], strict=True):
                try:
                    got = read_one(path, kind, bytes(content), pages, convert)
                    rows = [{**b, "ordinal": i} for i, b in enumerate(got)]
                except Exception as e:  # noqa: BLE001 - one bad file is a row, not a failed job
                    rows = [{"page_idx": 0, "ordinal": 0, "type": "error", "error": f"{type(e).__name__}: {e}"[:500]}]
                out += [{"path": path, "kind": kind, **r} for r in rows]
            cols = ["path", "kind", "page_idx", "ordinal", "type", "text", "text_level", "grid", "error"]
            frame = pd.DataFrame(out, columns=cols)
            for c in ("page_idx", "ordinal", "text_level"):
                frame[c] = frame[c].astype("Int32")
            yield frame.astype(object).where(frame.notna(), None).astype({c: "Int32" for c in ("page_idx", "ordinal", "text_level")})

    return kinds.mapInPandas(run, SCHEMA)


def read_delimited(spark: SparkSession, path: str, sep: str = ",", multi_line: bool = False) -> DataFrame:
    """Rows of delimited files of one layout as the row store has them: path, row_idx (0 is the header), values.

    Read by Spark's own reader, so one large file is many tasks; with ``multi_line``, for
    values that hold line breaks, a file is one. All values are strings, an absent one is
    empty, and rows longer than the header are cut to its width.
    """
    raw = spark.read.csv(path, sep=sep, header=False, inferSchema=False, quote='"', escape='"', multiLine=multi_line, enforceSchema=True, nullValue="", emptyValue="")
    cells = [F.coalesce(F.col(c), F.lit("")) for c in raw.columns]
    rows = raw.select("_metadata.file_path", F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("id"), F.array(*cells).alias("values"))
    return numbered(rows, ["file_path"], ["at", "id"], number="row_idx").select(F.col("file_path").alias("path"), "row_idx", "values")


def read_with_retries(files: DataFrame, reader: Callable[[DataFrame], DataFrame], most: int = 3) -> DataFrame:
    """Blocks of all files with the attempt they came from; files that gave nothing but errors are read again, ``most`` times in all.

    What still fails then stays as its last error: one bad file is a row, not a failed job.
    """
    done, todo = None, files
    for attempt in range(1, most + 1):
        got = cut(reader(todo).withColumn("attempt", F.lit(attempt)))
        failed = got.groupBy("path").agg(F.bool_and(F.coalesce(F.col("type") == "error", F.lit(False))).alias("failed")).where("failed").select("path")
        last = attempt == most or failed.isEmpty()
        kept = got if last else got.join(failed, "path", "left_anti").select(got.columns)
        done = kept if done is None else done.unionByName(kept)
        if last:
            return done
        todo = todo.join(cut(failed), "path", "left_semi")
    return done


def open_folder(spark: SparkSession, path: str) -> DataFrame:
    """Files under a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


ReaderOf = Callable[[bytes], list[dict]]
