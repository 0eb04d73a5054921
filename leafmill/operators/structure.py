"""Reading a grid: samples for a structurer, the structurer's entry made safe, anchors, fragments, coverage.

A ``StructureModel`` may be a language model; the default finds headers by rule.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ordering import numbered
from . import grid as G
from .reduce import word_count


class StructureModel(Protocol):
    """Describes the tables of a grid shown as text: header rows, data range, columns, title."""

    def __call__(self, grid_text: str, kinds: list[str]) -> list[dict]: ...


def rule_model(grid_text: str, kinds: list[str]) -> list[dict]:
    """The default: one table under the first row of two or more words before a row with a number."""
    rows = [r.split("|") for r in grid_text.split("\n")]
    number = lambda c: c.strip().replace(",", "").replace("%", "").replace(".", "", 1).lstrip("-").isdigit()
    head = next((i for i, r in enumerate(rows[:8]) if sum(bool(c.strip()) for c in r) > 1 and not any(number(c) for c in r)), 0)
    return [{"header_rows": [head], "data_start": head + 1, "data_end": len(rows), "col_start": 0, "col_end": max(map(len, rows), default=0)}]


def budget_sample(rows: DataFrame, by: list[str], order: str, text: str, budget: int, most: int = 50) -> DataFrame:
    """All rows of a table if they fit the budget, else its edges and an even stride of what fits, at most ``most`` (the sample's own size)."""
    r = numbered(rows.withColumn("t", word_count(F.col(text))), by, [order], sums={"sum": "t"})
    fits = F.least(F.lit(most), F.floor(F.lit(budget) * F.col("n") / F.greatest(F.col("sum"), F.lit(1))))
    step = F.greatest(F.lit(1), F.ceil(F.col("n") / F.greatest(fits, F.lit(1))))
    return r.where(((F.col("sum") <= budget) & (F.col("n") <= most)) | (F.col("rn") == 0) | (F.col("rn") == F.col("n") - 1) | (F.pmod(F.col("rn"), step) == 0)).drop("t", "rn", "n", "sum")


def clamp(entries: DataFrame, single: bool = False) -> DataFrame:
    """An entry's bounds held inside its grid (``grid`` column); a single table takes the full width; metadata rows outside the data go."""
    n, wide = F.size("grid"), G.width(F.col("grid"))
    start = F.greatest(F.lit(0), F.least(F.coalesce("data_start", F.lit(0)), n))
    end = F.greatest(start, F.least(F.coalesce("data_end", n), n))
    col_start = F.lit(0) if single else F.greatest(F.lit(0), F.least(F.coalesce("col_start", F.lit(0)), wide))
    col_end = wide if single else F.greatest(col_start, F.least(F.coalesce("col_end", wide), wide))
    meta = F.filter(F.coalesce("metadata_rows", F.expr("cast(array() as array<int>)")), lambda r: (r >= start) & (r < end))
    heads = F.filter(F.coalesce("header_rows", F.expr("cast(array() as array<int>)")), lambda r: (r >= 0) & (r < n))
    return entries.withColumns({"data_start": start, "data_end": end, "col_start": col_start, "col_end": col_end, "metadata_rows": meta, "header_rows": heads})


def title_of(grid: Column, row: Column) -> Column:
    """A title row's distinct cells from left to right."""
    return F.array_join(F.array_distinct(F.filter(F.transform(F.get(grid, row), lambda c: F.trim(G.cell(c))), lambda c: c != "")), " ")


def anchors(row_offset: Column, col_offset: Column, data_start: Column, data_end: Column, col_start: Column, col_end: Column, header_rows: Column) -> Column:
    """Where a table lies on its sheet."""
    first = F.least(data_start, F.coalesce(F.array_min(header_rows), data_start))
    return F.struct((row_offset + first).alias("min_row"), (row_offset + data_end - 1).alias("max_row"), (col_offset + col_start).alias("min_col"), (col_offset + col_end - 1).alias("max_col"), F.transform(header_rows, lambda r: r + row_offset).alias("header_rows"))


def join_fragments(fragments: DataFrame, by: list[str]) -> DataFrame:
    """Fragments of one table under one header: rows counted together, anchors from least to greatest."""
    return fragments.groupBy(*by).agg(F.sum("n_rows").alias("n_rows"), F.min("min_row").alias("min_row"), F.max("max_row").alias("max_row"), F.count(F.lit(1)).alias("fragments"))


def union_fragments(fragments: DataFrame, by: list[str], order: list[str], grid: str = "grid") -> DataFrame:
    """The rows of fragments of one table one after the other: the first fragment's header, and the data rows of all, renumbered.

    A fragment repeats the header or lacks it: its first row is left out where it is the
    header again. Rows are taken by position and filled or cut to the header's width.
    """
    f = fragments.where(F.size(grid) > 0)
    first = f.groupBy(*by).agg(F.min_by(F.get(grid, F.lit(0)), F.struct(*order)).alias("header"), F.min(F.struct(*order)).alias("opening"))
    rows = f.join(first, by).select(*by, "header", F.struct(*order).alias("__piece"), (F.struct(*order) == F.col("opening")).alias("__opens"), F.posexplode(grid).alias("__i", "values"))
    rows = rows.where(~((F.col("__i") == 0) & (F.col("__opens") | (F.col("values") == F.col("header")))))
    fitted = F.transform(F.sequence(F.lit(0), F.greatest(F.size("header"), F.lit(1)) - 1), lambda i: G.cell(F.get(F.col("values"), i)))
    rows = rows.withColumn("values", F.when(F.size("header") > 0, fitted).otherwise(F.array().cast("array<string>")))
    return numbered(rows.select(*by, "header", "__piece", "__i", "values"), by, ["__piece", "__i"], number="row_idx").drop("__piece", "__i", "n")


def conforming_extent(profiles: DataFrame, tables: DataFrame, by: str = "region_id") -> DataFrame:
    """Tables extended down while rows keep the profile of their first data row: ``tables``: region_id, table_no, data_start, data_end; blank cells fit any class."""
    first = tables.join(profiles.select(by, F.col("row_idx").alias("data_start"), F.col("profile").alias("like")), [by, "data_start"])
    below = first.join(profiles, by).where(F.col("row_idx") >= F.col("data_end"))
    fits = (F.length("profile") == F.length("like")) & F.forall(F.sequence(F.lit(1), F.length("like")), lambda i: (F.substr(F.col("profile"), i, F.lit(1)) == "_") | (F.substr(F.col("like"), i, F.lit(1)) == "_") | (F.substr(F.col("profile"), i, F.lit(1)) == F.substr(F.col("like"), i, F.lit(1))))
    stop = below.where(~fits).groupBy(by, "table_no").agg(F.min("row_idx").alias("stop"))
    last = profiles.groupBy(by).agg((F.max("row_idx") + 1).alias("rows"))
    return first.join(stop, [by, "table_no"], "left").join(last, by).select(by, "table_no", "data_start", F.greatest("data_end", F.coalesce("stop", "rows")).cast("int").alias("data_end"))


def structured(grids: DataFrame, model: StructureModel = rule_model, budget: int = 2048) -> DataFrame:
    """What a structure model finds in each grid (block_id, grid), window by window, made safe.

    A grid is shown in windows of whole rows of about ``budget`` tokens, each with its
    columns' kinds; a model may find several tables in each. Row numbers are the grid's.
    Defined cases: an empty grid has no table; an entry that a model gives without bounds
    takes its window's; what a model raises leaves that window without tables.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for block, grid in zip(f["block_id"], f["grid"], strict=True):
                rows = [["" if c is None else str(c) for c in r] for r in (grid if grid is not None else [])]
                number = 0
                for start, end in windows(rows, budget):
                    part = rows[start:end]
                    wide = max(map(len, part), default=0)
                    kinds = [_kind([r[i] for r in part if i < len(r)]) for i in range(wide)]
                    try:
                        found = model("\n".join("|".join(r) for r in part), kinds)
                    except Exception:  # noqa: BLE001 - a model that fails on one window finds nothing there
                        found = []
                    for e in found:
                        heads = [start + int(h) for h in e.get("header_rows") or []]
                        meta = [start + int(h) for h in e.get("metadata_rows") or []]
                        out.append((block, number, heads, start + int(e.get("data_start", 0)), start + int(e.get("data_end", len(part))), int(e.get("col_start", 0)), int(e.get("col_end", wide)), meta))
                        number += 1
            yield pd.DataFrame(out, columns=["block_id", "table_no", "header_rows", "data_start", "data_end", "col_start", "col_end", "metadata_rows"])

    found = grids.select("block_id", "grid").mapInPandas(run, "block_id bigint, table_no int, header_rows array<int>, data_start int, data_end int, col_start int, col_end int, metadata_rows array<int>")
    safe = clamp(found.join(grids.select("block_id", "grid"), "block_id")).drop("grid")
    claimed = G.claims(safe.select(F.col("block_id").alias("region_id"), "table_no", "data_start", "data_end", "col_start", "col_end")).withColumnRenamed("region_id", "block_id")
    return claimed.join(safe.select("block_id", "table_no", "header_rows", "metadata_rows"), ["block_id", "table_no"])


def windows(rows: list[list[str]], budget: int) -> list[tuple[int, int]]:
    """Stretches of whole rows of about ``budget`` tokens; one row at least."""
    out, start, used = [], 0, 0
    for i, r in enumerate(rows):
        t = sum(max(1, len(c) // 4) for c in r)
        if i > start and used + t > budget:
            out.append((start, i))
            start, used = i, 0
        used += t
    return [*out, (start, len(rows))] if rows else []


def _kind(values: list[str]) -> str:
    """number, date or text, whichever most cells are."""
    kinds = [("number" if re.fullmatch(r"-?[0-9]+(\.[0-9]+)?", re.sub("[,%]", "", v.strip())) else "date" if re.match(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", v.strip()) else "text") for v in values if v.strip()]
    return max(dict.fromkeys(kinds), key=kinds.count) if kinds else "text"


def uncovered(extents: DataFrame, tables: DataFrame) -> DataFrame:
    """Rows of a region that no table holds: each row's number against the tables' ranges."""
    rows = extents.select("region_id", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1)).alias("row_idx")).where("row_idx >= 0")
    held = tables.select("region_id", F.explode(F.sequence("data_start", F.col("data_end") - 1)).alias("row_idx"))
    return rows.join(held.distinct(), ["region_id", "row_idx"], "left_anti")


def row_profile(cells: DataFrame, by: list[str], row: str = "row_idx", col: str = "col", value: str = "value") -> DataFrame:
    """A row's classes in column order, as one word."""
    v = F.trim(F.col(value))
    cls = F.when(v == "", "_").when(v.rlike("(?i)^(true|false|yes|no)$"), "b").when(G.number_of(v).isNotNull(), "n").when(v.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), "t").otherwise("s")
    return cells.groupBy(*by, row).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(col), cls.alias("c")))), lambda x: x["c"]), "").alias("profile"))


def schema_runs(profiles: DataFrame, by: list[str], row: str = "row_idx") -> DataFrame:
    """Stretches of rows of one profile: a change of schema starts a new table."""
    w = Window.partitionBy(*by).orderBy(row)
    p = profiles.withColumn("opens", F.when(F.col("profile") == F.lag("profile").over(w), 0).otherwise(1))
    p = p.withColumn("run", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return p.groupBy(*by, "run", "profile").agg(F.min(row).alias("from_row"), F.max(row).alias("to_row"))
