"""Grids to canonical tables: slicing, transposing, naming, sampling, conformance, crosstabs.

A grid is ``array<array<string>>``; its operators are expressions on that array,
so a table is shaped where its row lies. Long tables are used exploded, as
(table, row, column, value).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ordering import numbered


def cell(value: Column) -> Column:
    """A cell's text; an absent cell is empty."""
    return F.coalesce(value, F.lit(""))


def width(grid: Column) -> Column:
    """Cells of the longest row."""
    return F.coalesce(F.array_max(F.transform(grid, lambda r: F.size(r))), F.lit(0))


def transpose(grid: Column) -> Column:
    """Columns as rows; short rows are filled."""
    return F.transform(F.when(width(grid) > 0, F.sequence(F.lit(0), width(grid) - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.transform(grid, lambda r: cell(F.get(r, i))))


def sliced(grid: Column, col_start: Column, col_end: Column, rows: Column | None = None) -> Column:
    """Columns ``[start, end)`` of the rows."""
    return F.transform(rows if rows is not None else grid, lambda r: F.transform(F.slice(r, col_start + 1, F.greatest(col_end - col_start, F.lit(0))), cell))


def body(grid: Column, data_start: Column, data_end: Column, metadata_rows: Column) -> Column:
    """Data rows: within the range, no metadata row, not all empty."""
    return F.filter(F.filter(grid, lambda r, i: (i >= data_start) & (i < data_end) & ~F.array_contains(metadata_rows, i)), lambda r: F.exists(r, lambda c: F.trim(cell(c)) != ""))


def headers(grid: Column, header_rows: Column) -> Column:
    """A name for each column from several header rows: distinct parts joined; numbers and blanks give ``col{i}``."""
    heads = F.filter(grid, lambda r, i: F.array_contains(header_rows, i))
    full = F.filter(heads, lambda r: F.size(F.filter(r, lambda c: F.trim(cell(c)) != "")) > 1)
    used = F.when(F.size(full) > 0, full).otherwise(heads)
    columns = F.when(width(grid) > 0, F.sequence(F.lit(0), width(grid) - 1)).otherwise(F.array().cast("array<int>"))

    def name(i: Column) -> Column:
        parts = F.array_distinct(F.filter(F.transform(used, lambda r: F.trim(cell(F.get(r, i)))), lambda p: p != ""))
        joined = F.array_join(parts, " ")
        return F.when((joined == "") | joined.rlike(r"^-?[0-9]+\.[0-9]+$"), F.concat(F.lit("col"), i.cast("string"))).otherwise(joined)

    return F.transform(columns, name)


def stride_sample(rows: DataFrame, by: list[str], order: list[str], k: int = 10) -> DataFrame:
    """All rows of a table of up to ``k``, else every ``n/k``-th."""
    r = numbered(rows, by, order)
    picks = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * F.col("n") / k).cast("int"))
    return r.where((F.col("n") <= k) | F.array_contains(picks, F.col("rn"))).drop("rn", "n")


def stratified_sample(rows: DataFrame, by: list[str], order: list[str], top: int = 4, bottom: int = 2, every: int = 25, cap: int = 20) -> DataFrame:
    """First rows, last rows and every ``every``-th between, at most ``cap`` a table (the sample's own size)."""
    r = numbered(rows, by, order)
    step = F.greatest(F.lit(every), F.ceil((F.col("n") - top - bottom) / F.lit(cap - top - bottom)))
    return r.where((F.col("rn") < top) | (F.col("rn") >= F.col("n") - bottom) | (F.pmod(F.col("rn") - top, step) == 0)).drop("rn", "n")


def column_kinds(cells: DataFrame, by: list[str], value: str = "value", place: str = "row_idx") -> DataFrame:
    """Majority of number, date and text; of equals the one seen first."""
    v = F.trim(value)
    kind = F.when(F.regexp_replace(v, "[,%]", "").rlike(r"^-?[0-9]+(\.[0-9]+)?$"), "number").when(v.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), "date").otherwise("text")
    counted = cells.where(v != "").withColumn("kind", kind).groupBy(*by, "kind").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
    return counted.groupBy(*by).agg(F.max_by("kind", F.struct("n", -F.col("first"))).alias("kind"))


def number_of(value: Column) -> Column:
    """A cell as a number without thousands and percent signs, or null."""
    plain = F.regexp_replace(F.trim(value), "[,%]", "")
    return F.when(plain.rlike(r"^[-+]?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?$"), plain.try_cast("double"))


def conformance(cells: DataFrame, by: list[str], order: str = "row_idx", value: str = "value") -> DataFrame:
    """Runs of rows that match, leave blank or differ from their column's reference class."""
    v = F.trim(F.col(value))
    cls = F.when(v == "", None).when(F.regexp_replace(v, "[,%]", "").rlike(r"^-?[0-9]+(\.[0-9]+)?$"), "n").when(v.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), "t").otherwise("s")
    w = Window.partitionBy(*by).orderBy(order)
    c = cells.withColumn("cls", cls)
    c = c.withColumn("ref", F.first("cls", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    c = c.withColumn("state", F.when(F.col("cls").isNull(), "blank").when(F.col("cls") == F.col("ref"), "match").otherwise("differ"))
    c = c.withColumn("opens", F.when(F.col("state") == F.lag("state").over(w), 0).otherwise(1))
    c = c.withColumn("run", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return c.groupBy(*by, "run", "state").agg(F.min(order).alias("from_row"), F.max(order).alias("to_row"), F.count(F.lit(1)).alias("n"))


def transposed_body(grid: Column, data_start: Column, data_end: Column, col_start: Column, col_end: Column) -> tuple[Column, Column]:
    """A table whose records are columns: headers and data rows of the slice, turned; its first row then names the columns."""
    turned = transpose(sliced(grid, col_start, col_end, F.filter(grid, lambda r, i: (i >= data_start) & (i < data_end))))
    none = F.expr("cast(array() as array<int>)")
    return headers(turned, F.array(F.lit(0))), body(turned, F.lit(1), F.size(turned), none)


def unpivot(grid: DataFrame, keys: list[str], values: list[str], name: str = "header", value: str = "value") -> DataFrame:
    """A crosstab in long form: one row for each cell that isn't empty."""
    return grid.unpivot(keys, values, name, value).where(F.col(value).isNotNull() & (F.trim(F.col(value).cast("string")) != ""))


def claims(tables: DataFrame) -> DataFrame:
    """Tables of one region made disjoint: in order of their start, a table begins after any earlier one whose columns it shares."""
    entry = F.struct("data_start", "table_no", "data_end", "col_start", "col_end")
    blank = F.expr("cast(array() as array<struct<table_no:int,data_start:int,data_end:int,col_start:int,col_end:int>>)")

    def put(done: Column, t: Column) -> Column:
        taken = F.filter(done, lambda d: (d["col_start"] < t["col_end"]) & (t["col_start"] < d["col_end"]))
        start = F.greatest(t["data_start"], F.coalesce(F.array_max(F.transform(taken, lambda d: d["data_end"])), F.lit(0)))
        kept = F.struct(t["table_no"].alias("table_no"), start.alias("data_start"), t["data_end"].alias("data_end"), t["col_start"].alias("col_start"), t["col_end"].alias("col_end"))
        return F.when(start < t["data_end"], F.concat(done, F.array(kept))).otherwise(done)

    folded = tables.groupBy("region_id").agg(F.array_sort(F.collect_list(entry)).alias("t"))  # the few tables of one sheet's region
    return folded.select("region_id", F.inline(F.aggregate("t", blank, put)))


def overlaps(tables: DataFrame) -> DataFrame:
    """Pairs of tables of a region whose rectangles intersect."""
    a, b = tables.alias("a"), tables.alias("b")  # the few tables of one sheet's region
    meet = (F.col("a.region_id") == F.col("b.region_id")) & (F.col("a.table_no") < F.col("b.table_no")) & (F.col("a.data_start") < F.col("b.data_end")) & (F.col("b.data_start") < F.col("a.data_end")) & (F.col("a.col_start") < F.col("b.col_end")) & (F.col("b.col_start") < F.col("a.col_end"))
    return a.join(b, meet).select(F.col("a.region_id").alias("region_id"), F.col("a.table_no").alias("first_no"), F.col("b.table_no").alias("second_no"))


def find_header(grid: Column, look: int = 8) -> Column:
    """Rule-based header row: the first of the leading rows with two or more cells, all of them text, before a row with a number; else 0."""
    lead = F.slice(grid, 1, look)
    text_only = lambda r: (F.size(F.filter(r, lambda c: F.trim(cell(c)) != "")) > 1) & F.forall(F.filter(r, lambda c: F.trim(cell(c)) != ""), lambda c: number_of(c).isNull())
    return F.greatest(F.array_position(F.transform(lead, text_only), True) - 1, F.lit(0)).cast("int")
