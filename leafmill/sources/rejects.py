"""Problem 7: rows that fail to parse, apart from typed rows and with a reason.

Lines of delimited text are read permissively (``from_csv``) under an explicit
typed schema that keeps the raw text of a corrupt record; corrupt lines are then
classified again by a quoting check, a field count and a cast check of every value. Grid rows have
their cells already and get the count, quoting and cast checks. All of it is
expressions over one row: no shuffle but for duplicates.

Defined cases: a null line is a fault (``null line``); a line of a table that the
catalogue doesn't have is a fault (``unknown table``); an empty line is one null
field; a null grid has no rows, a null grid row has no cells, null ``col_types``
are no columns; rows delivered twice count once, typed rows by the latest
delivery (ties: the greater text); other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import spread
from ..session import table

#: Values that mean null, after trimming and in any case (fixed values).
NULLS = ["", "null", "n/a", "-"]
BOOLEANS = {True: ["true", "t", "yes", "y", "1"], False: ["false", "f", "no", "n", "0"]}
_TIME = "([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]"
_DATE = "[0-9]{4}-[0-9]{2}-[0-9]{2}"
#: Readers of one plan; a catalogue of more shapes is read in several passes.
SHAPES_A_PASS = 128
#: Types of the explicit schema.
TYPES = {"integer": "bigint", "decimal": "decimal(38,10)", "boolean": "boolean", "date": "date", "datetime": "timestamp_ntz"}
#: Signs of a line that the typed reader takes more liberally than the grammar: quotes, line breaks, plus signs,
#: exponents, points without digits on both sides, digits that aren't ASCII, years of more than four digits.
LAX = r'["+\n\r]|\.([^0-9]|$)|(^|[^0-9])\.|[0-9]\.?[eE]-?[0-9]|[\p{Nd}&&[^0-9]]|[0-9]{5}-'
_READ = "struct<values:array<string>,corrupt:string>"


def cast_fault(value: Column, dtype: Column) -> Column:
    """Whether a value isn't one of its type."""
    v = F.trim(value)
    good = (
        F.when(dtype == "integer", v.rlike("^-?[0-9]+$") & v.try_cast("bigint").isNotNull())
        .when(dtype == "decimal", v.rlike(r"^-?[0-9]+(\.[0-9]+)?$"))
        .when(dtype == "boolean", F.lower(v).isin(BOOLEANS[True] + BOOLEANS[False]))
        .when(dtype == "date", v.rlike(f"^{_DATE}$") & v.try_cast("date").isNotNull())
        .when(dtype == "datetime", v.rlike(f"^{_DATE}[T ]{_TIME}$") & F.substring(v, 1, 10).try_cast("date").isNotNull())
        .otherwise(True)
    )
    return ~is_null(value) & ~good


def is_null(value: Column) -> Column:
    """Whether a value stands for null."""
    return value.isNull() | F.lower(F.trim(value)).isin(NULLS)


def typed(value: Column, spec: Column) -> Column:
    """A value under its type: one field of the struct is set, all are null for a null."""
    v, kind = F.when(~is_null(value), F.trim(value)), spec["dtype"]
    return F.struct(
        spec["header"].alias("header"), kind.alias("dtype"),
        F.when(kind == "integer", v.try_cast("bigint")).alias("integer_value"),
        F.when(kind == "decimal", v.try_cast("decimal(38,10)")).alias("decimal_value"),
        F.when(kind == "boolean", F.lower(v).isin(BOOLEANS[True])).alias("boolean_value"),
        F.when(kind == "date", v.try_cast("date")).alias("date_value"),
        F.when(kind == "datetime", F.regexp_replace(v, "T", " ").try_cast("timestamp_ntz")).alias("datetime_value"),
        F.when(~kind.isin("integer", "decimal", "boolean", "date", "datetime"), F.when(~is_null(value), value)).alias("string_value"),
    )


def line_quoting(line: Column, sep: Column) -> tuple[Column, Column]:
    """Whether quoting is broken, and the number of fields where it isn't.

    The line is split at its quotes: every second part is inside quotes; a part
    between two quoted fields must begin and end with the delimiter (or be empty, a
    doubled quote), the first and last must meet a field's edge, and no line break
    stands outside.
    """
    parts = F.split(line, '"', -1)
    last = F.size(parts) - 1
    outside = F.filter(parts, lambda x, i: i % 2 == 0)
    bad_part = F.exists(
        F.transform(parts, lambda x, i: (i % 2 == 0) & (x != "") & (((i > 0) & ~x.startswith(sep)) | ((i < last) & ~x.endswith(sep)))),
        lambda x: x,
    )
    # a part after a closing quote that is one delimiter both begins and ends with it
    plain = ~line.contains('"')
    text = F.when(plain, line).otherwise(F.concat_ws("", outside))
    broken = text.rlike("[\n\r]") | (~plain & ((last % 2 != 0) | bad_part))
    count = F.length(text) - F.length(F.replace(text, sep, F.lit(""))) + 1
    return broken, count


def _shapes(catalog: DataFrame) -> list[tuple[str, tuple[str, ...]]]:
    """The distinct pairs of delimiter and column types of a catalogue: one reader each."""
    rows = catalog.select("delimiter", F.col("column_specs.dtype").alias("kinds")).where("delimiter is not null and size(kinds) > 0").distinct().collect()
    return sorted((r[0], tuple(k or "string" for k in r[1])) for r in rows)


def _key(sep: str, kinds: tuple[str, ...]) -> str:
    return "\x01".join((sep, *kinds))


def _key_of() -> Column:
    return F.concat_ws("\x01", F.array("delimiter"), F.transform("column_specs.dtype", lambda k: F.coalesce(k, F.lit("string"))))


def _text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _reader(sep: str, kinds: tuple[str, ...]) -> str:
    """SQL of the line read permissively under an explicit schema: its fields as text, and the corrupt record."""
    schema = ", ".join(f"c{i} {TYPES.get(k, 'string')}" for i, k in enumerate(kinds)) + ", corrupt string"
    # the buffers are those of a line, not of a file, as there is a reader for every shape
    options = {
        "sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt", "inputBufferSize": "1024", "maxColumns": str(len(kinds) + 1),
        "dateFormat": "yyyy-MM-dd", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss", "preferDate": "false",
    }
    given = ", ".join(f"{_text(k)}, {_text(v)}" for k, v in options.items())
    fields = ", ".join(f"cast(r.c{i} as string)" for i in range(len(kinds)))
    # wrapped in an array, so that one reading serves all columns
    return f"transform(array(from_csv(values_text, '{schema}', map({given}))), r -> named_struct('values', array({fields}), 'corrupt', r.corrupt))[0]"


def _by_shape(shapes: list, wanted: str, typed_read: bool) -> Column:
    """One flat choice among readers; null where the shape isn't among them or ``wanted`` is false."""
    readers: dict[tuple, list[int]] = {}
    for i, (sep, kinds) in shapes:
        readers.setdefault((sep, kinds if typed_read else ("string",) * len(kinds)), []).append(i)
    cases = " ".join(f"WHEN shape IN ({', '.join(map(str, at))}) THEN {_reader(*key)}" for key, at in readers.items())
    return F.expr(f"CASE WHEN NOT ({wanted}) OR shape IS NULL THEN CAST(NULL AS {_READ}) {cases} END")


def _read(both: DataFrame, shapes: list) -> DataFrame:
    """``both`` with the typed reading (``first``), and the reading as text where that one doubts (``again``)."""
    line, sep, width = F.col("values_text"), F.col("delimiter"), F.size("column_specs")
    marks = F.length(line) - F.length(F.replace(line, sep, F.lit(""))) + 1
    both = both.withColumn("sure", F.coalesce((marks == width) & ~line.rlike(LAX), F.lit(False)))
    # generated, not projected, so that no later filter can inline the readers again
    both = both.select("*", F.explode(F.array(_by_shape(shapes, "sure", True))).alias("first"))
    both = both.withColumn("doubted", F.coalesce(~F.col("sure") | F.col("first.corrupt").isNotNull() | F.col("first").isNull(), F.lit(True)))
    broken, count = line_quoting(line, sep)
    both = both.withColumns({"broken": F.when(F.col("doubted"), broken).otherwise(False), "fields": F.when(F.col("doubted"), count).otherwise(width)})
    return both.select("*", F.explode(F.array(_by_shape(shapes, "coalesce(doubted AND NOT broken AND fields = size(column_specs), false)", False))).alias("again"))


def read_lines(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """Each line with ``reason`` (null if it is valid) and ``values`` as strings.

    A line is first read under its table's types. One that comes back as a corrupt
    record, or that holds signs which the reader takes more liberally than the grammar
    (:data:`LAX`), is classified again by quoting, count and cast checks.
    """
    specs = catalog.select("table_id", "delimiter", "column_specs").dropDuplicates(["table_id"])
    shapes = list(enumerate(_shapes(specs)))
    # numbered by an expression over the catalogue, whose size stays known, so a small one is broadcast by Spark itself
    specs = specs.withColumn("shape", F.array_position(F.array(*[F.lit(_key(*x)) for _, x in shapes]), _key_of()) - 1 if shapes else F.lit(None).cast("bigint"))
    specs = specs.withColumn("shape", F.when(F.col("shape") >= 0, F.col("shape")).cast("int"))
    both = spread(rows.select("table_id", "row_idx", "values_text", "received_at")).join(specs, "table_id", "left")
    if len(shapes) <= SHAPES_A_PASS:
        both = _read(both, shapes)
    else:  # a pass over the tables of so many shapes each, and one for lines of no known shape
        passes = [shapes[a : a + SHAPES_A_PASS] for a in range(0, len(shapes), SHAPES_A_PASS)]
        parts = [_read(both.where(F.col("shape").between(p[0][0], p[-1][0])), p) for p in passes] + [_read(both.where("shape is null"), [])]
        both = reduce(DataFrame.unionByName, parts)
    at = F.array_position(F.transform(F.arrays_zip(F.col("again.values").alias("v"), F.col("column_specs").alias("s")), lambda x: cast_fault(x["v"], x["s"]["dtype"])), True)
    reason = (
        F.when(F.col("values_text").isNull(), "null line")
        .when(F.col("delimiter").isNull(), "unknown table")
        .when(~F.col("doubted"), F.lit(None))
        .when(F.col("broken"), "quoting")
        .when(F.col("fields") != F.size("column_specs"), "field count")
        .otherwise(F.concat(F.lit("value of column "), F.nullif(at, F.lit(0)).cast("string")))
    )
    both = both.withColumn("reason", reason).withColumn("values", F.coalesce("again.values", F.when(~F.col("doubted"), F.col("first.values"))))
    return both.withColumn("corrupt", F.when(F.col("reason").isNotNull(), F.col("values_text"))).drop("shape", "sure", "first", "again", "doubted")


def read_grids(blocks: DataFrame) -> DataFrame:
    """Grid rows but the header with ``reason`` and ``values``."""
    rows = blocks.where(F.col("grid").isNotNull()).select(F.col("block_id"), "col_types", F.try_element_at("grid", F.lit(1)).alias("header"), F.posexplode("grid").alias("row_idx", "values"), "received_at")
    rows = rows.where("row_idx > 0").withColumn("row_idx", F.col("row_idx").cast("bigint"))
    cells, kinds = F.coalesce("values", F.array().cast("array<string>")), F.coalesce("col_types", F.array().cast("array<string>"))
    torn = F.exists(cells, lambda c: c.startswith('"') & (~c.endswith('"') | (F.length(c) < 2)))
    first = F.array_position(F.transform(F.arrays_zip(cells.alias("v"), kinds.alias("k")), lambda x: cast_fault(x["v"], x["k"])), True)
    reason = (
        F.when(F.size(cells) != F.size(kinds), "cell count")
        .when(F.coalesce(torn, F.lit(False)), "quoting")
        .otherwise(F.concat(F.lit("value of column "), F.nullif(first, F.lit(0)).cast("string")))
    )
    return rows.withColumn("reason", reason).withColumn("kinds", kinds)


def _both(spark: SparkSession, folder: str) -> DataFrame:
    lines = read_lines(table(spark, folder, "table_rows"), table(spark, folder, "table_catalog"))
    grids = read_grids(table(spark, folder, "blocks"))
    return lines.select(F.lit("table_rows").alias("origin"), F.col("table_id").alias("parent_id"), "row_idx", "reason", F.coalesce("corrupt", "values_text").alias("raw")).unionByName(
        grids.select(F.lit("blocks").alias("origin"), F.col("block_id").alias("parent_id"), "row_idx", "reason", F.to_json("values").alias("raw"))
    )


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Rows with a fault."""
    return _both(spark, folder).where("reason is not null").select("origin", "parent_id", "row_idx").distinct()


def p7_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """Faulty rows with their reason and raw text."""
    return _both(spark, folder).where("reason is not null").distinct()


def p7_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """Number of faulty rows by reason."""
    kind = F.regexp_replace("reason", " of column .*", "")
    return _both(spark, folder).where("reason is not null").select("origin", "parent_id", "row_idx", kind.alias("reason")).distinct().groupBy("origin", "reason").agg(F.count(F.lit(1)).alias("n"))


def typed_rows(lines: DataFrame, grids: DataFrame) -> DataFrame:
    """Valid rows under their types: origin, parent_id, row_idx and an array of typed values."""
    lines = lines.where("reason is null")
    cells = F.transform(F.arrays_zip("values", "column_specs"), lambda x: typed(x["values"], x["column_specs"]))
    good = lines.select(F.lit("table_rows").alias("origin"), F.col("table_id").alias("parent_id"), "row_idx", "received_at", cells.alias("cells"))
    grids = grids.where("reason is null")
    spec = F.transform(F.arrays_zip(F.col("values").alias("v"), F.col("kinds").alias("k"), F.coalesce("header", F.array().cast("array<string>")).alias("h")), lambda x: F.struct(x["v"].alias("v"), F.struct(x["h"].alias("header"), x["k"].alias("dtype")).alias("s")))
    spec = F.slice(spec, F.lit(1), F.size("kinds"))
    good = good.unionByName(grids.select(F.lit("blocks").alias("origin"), F.col("block_id").alias("parent_id"), "row_idx", "received_at", F.transform(spec, lambda x: typed(x["v"], x["s"])).alias("cells")))
    last = F.max(F.struct("received_at", "cells")).alias("last")
    return good.groupBy("origin", "parent_id", "row_idx").agg(last).select("origin", "parent_id", "row_idx", "last.cells")


def p7_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Valid rows under their types, one row a cell; only the value of its type is set."""
    lines = read_lines(table(spark, folder, "table_rows"), table(spark, folder, "table_catalog"))
    rows = typed_rows(lines, read_grids(table(spark, folder, "blocks")))
    c = rows.select("origin", "parent_id", "row_idx", F.posexplode("cells").alias("col", "c"))
    plain = ("header", "dtype", "integer_value", "boolean_value", "string_value")
    return c.select(
        "origin", "parent_id", "row_idx", "col", *[f"c.{n}" for n in plain], F.col("c.decimal_value").cast("double").alias("decimal_value"),
        F.col("c.date_value").cast("string").alias("date_value"), F.date_format("c.datetime_value", "yyyy-MM-dd HH:mm:ss").alias("datetime_value"),
    )


_FAULT = """CASE WHEN {v} IS NULL OR lower(trim({v}, ' ')) IN ('', 'null', 'n/a', '-') THEN false
    WHEN {t} = 'integer' THEN NOT (regexp_matches(trim({v}, ' '), '^-?[0-9]+$') AND try_cast(trim({v}, ' ') AS BIGINT) IS NOT NULL)
    WHEN {t} = 'decimal' THEN NOT regexp_matches(trim({v}, ' '), '^-?[0-9]+([.][0-9]+)?$')
    WHEN {t} = 'boolean' THEN lower(trim({v}, ' ')) NOT IN ('true','false','t','f','yes','no','y','n','1','0')
    WHEN {t} = 'date' THEN NOT (regexp_matches(trim({v}, ' '), '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') AND try_cast(trim({v}, ' ') AS DATE) IS NOT NULL)
    WHEN {t} = 'datetime' THEN NOT (regexp_matches(trim({v}, ' '), '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[T ]([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]$') AND try_cast(substr(trim({v}, ' '), 1, 10) AS DATE) IS NOT NULL)
    ELSE false END"""
_ROWS = f"""WITH l AS (
    SELECT r.table_id, r.row_idx, r.received_at, r.values_text AS v, c.delimiter AS d, c.column_specs AS s, string_split(r.values_text, '"') AS p
    FROM table_rows r LEFT JOIN table_catalog c USING (table_id)),
  q AS (SELECT *, array_to_string(list_filter(p, lambda x, i: i % 2 = 1), '') AS o,
    string_split(array_to_string(list_transform(p, lambda x, i: CASE WHEN i % 2 = 0 THEN replace(x, d, chr(1)) ELSE x END), '"'), d) AS f,
    len(list_filter(list_transform(p, lambda x, i: i % 2 = 1 AND x <> '' AND ((i > 1 AND NOT starts_with(x, d)) OR (i < len(p) AND NOT ends_with(x, d)))), lambda b: b)) AS bad FROM l),
  t AS (SELECT *, CASE WHEN v IS NULL THEN 'null line' WHEN d IS NULL THEN 'unknown table' WHEN len(p) % 2 = 0 OR bad > 0 OR contains(o, chr(10)) OR contains(o, chr(13)) THEN 'quoting'
    WHEN len(f) <> len(s) THEN 'field count' END AS broken FROM q),
  w AS (SELECT *, CASE WHEN broken IS NOT NULL THEN [] ELSE list_transform(f, lambda x, i:
    {{'v': replace(CASE WHEN x[1] = '"' THEN replace(x[2:-2], '""', '"') ELSE x END, chr(1), d), 't': s[i].dtype, 'h': s[i].header}}) END AS c FROM t),
  g AS (SELECT block_id, unnest(range(1, len(grid))) AS r, grid, coalesce(col_types, []) AS k, received_at FROM blocks WHERE grid IS NOT NULL),
  h AS (SELECT block_id, r, coalesce(grid[r + 1], []) AS c, k, grid[1] AS names, received_at FROM g),
  judged AS (SELECT 'table_rows' AS origin, table_id AS parent_id, row_idx, v AS raw, received_at, c,
      coalesce(broken, 'value of column ' || nullif(list_position(list_transform(c, lambda x: {_FAULT.format(v="x.v", t="x.t")}), true), 0)) AS reason FROM w
    UNION ALL SELECT 'blocks', block_id, r, CAST(to_json(c) AS VARCHAR), received_at, list_transform(c, lambda x, i: {{'v': x, 't': k[i], 'h': names[i]}}),
      CASE WHEN len(c) <> len(k) THEN 'cell count' WHEN len(list_filter(c, lambda x: starts_with(x, '"') AND (NOT ends_with(x, '"') OR length(x) < 2))) > 0 THEN 'quoting'
      ELSE 'value of column ' || nullif(list_position(list_transform(c, lambda x, i: {_FAULT.format(v="x", t="k[i]")}), true), 0) END FROM h)"""
SQL = {
    "p7_found": f"{_ROWS} SELECT DISTINCT origin, parent_id, row_idx FROM judged WHERE reason IS NOT NULL",
    "p7_rejects": f"{_ROWS} SELECT DISTINCT origin, parent_id, row_idx, reason, raw FROM judged WHERE reason IS NOT NULL",
    "p7_reasons": f"{_ROWS} SELECT origin, reason, count(*) AS n FROM (SELECT DISTINCT origin, parent_id, row_idx, regexp_replace(reason, ' of column .*', '') AS reason FROM judged WHERE reason IS NOT NULL) GROUP BY 1, 2",
    "p7_rows": f"""{_ROWS}, x AS (SELECT * FROM judged WHERE reason IS NULL QUALIFY row_number() OVER (PARTITION BY origin, parent_id, row_idx ORDER BY received_at DESC) = 1),
        y AS (SELECT origin, parent_id, row_idx, unnest(c) AS u, unnest(range(0, len(c))) AS col FROM x),
        z AS (SELECT *, u.t AS dtype, u.h AS header, CASE WHEN u.v IS NULL OR lower(trim(u.v, ' ')) IN ('', 'null', 'n/a', '-') THEN NULL ELSE trim(u.v, ' ') END AS v FROM y)
      SELECT origin, parent_id, row_idx, CAST(col AS INT) AS col, header, dtype, CASE WHEN dtype = 'integer' THEN TRY_CAST(v AS BIGINT) END AS integer_value,
        CASE WHEN dtype = 'decimal' THEN CAST(TRY_CAST(v AS DECIMAL(38, 10)) AS DOUBLE) END AS decimal_value, CASE WHEN dtype = 'boolean' THEN lower(v) IN ('true', 't', 'yes', 'y', '1') END AS boolean_value,
        CASE WHEN dtype = 'date' THEN v END AS date_value, CASE WHEN dtype = 'datetime' THEN replace(v, 'T', ' ') END AS datetime_value,
        CASE WHEN dtype NOT IN ('integer', 'decimal', 'boolean', 'date', 'datetime') AND v IS NOT NULL THEN u.v END AS string_value FROM z""",
}
QUERIES = {"p7_found": p7_found, "p7_rejects": p7_rejects, "p7_reasons": p7_reasons, "p7_rows": p7_rows}
