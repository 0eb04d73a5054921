"""Column types inferred from cells, and typed views over positional rows of strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spellings of null in temporal columns (fixed values).
SENTINELS = ["", "-", "--", "—", "n/a", "na", "none", "null", "nan", "nat", "?", "tbd"]
TRUE, FALSE = ["true", "t", "yes", "y", "1"], ["false", "f", "no", "n", "0"]
_INT, _DEC = r"^-?[0-9]+$", r"^-?[0-9]+\.[0-9]+$"
_SCI = r"^-?[0-9]+(\.[0-9]+)?[eE][-+]?[0-9]+$"
_DAY = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"
_STAMP = _DAY + r"([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?)?$"


def is_integer(v: Column) -> Column:
    """Digits that print back as they are, within 64 bits: ``007``, ``-0`` and ``+1`` aren't."""
    return v.rlike(_INT) & F.when(v.isNotNull(), v.try_cast("bigint").cast("string").eqNullSafe(v))


def is_decimal(v: Column) -> Column:
    """Plain digits with a point, no needless leading zero."""
    return v.rlike(r"^-?(0|[1-9][0-9]*)\.[0-9]+$")


def is_stamp(v: Column) -> Column:
    """An ISO date or timestamp that exists."""
    return v.rlike(_STAMP) & F.replace(v, F.lit("T"), F.lit(" ")).try_cast("timestamp_ntz").isNotNull()


def infer(cells: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """One dtype for each column named by ``by``: one pass of conditional counts, combined map-side.

    The ladder: no values, integer, decimal, float, boolean, date, datetime, string. An
    empty cell is no value.
    """
    v = F.when(F.col(value) != "", F.col(value))
    whole, plain, sci = is_integer(v), is_decimal(v), v.rlike(_SCI)
    flags = cells.groupBy(*by).agg(
        F.count(v).alias("n"), F.bool_and(whole).alias("whole"), F.bool_and(whole | plain).alias("plain"), F.bool_and(whole | plain | sci).alias("number"),
        F.bool_and(v.isin("True", "False")).alias("truth"), F.bool_and(is_stamp(v)).alias("stamp"), F.bool_and(v.rlike(_DAY + "$") | v.rlike(_DAY + r"[T ]00:00(:00(\.0+)?)?$")).alias("midnight"),
        F.max(F.when(plain, F.length(F.substring_index(v, ".", -1)))).alias("scale"),
    )
    kind = (
        F.when(F.col("n") == 0, "string").when(F.col("whole"), "integer").when(F.col("plain"), "decimal").when(F.col("number"), "float")
        .when(F.col("truth"), "boolean").when(F.col("stamp") & F.col("midnight"), "date").when(F.col("stamp"), "datetime").otherwise("string")
    )
    return flags.select(*by, kind.alias("dtype"), F.coalesce("scale", F.lit(0)).alias("scale"))


def typed(v: Column, dtype: str, scale: int = 10) -> Column:
    """A string cell under its type; what doesn't fit is null, never an error."""
    absent = F.lower(F.trim(v)).isin(SENTINELS)
    if dtype == "integer":
        return F.when(F.trim(v).rlike(r"^[-+]?[0-9]+$"), F.trim(v).try_cast("bigint"))
    if dtype == "decimal":
        return F.when(F.trim(v).rlike(r"^[-+]?[0-9]+(\.[0-9]+)?$"), F.trim(v).try_cast(f"decimal(38,{min(scale, 18)})"))
    if dtype == "float":
        return F.when(F.trim(v).rlike(r"^[-+]?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?$"), F.trim(v).try_cast("double"))
    if dtype == "boolean":
        return F.when(F.lower(F.trim(v)).isin(TRUE), True).when(F.lower(F.trim(v)).isin(FALSE), False)
    if dtype == "date":
        return F.when(~absent, F.substring(F.trim(v), 1, 10).try_cast("date"))
    if dtype == "datetime":
        return F.when(~absent, F.replace(F.trim(v), F.lit("T"), F.lit(" ")).try_cast("timestamp_ntz"))
    return v


def typed_view(rows: DataFrame, columns: list[tuple[str, int]], header_rows: tuple[int, ...] = (0,), values: str = "values") -> DataFrame:
    """``c0..cN`` of one table's rows under their types, header rows left out."""
    body = rows.where(~F.col("row_idx").isin(*header_rows)) if header_rows else rows
    return body.select("row_idx", *[typed(F.get(F.col(values), i), kind, scale).alias(f"c{i}") for i, (kind, scale) in enumerate(columns)])


def as_rows(df: DataFrame, order: list[str]) -> DataFrame:
    """A typed table as the canonical row store holds it: positional strings, row 0 being the header."""
    body = df.select(F.array(*[F.coalesce(df[c].cast("string"), F.lit("")) for c in df.columns]).alias("values"), F.xxhash64(*order).alias("k"), *[F.col(c).alias(f"o_{c}") for c in order])
    # ids only need to be unique and above the header's
    body = body.select((F.monotonically_increasing_id() + 1).alias("row_idx"), "values")
    head = df.sparkSession.createDataFrame([(0, df.columns)], "row_idx bigint, values array<string>")
    return head.unionByName(body)


def table_columns(rows: DataFrame) -> list[tuple[str, int]]:
    """Inferred type of each column of a positional table: one row a column reaches the driver."""
    cells = rows.where("row_idx > 0").select(F.posexplode("values").alias("col", "value"))
    found = {r["col"]: (r["dtype"], r["scale"]) for r in infer(cells, ["col"]).collect()}
    wide = rows.agg(F.max(F.size("values")).alias("n")).first()["n"] or 0  # a table without rows has its header's columns
    return [found.get(i, ("string", 0)) for i in range(wide)]
