import pytest
from pyspark.sql import functions as F

from leafmill.sources import rejects as R

CATALOG = [(1, ",", [("a", "integer"), ("b", "string"), ("c", "date")]), (2, "|", [("a", "boolean"), ("a", "datetime")]), (3, ";", [("only", "decimal")])]
CASES = [
    (1, "1,x,2024-02-29", None), (1, '" 7 ","a ""b"", c\nd",2024-01-01', None), (1, "n/a,,-", None), (1, None, "null line"), (1, "1,x", "field count"), (1, "1,x,2024-01-01,", "field count"),
    (1, '1,"x,2024-01-01', "quoting"), (1, '1,x"y,2024-01-01', "quoting"), (1, '1,"x" ,2024-01-01', "quoting"), (1, "1,x\ny,2024-01-01", "quoting"), (1, "1,x,2023-02-29", "value of column 3"),
    (1, "9223372036854775808,x,", "value of column 1"), (1, "-9223372036854775808,x,", None), (1, "1.0,x,", "value of column 1"), (1, '"",x,', None), (1, '1,"",""', None), (1, '1,"a"",2024-01-01', "quoting"),
    (2, "Yes|2024-01-01T23:59:59", None), (2, "1|2024-01-01 24:00:00", "value of column 2"), (2, "maybe|", "value of column 1"), (2, '"a|b"|', "value of column 1"), (3, "", None), (3, "-1.", "value of column 1"), (3, "00.50", None), (9, "x", "unknown table"),
    (1, "1," + "x" * 200_000 + ",2024-01-01", None), (1, "1," + '"' + '""' * 20_000 + '"' + ",2024-01-01", None), (1, "," * 5000, "field count"),
]


@pytest.fixture(scope="module")
def catalog(spark):
    return spark.createDataFrame(CATALOG, "table_id bigint, delimiter string, column_specs array<struct<header:string,dtype:string>>")


def test_reasons(spark, catalog):
    rows = spark.createDataFrame([(t, i, v) for i, (t, v, _) in enumerate(CASES)], "table_id bigint, row_idx bigint, values_text string").withColumn("received_at", F.current_timestamp())
    got = {r["row_idx"]: r["reason"] for r in R.read_lines(rows, catalog).select("row_idx", "reason").collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(CASES)}


def test_values(spark, catalog):
    rows = spark.createDataFrame([(1, 0, CASES[1][1])], "table_id bigint, row_idx bigint, values_text string").withColumn("received_at", F.current_timestamp())
    assert R.read_lines(rows, catalog).first()["values"] == [" 7 ", 'a "b", c\nd', "2024-01-01"]


def test_grids(spark):
    grid = [["h", "i"], ["1", "x"], ["1"], ['"torn', "x"], ["x", None], ['"', "y"], [None, '"ok"']]
    b = spark.createDataFrame([(5, grid, ["integer", "string"], None), (6, None, ["integer"], None), (7, [], None, None)], "block_id bigint, grid array<array<string>>, col_types array<string>, received_at timestamp")
    got = {r["row_idx"]: r["reason"] for r in R.read_grids(b).collect()}
    assert got == {1: None, 2: "cell count", 3: "quoting", 4: "value of column 1", 5: "quoting", 6: None}


def test_empty(spark, catalog):
    rows = spark.createDataFrame([], "table_id bigint, row_idx bigint, values_text string, received_at timestamp")
    assert R.read_lines(rows, catalog).count() == 0
    assert R.read_lines(rows, catalog.limit(0)).count() == 0


def test_wide_table(spark):
    """More columns than any fixed buffer, all of them read and checked."""
    wide = spark.createDataFrame([(1, ",", [(f"c{i}", "integer") for i in range(1100)])], "table_id bigint, delimiter string, column_specs array<struct<header:string,dtype:string>>")
    lines = [",".join(["x"] * 1100), ",".join(["7"] * 1100), ",".join(["7"] * 1099), ",".join(["7"] * 1099 + ["+7"]), ",".join(['"7"'] * 1100)]
    rows = spark.createDataFrame([(1, i, v, None) for i, v in enumerate(lines)], "table_id bigint, row_idx bigint, values_text string, received_at timestamp")
    got = {r["row_idx"]: r for r in R.read_lines(rows, wide).select("row_idx", "reason", "values").collect()}
    assert [got[i]["reason"] for i in range(5)] == ["value of column 1", None, "field count", "value of column 1100", None]
    assert got[1]["values"] == got[4]["values"] == ["7"] * 1100


def test_many_shapes(spark, monkeypatch):
    """More shapes than a plan holds are read in passes, and no line is lost."""
    monkeypatch.setattr(R, "SHAPES_A_PASS", 2)
    catalog = spark.createDataFrame([(i, ",", [("c", k)] * n) for i, (k, n) in enumerate([("integer", 1), ("integer", 2), ("date", 1), ("string", 3), ("boolean", 2)])], "table_id bigint, delimiter string, column_specs array<struct<header:string,dtype:string>>")
    rows = spark.createDataFrame([(0, "1"), (1, "1,x"), (2, "2024-02-30"), (3, "a,b,c"), (4, "y,n"), (9, "?"), (0, None)], "table_id bigint, values_text string").withColumn("row_idx", F.lit(0)).withColumn("received_at", F.lit(None).cast("timestamp"))
    got = {(r["table_id"], r["values_text"]): r["reason"] for r in R.read_lines(rows, catalog).select("table_id", "values_text", "reason").collect()}
    assert got == {(0, "1"): None, (1, "1,x"): "value of column 2", (2, "2024-02-30"): "value of column 1", (3, "a,b,c"): None, (4, "y,n"): None, (9, "?"): "unknown table", (0, None): "null line"}


def test_corrupt_record_decides(spark, catalog):
    """A line that the typed reader takes isn't read again; one it calls corrupt is, and may be valid."""
    rows = spark.createDataFrame([(2, 0, "true|2024-01-01T10:00:00"), (2, 1, "yes|n/a"), (2, 2, "yes|never")], "table_id bigint, row_idx bigint, values_text string").withColumn("received_at", F.current_timestamp())
    got = {r["row_idx"]: (r["reason"], r["values"], r["corrupt"]) for r in R.read_lines(rows, catalog).collect()}
    assert got == {0: (None, ["true", "2024-01-01 10:00:00"], None), 1: (None, ["yes", "n/a"], None), 2: ("value of column 2", ["yes", "never"], "yes|never")}


def test_clashing_columns(spark, catalog):
    """Columns of the operator's own names in the tables are left alone."""
    rows = spark.createDataFrame([(1, 0, "1,x,", None, "s", 5, "b", "f")], "table_id bigint, row_idx bigint, values_text string, received_at timestamp, shape string, kinds int, broken string, first string")
    clash = catalog.withColumn("shape", F.lit("x")).withColumn("row_idx", F.lit(3)).withColumn("kinds", F.lit(1))
    assert [r["reason"] for r in R.read_lines(rows, clash).collect()] == [None]
