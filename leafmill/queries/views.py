"""Typed views over the canonical row store, and the question path on top of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dtypes
from ..plans import answer
from ..session import table


def _store(spark: SparkSession, folder: str, name: str) -> DataFrame:
    df = table(spark, folder, name)
    return dtypes.as_rows(df, [df.columns[0]])


def flagship_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Spend per customer segment: stringified rows, inferred types, views t0 and t1, SQL."""
    answer.register(spark, [_store(spark, folder, "customer"), _store(spark, folder, "orders")])
    return answer.run(spark, "SELECT t0.c4 AS segment, COUNT(*) AS n_orders, CAST(ROUND(SUM(CAST(t1.c3 AS DECIMAL(18,2))), 2) AS DOUBLE PRECISION) AS total FROM t0 JOIN t1 ON t0.c0 = t1.c1 GROUP BY t0.c4")


def typed_view_orders(spark: SparkSession, folder: str) -> DataFrame:
    """All orders read back through the row store."""
    rows = _store(spark, folder, "orders")
    v = dtypes.typed_view(rows, dtypes.table_columns(rows))
    return v.select(F.col("c0").alias("o_orderkey"), F.col("c1").alias("o_custkey"), F.col("c2").alias("o_orderstatus"), F.col("c3").cast("double").alias("o_totalprice"), F.col("c4").cast("timestamp_ntz").alias("o_orderdate"), F.col("c5").alias("o_orderpriority"))


def typed_view_sentinels(spark: SparkSession, folder: str) -> DataFrame:
    """Label spellings as dates with null sentinels, integers and booleans: nothing raises."""
    d = table(spark, folder, "documents").select("doc_id", F.coalesce("lang", F.lit("NULL")).alias("v"))
    kept = F.when(F.lower(F.trim("v")).isin(dtypes.SENTINELS), None).otherwise(F.col("v"))
    return d.select("doc_id", kept.alias("kept"), dtypes.typed(F.col("v"), "integer").alias("i"), dtypes.typed(F.col("v"), "date").alias("d"))


_CELL = "coalesce(CAST({c} AS VARCHAR), '')"
SQL = {
    "flagship_segments": "SELECT c_mktsegment AS segment, count(*) AS n_orders, CAST(round(sum(CAST(o_totalprice AS DECIMAL(18,2))), 2) AS DOUBLE) AS total FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1",
    "typed_view_orders": "SELECT * FROM orders",
    "typed_view_sentinels": """SELECT doc_id, CASE WHEN lower(trim(v)) IN ('', '-', '--', '—', 'n/a', 'na', 'none', 'null', 'nan', 'nat', '?', 'tbd') THEN NULL ELSE v END AS kept,
        CASE WHEN regexp_matches(trim(v), '^[-+]?[0-9]+$') THEN try_cast(trim(v) AS BIGINT) END AS i, CASE WHEN lower(trim(v)) IN ('', '-', 'n/a', 'null') THEN NULL ELSE try_cast(substr(trim(v), 1, 10) AS DATE) END AS d
        FROM (SELECT doc_id, coalesce(lang, 'NULL') AS v FROM documents)""",
}
QUERIES = {n: globals()[n] for n in SQL}
