"""Sinks: guarded object paths, idempotent and replacing writes, library export."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def object_path(root: str, key: str) -> str:
    """The place of a key under a root; a key may not climb out."""
    path = posixpath.normpath(posixpath.join(root, key))
    if key.startswith("/") or not path.startswith(root.rstrip("/") + "/"):
        raise ValueError(f"key escapes the store: {key}")
    return path


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on any Hadoop file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def delete(spark: SparkSession, path: str) -> bool:
    """Remove a path and all below it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What a store holds; one that nothing was written to is empty."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def unseen(df: DataFrame, ledger: str, key: str) -> DataFrame:
    """Rows whose key isn't in the ledger: a small table of keys, so nothing else of what is stored is read."""
    if not exists(df.sparkSession, ledger):
        return df
    return df.join(df.sparkSession.read.parquet(ledger).select(key).distinct(), key, "left_anti").select(df.columns)


def append_missing(df: DataFrame, path: str, keys: list[str], partition: list[str] | None = None) -> int:
    """Append the rows whose key isn't stored yet; returns how many. A second delivery appends nothing."""
    spark = df.sparkSession
    new = df.dropDuplicates(keys)
    if exists(spark, path):
        new = new.join(spark.read.parquet(path).select(*keys).distinct(), keys, "left_anti")
    new = new.persist()
    try:
        n = new.count()
        if n:
            writer = new.write.mode("append").option("compression", "zstd")
            (writer.partitionBy(*partition) if partition else writer).parquet(path)
        return n
    finally:
        new.unpersist()


def replace_partitions(df: DataFrame, path: str, partition: list[str]) -> None:
    """Overwrite only the partitions that ``df`` has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*partition).parquet(path)


def document_trees(leaves: DataFrame, documents: DataFrame) -> DataFrame:
    """One JSON tree a document: type, filename, title and its blocks in order."""
    block = F.struct("page_idx", "ordinal", "kind", F.col("heading_path"), F.coalesce(*[F.col(c) for c in ("text", "list_content", "latex") if c in leaves.columns]).alias("text"))
    trees = leaves.groupBy("document_id").agg(F.array_sort(F.collect_list(block)).alias("blocks"))
    d = documents.select(F.col("doc_id").alias("document_id"), "library_id", "filename", "title")
    return d.join(trees, "document_id", "left").select("library_id", "document_id", F.to_json(F.struct(F.lit("document").alias("type"), "filename", "title", F.coalesce("blocks", F.expr("cast(array() as array<struct<page_idx:int,ordinal:int,kind:string,heading_path:array<string>,text:string>>)")).alias("blocks"))).alias("tree"))


def export_library(markdown: DataFrame, documents: DataFrame, path: str) -> None:
    """Markdown of every document, a folder for each library."""
    d = documents.select(F.col("doc_id").alias("document_id"), "library_id")
    markdown.join(d, "document_id").select("library_id", F.col("markdown").alias("value")).write.mode("overwrite").partitionBy("library_id").text(path)
