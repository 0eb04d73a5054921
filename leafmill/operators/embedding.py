"""Embedding a library: pending nodes, token limits, a deterministic embedder, an approximate index, passages with their source."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ranking

DIMENSIONS, TOKENS = 64, 8192


def truncate(text: Column, tokens: int = TOKENS) -> Column:
    """A text's leading tokens, as its words; only what an embedder's limit asks for."""
    parts = F.regexp_extract_all(text, F.lit(r"\s*([\p{L}\p{N}]+|[^\s\p{L}\p{N}])"), 0)
    return F.when(F.size(parts) > tokens, F.array_join(F.slice(parts, 1, tokens), "")).otherwise(text)


def hashed_vector(text: str) -> np.ndarray:
    """The default embedder: signed hashing of words and character trigrams, scaled to length one."""
    v = np.zeros(DIMENSIONS, np.float32)
    for w in re.findall(r"[^\W_]+", text.lower()):
        for g in (w, *(w[i : i + 3] for i in range(len(w) - 2))):
            h = zlib.crc32(g.encode())
            v[h % DIMENSIONS] += 1.0 if h >> 16 & 1 else -1.0
    n = np.linalg.norm(v)
    return v / n if n else v


def embed(nodes: DataFrame, embedded: DataFrame | None = None, embedder: Callable[[str], np.ndarray] = hashed_vector, tokens: int = TOKENS) -> DataFrame:
    """content_id and embedding of every node that waits for one, in Arrow batches."""
    todo = nodes.where("search_text is not null") if embedded is None else ranking.pending(nodes, embedded)

    def run(frames):
        for f in frames:
            yield pd.DataFrame({"content_id": f["content_id"], "embedding": [embedder(t) for t in f["text"]]})

    return todo.select("content_id", truncate(F.col("search_text"), tokens).alias("text")).mapInPandas(run, "content_id bigint, embedding array<float>")


def near_index(vectors: DataFrame, key: str = "content_id", column: str = "embedding", width: float = 0.5, tables: int = 4):
    """Random-projection buckets over unit vectors: a fitted model and the hashed vectors."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    n = F.sqrt(ranking.dot(F.col(column), F.col(column)))
    unit = vectors.withColumn("n", n).where("n > 0").select(key, array_to_vector(F.transform(column, lambda x: x.cast("double") / F.col("n"))).alias("v"))
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="hashes", bucketLength=width, numHashTables=tables, seed=7).fit(unit)
    return model, model.transform(unit)


def passages(texts: DataFrame, documents: DataFrame) -> DataFrame:
    """Block texts under ``[file pN]``."""
    d = documents.select(F.col("doc_id").alias("document_id"), F.coalesce("filename", F.lit("?")).alias("file"))
    label = F.concat(F.lit("["), "file", F.when(F.col("page_no").isNotNull(), F.concat(F.lit(" p"), F.col("page_no").cast("string"))).otherwise(F.lit("")), F.lit("] "))
    return texts.join(d, "document_id").select("content_id", F.concat(label, F.coalesce("text", F.lit(""))).alias("passage"))


def table_passage(label: Column, n_rows: Column, headers: Column, samples: Column) -> Column:
    """A table as a passage: how many rows, the header, some samples."""
    shown = F.slice(samples, 1, 3)
    return F.concat(F.lit("["), label, F.lit("] table with "), n_rows.cast("string"), F.lit(" rows, "), F.size(shown).cast("string"), F.lit(" shown\n"), F.array_join(headers, " | "), F.lit("\n"), F.array_join(F.transform(shown, lambda r: F.array_join(r, " | ")), "\n"))
