"""Ranking: cosine order, trigram similarity, reciprocal rank fusion, pending sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ordering import global_rank

#: The fusion's constant and the trigram of a word's padding.
RRF_K = 60


def dot(a: Column, b: Column) -> Column:
    """Inner product in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where either has no length."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n)


def dense_order(vectors: DataFrame, query: list[float], key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """All ids by similarity to one query vector, which travels as a literal of the plan."""
    q = F.array(*[F.lit(float(x)) for x in query])
    v = vectors.where(F.col(column).isNotNull()).withColumn("similarity", cosine(F.col(column), q))
    return global_rank(v.select(key, "similarity"), [F.desc_nulls_last("similarity"), F.asc(key)])


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the text's words, each padded with two blanks before and one after."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    grams = F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))))
    return F.array_distinct(grams)


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams."""
    x, y = trigrams(a), trigrams(b)
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(0.0)


def trigram_index(texts: DataFrame, key: str, text: str) -> DataFrame:
    """The inverted table: trigram and id."""
    return texts.select(key, F.explode(trigrams(F.col(text))).alias("gram"))


def sparse_top(index: DataFrame, sizes: DataFrame, query: str, key: str, k: int) -> DataFrame:
    """The ``k`` ids most similar to a query string, read off the inverted table: only texts that share a trigram are looked at.

    ``sizes``: id and ``n``, its number of trigrams. Fewer than ``k`` come out where fewer share any.
    """
    asked = index.sparkSession.range(1).select(trigrams(F.lit(query)).alias("g")).first()["g"]
    shared = index.where(F.col("gram").isin(asked)).groupBy(key).agg(F.count(F.lit(1)).alias("shared"))
    scored = shared.join(sizes, key).select(key, (F.col("shared") / (F.col("n") + len(asked) - F.col("shared"))).alias("similarity"))
    return scored.orderBy(F.desc("similarity"), key).limit(k)


def sparse_order(texts: DataFrame, query: str, key: str, text: str) -> DataFrame:
    """All ids by trigram similarity to a query string."""
    t = texts.withColumn("similarity", trigram_similarity(F.col(text), F.lit(query)))
    return global_rank(t.select(key, "similarity"), [F.desc("similarity"), F.asc(key)])


def fuse(rankings: list[DataFrame], key: str) -> DataFrame:
    """Reciprocal rank fusion of rankings (key, place from 1); equals keep the first ranking's order."""
    parts = [r.select(key, F.lit(i).alias("source"), "place", (1.0 / (RRF_K + F.col("place"))).alias("score")) for i, r in enumerate(rankings)]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    fused = both.groupBy(key).agg(F.sum("score").alias("score"), F.min(F.struct("source", "place")).alias("seen"))
    return global_rank(fused, [F.desc("score"), F.asc("seen"), F.asc(key)]).select(key, "score", "place")


def pending(nodes: DataFrame, embedded: DataFrame, key: str = "content_id") -> DataFrame:
    """Nodes with a search text and no embedding."""
    return nodes.where(F.col("search_text").isNotNull()).join(embedded.select(key), key, "left_anti")
