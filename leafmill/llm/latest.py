"""Rows loaded more than once: the latest load counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, key: str, when: str, tie: list[Column], values: dict[str, Column]) -> DataFrame:
    """One row per ``key``: ``values`` of the row with the greatest ``when``, ties broken by ``tie``.

    An aggregation with a map-side part (a sort aggregation, as structs with strings
    don't hash in place), so a key loaded very often moves one row a partition; texts that the caller doesn't need are made null in ``values``
    before they are shuffled.
    """
    best = F.max(F.struct(F.col(when).alias("__when"), *[t.alias(f"__t{i}") for i, t in enumerate(tie)], *[v.alias(k) for k, v in values.items()])).alias("__best")
    return df.groupBy(key).agg(best).select(key, *[F.col(f"__best.{k}").alias(k) for k in values])
