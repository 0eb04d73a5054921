"""As-of and interval joins, and windows over event time, as batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, by: list[str], at: str, values: list[str]) -> DataFrame:
    """Each left row with the latest right row of its key at or before it: one union and one window, no range join."""
    cols = [*by, at]
    l = left.select("*", F.lit(1).alias("__side"), *[F.lit(None).cast(right.schema[v].dataType).alias(f"__v_{v}") for v in values], F.lit(None).cast("boolean").alias("__has"))  # noqa: E741
    extra = [c for c in left.columns if c not in cols]
    r = right.select(*cols, *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in extra], F.lit(0).alias("__side"), *[F.col(v).alias(f"__v_{v}") for v in values], F.lit(True).alias("__has"))
    w = Window.partitionBy(*by).orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = l.unionByName(r.select(l.columns))
    packed = F.last(F.when(F.col("__has"), F.struct(*[f"__v_{v}" for v in values])), ignorenulls=True).over(w)
    return both.withColumn("__m", packed).where("__side = 1").select(*left.columns, *[F.col(f"__m.__v_{v}").alias(v) for v in values])


def interval_join(points: DataFrame, spans: DataFrame, at: str, start: str, end: str, width: int) -> DataFrame:
    """Points in spans by buckets, so the join is on equality.

    Buckets double in size from ``width`` on: a span goes to the two or three it touches
    at the size next to its length, however long it is, and a point to its own of every
    size that spans have. The sizes are powers of two, so few; they are all that is
    collected. Defined cases: a span that ends before it begins, or has a null or
    infinite end, holds nothing, as does a null or infinite point.
    """
    finite = lambda c: F.col(c).isNotNull() & (F.abs(F.col(c).cast("double")) < float("inf"))
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest((F.col(end) - F.col(start)).cast("double"), F.lit(1e-9)) / width))).cast("int")
    s = spans.where(finite(start) & finite(end) & (F.col(start) <= F.col(end))).withColumn("__l", level)
    levels = sorted(r[0] for r in s.select("__l").distinct().collect())  # at most as many as a double has binary exponents
    size = F.lit(float(width)) * F.pow(F.lit(2.0), F.col("__l"))
    s = s.withColumn("__b", F.explode(F.sequence(F.floor(F.col(start) / size), F.floor(F.col(end) / size))))
    p = points.where(finite(at)).withColumn("__l", F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>"))).withColumn("__b", F.floor(F.col(at) / size))
    return p.join(s, ["__l", "__b"]).where((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))).drop("__l", "__b")
