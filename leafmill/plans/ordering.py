"""Global ranks without a single task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def global_rank(df: DataFrame, order: list[Column | str], name: str = "place") -> DataFrame:
    """Number all rows from 1 in ``order``, which must be total.

    Rows are range-partitioned and sorted within partitions, written once, and
    numbered by their place in the partition plus the sizes of those before it: one
    row a partition is all that is gathered.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    rows = rows.withColumn("__part", F.shiftright("__at", 33)).withColumn("__at", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).alias("__before"))
    # one row a partition: never more than the shuffle's partitions
    return rows.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__at") + 1).drop("__part", "__at", "__before")


def numbered(df: DataFrame, by: list[str], order: list[str], count: str = "n", number: str = "rn", sums: dict[str, str] | None = None) -> DataFrame:
    """Every row's number from 0 within its group, the group's rows, and sums over the group.

    One group may be most of the rows: rows are ranked over all groups by range
    partitions, and a group's first rank is taken off; only one row a group is aggregated.
    """
    ranked = global_rank(df, [*by, *order], "__rank")
    groups = ranked.groupBy(*by).agg(F.min("__rank").alias("__first"), F.count(F.lit(1)).alias(count), *[F.sum(c).alias(name) for name, c in (sums or {}).items()])
    keys = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]
    both = ranked.alias("a").join(groups.alias("b"), keys)
    made = [count, *(sums or {})]
    return both.select(*[F.col(f"a.{c}") for c in df.columns], (F.col("a.__rank") - F.col("b.__first")).alias(number), *[F.col(f"b.{c}") for c in made])
