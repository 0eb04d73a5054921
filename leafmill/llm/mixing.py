"""Problem 9: sources mixed to target shares of a token budget, by pivotal rounding.

Each source's copy rate is its share of the budget over its own tokens, held at
``max_repeats``. The whole part of the rate is given to every document; the
fraction is rounded by pivots: two documents trade token mass at random until
one of them is whole, so the source's token total stays what it was and every
document keeps its expected number of copies. Pivoting runs inside buckets of
documents, and what each bucket leaves fractional (one document per source) is
paired off in a reduction tree of buckets.

Defined cases: documents of sources without a target, of null source, or with
no tokens (null and empty texts) get no copies; a source in the targets but not
in the documents, or with too few tokens, is reported with the share it reaches;
repeated rows of one id are documents of their own, told apart by their number
within the id; random numbers come from ids and a seed, so a task run again
decides alike.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut
from ..plans.ordering import numbered
from ..session import table
from .encoding import TOKENIZER, token_counts

#: Documents a bucket holds on average, and buckets that meet in one node of the tree.
BUCKET_ROWS, FAN_IN = 50_000, 64
_STATE = "source string, doc_id bigint, part int, tokens bigint, share double, whole int, draw double, node bigint, decided boolean"


def rates(counts: DataFrame, targets: DataFrame, budget: int | None = None) -> DataFrame:
    """One row per target: available tokens, the copy rate that gives its share, held at its cap.

    ``budget`` is the total size wanted; unset, all tokens of sources that have a target.
    """
    have = counts.groupBy("source").agg(F.sum("tokens").alias("available_tokens"), F.count(F.lit(1)).alias("available_docs"))
    want = targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    both = want.join(have, "source", "left").fillna({"available_tokens": 0, "available_docs": 0})
    total = F.lit(budget).cast("double") if budget else F.sum("available_tokens").over(Window.partitionBy()).cast("double")
    rate = F.when(F.col("available_tokens") > 0, F.col("target_share") * F.col("budget_tokens") / F.col("available_tokens")).otherwise(0.0)
    return both.withColumn("budget_tokens", total).withColumn("rate", F.least(rate, F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).cast("double")))


def _pivot(group: pd.DataFrame) -> pd.DataFrame:
    """Round all but one document of each source, large ones first, so that what stays fractional is small."""
    group = group.assign(less=-group["tokens"]).sort_values(["source", "less", "draw", "doc_id", "part"], kind="stable").drop(columns="less")
    share, mass, draw = group["share"].to_numpy(float).copy(), group["tokens"].to_numpy(float), group["draw"].to_numpy(float)
    source, decided = group["source"].to_numpy(), np.ones(len(group), bool)
    held = -1
    for i in range(len(group)):
        if held >= 0 and source[held] != source[i]:
            decided[held], held = False, -1
        if share[i] <= 0.0 or share[i] >= 1.0:
            continue
        if held < 0:
            held = i
            continue
        up = min((1.0 - share[held]) * mass[held], share[i] * mass[i])
        down = min(share[held] * mass[held], (1.0 - share[i]) * mass[i])
        move = up if (draw[i] * 7919.0 + draw[held]) % 1.0 * (up + down) < down else -down
        a, b = share[held] + move / mass[held], share[i] - move / mass[i]
        a, b = (round(x) if abs(x - round(x)) < 1e-9 else x for x in (a, b))
        share[held], share[i] = a, b
        if 0.0 < a < 1.0:
            continue
        held = i if 0.0 < b < 1.0 else -1
    if held >= 0:
        decided[held] = False
    return group.assign(share=share, decided=decided)


def mix(counts: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 7) -> DataFrame:
    """``doc_id source part tokens copies`` of every document that is used; ``part`` numbers rows of one id."""
    plan = rates(counts, targets, budget)
    # the targets are one row a source: far below any broadcast limit, and Spark checks it
    rows = counts.join(plan.select("source", "rate"), "source").where("tokens > 0 and rate > 0")
    rows = rows.select(
        "source", "doc_id", "part", "tokens",
        (F.col("rate") - F.floor("rate")).alias("share"), F.floor("rate").cast("int").alias("whole"),
        (F.pmod(F.xxhash64("doc_id", "part", F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))).alias("draw"),
    )
    buckets = max(1, -(-counts.count() // BUCKET_ROWS))
    # a source may be most of the rows: buckets cut across sources, by id
    state = rows.withColumn("node", F.pmod(F.xxhash64("doc_id", "part"), F.lit(buckets))).withColumn("decided", F.lit(False))
    state = cut(state.groupBy("node").applyInPandas(_pivot, _STATE))
    done, left = [state.where("decided")], state.where("not decided")
    while buckets > 1:
        buckets = -(-buckets // FAN_IN)
        left = cut(left.withColumn("node", F.floor(F.col("node") / FAN_IN)).groupBy("node").applyInPandas(_pivot, _STATE))
        done.append(left.where("decided"))
        left = left.where("not decided")
    done.append(left.withColumn("share", F.when(F.col("draw") < F.col("share"), 1.0).otherwise(0.0)))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    out = out.withColumn("copies", F.col("whole") + F.col("share").cast("int"))
    return out.where("copies > 0").select("doc_id", "source", "part", "tokens", "copies")


def shares(mixed: DataFrame, plan: DataFrame) -> DataFrame:
    """For each source of the targets: the share it was to have and the share it has."""
    used = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("used_tokens"), F.max("copies").alias("most_copies"), F.count(F.lit(1)).alias("used_docs"))
    both = plan.join(used, "source", "left").fillna({"used_tokens": 0, "most_copies": 0, "used_docs": 0})
    everything = F.sum("used_tokens").over(Window.partitionBy())
    short = (F.col("rate") * F.col("available_tokens") < F.col("target_share") * F.col("budget_tokens") - 0.5).alias("capped")
    return both.select(
        "source", "target_share", "max_repeats", "available_docs", "available_tokens", "used_docs", "used_tokens", "most_copies",
        (F.col("used_tokens") / F.col("budget_tokens")).alias("share_of_budget"), (F.col("used_tokens") / everything).alias("actual_share"), short,
    )


def document_tokens(spark: SparkSession, folder: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """Token counts of all documents, written once, rows of one id numbered."""
    targets, docs = table(spark, folder, "source_targets"), table(spark, folder, "documents")
    wanted = docs.join(F.broadcast(targets.select("source").distinct()), "source", "left_semi")  # one row a source
    counted = cut(token_counts(wanted, ["doc_id", "source"], tokenizer=tokenizer))
    # ids are unique but for repeated and null ones, and those may be very many: only they are numbered, by ranges
    many = counted.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("id"))
    again = F.col("doc_id").eqNullSafe(F.col("id"))
    once = counted.join(many, again, "left_anti").withColumn("part", F.lit(0))
    repeated = numbered(counted.join(many, again, "left_semi"), ["doc_id"], ["source", "tokens"], number="part").drop("n")
    return cut(once.unionByName(repeated.withColumn("part", F.col("part").cast("int"))))


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The documents used and how often each."""
    return mix(document_tokens(spark, folder), table(spark, folder, "source_targets"))


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual share of every source."""
    counts, targets = document_tokens(spark, folder), table(spark, folder, "source_targets")
    return shares(mix(counts, targets), rates(counts, targets))


QUERIES = {"p9_mix": p9_mix, "p9_shares": p9_shares}
