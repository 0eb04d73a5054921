"""From a question to evidence: which documents, which sections and tables, which blocks.

Relevance is judged by callables. The defaults compare words, so they are
reproducible; a model can take their place.
"""

from __future__ import annotations

import re
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import ranking, reduce
from .answer import TableInfo

STOP = set("a an and are as at be by did do does for from has have how in is it its many much of on or than that the their there this to was were what when where which who whose why with".split())


class QueryPlanner(Protocol):
    """Writes queries for a question over described tables."""

    def __call__(self, question: str, tables: list[TableInfo]) -> list[str]: ...


def words(text: str) -> set[str]:
    """Content words, singular where a plain s ends them."""
    return {w[:-1] if len(w) > 3 and w.endswith("s") else w for w in re.findall(r"[^\W_]+", text.lower())} - STOP


def relevant(rows: DataFrame, question: str, text: str, least: int = 1) -> DataFrame:
    """Rows that share a word with the question, with how many."""
    wanted = F.array(*[F.lit(w) for w in sorted(words(question)) or ["\0"]])
    have = F.array_distinct(F.transform(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: F.when((F.length(w) > 3) & w.endswith("s"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)))
    return rows.withColumn("shared", F.size(F.array_intersect(have, wanted))).where(F.col("shared") >= least)


def gate(rows: DataFrame, tokens: str, budget: int = reduce.GATE) -> bool:
    """Whether what was chosen fits the budget."""
    total = rows.agg(F.coalesce(F.sum(tokens), F.lit(0)).alias("t")).first()["t"]
    return total <= budget


def ranked_blocks(nodes: DataFrame, question: str, scope: DataFrame | None = None, vectors: DataFrame | None = None, query_vector: list[float] | None = None) -> DataFrame:
    """Blocks of the scope in fused order of trigram and, where there are vectors, cosine similarity."""
    if scope is not None:
        nodes = nodes.join(scope, [c for c in scope.columns if c in nodes.columns], "left_semi")
    orders = [ranking.sparse_order(nodes.where("search_text is not null"), question, "content_id", "search_text")]
    if vectors is not None and query_vector is not None:
        near = vectors.join(nodes.select("content_id"), "content_id", "left_semi")
        orders.insert(0, ranking.dense_order(near, query_vector, "content_id"))
    return ranking.fuse(orders, "content_id")


def cite(filename: Column, page: Column) -> Column:
    """A source label."""
    return F.concat(F.lit("["), filename, F.when(page.isNotNull(), F.concat(F.lit(" p"), page.cast("string"))).otherwise(F.lit("")), F.lit("]"))


def plan_queries(question: str, tables: list[TableInfo]) -> list[str]:
    """The default planner: the aggregate the question names, over the column and table whose names it shares words with."""
    asked, low = words(question), question.lower()
    how = next((f for p, f in ((r"how many|number of|count", "COUNT"), (r"average|mean", "AVG"), (r"total|sum", "SUM"), (r"highest|largest|most|maximum|max\b|top", "MAX"), (r"lowest|smallest|least|minimum|min\b", "MIN")) if re.search(p, low)), None)
    out = []
    scored = sorted(((len(asked & (words(t.label) | {w for h in t.headers for w in words(h)})), -i, t) for i, t in enumerate(tables)), key=lambda x: (-x[0], -x[1]))
    for score, minus, t in scored[:3]:
        if score == 0:
            continue
        i = -minus
        best = max(range(len(t.headers)), key=lambda j: (len(asked & words(t.headers[j])), t.columns[j][0] in ("integer", "decimal", "float")), default=None)
        group = re.search(r"\b(?:by|per|each|for every)\s+([\w ]+)", low)
        by = next((j for j, h in enumerate(t.headers) if group and words(group.group(1)) & words(h)), None)
        numeric = [j for j in range(len(t.headers)) if t.columns[j][0] in ("integer", "decimal", "float") and asked & words(t.headers[j]) and j != by]
        value = "COUNT(*)" if how == "COUNT" or how is None else f"{how}(c{(numeric or [best])[0]})"
        out.append(f"SELECT c{by} AS grp, {value} AS value FROM t{i} GROUP BY c{by}" if by is not None else f"SELECT {value} AS value FROM t{i}")
    return out
