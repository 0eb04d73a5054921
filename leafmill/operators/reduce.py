"""Budgets and reduction: token counts, greedy packing, summaries, inventories, fitting, sinks' keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Budgets in tokens (fixed values).
BATCH_TOKENS, SUMMARY_SHARE, SUMMARY_MOST, GATE = 26_112, 0.1, 2048, 22_528


def word_count(text: Column) -> Column:
    """The default token counter: runs of letters and digits, and single other signs."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]")), F.lit(0))


def greedy_pack(items: DataFrame, by: list[str], order: list[str], tokens: str, budget: int) -> DataFrame:
    """Sequential bins: an item that would exceed the budget opens the next; none is split.

    The fold runs over a group's token counts in order, as an expression; what is
    collected of a group is one small struct an item.
    """
    item = F.struct(*[F.col(c) for c in order], F.coalesce(F.col(tokens), F.lit(0)).cast("bigint").alias("__t"))
    grouped = items.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("__items"))
    start = F.struct(F.lit(0).cast("bigint").alias("bin"), F.lit(0).cast("bigint").alias("used"), F.expr("cast(array() as array<bigint>)").alias("bins"))

    def step(s: Column, x: Column) -> Column:
        opens = (s["used"] > 0) & (s["used"] + x["__t"] > budget)
        b = s["bin"] + opens.cast("bigint")
        return F.struct(b.alias("bin"), F.when(opens, x["__t"]).otherwise(s["used"] + x["__t"]).alias("used"), F.concat(s["bins"], F.array(b)).alias("bins"))

    bins = F.aggregate("__items", start, step, lambda s: s["bins"])
    out = grouped.select(*by, F.explode(F.arrays_zip(F.col("__items").alias("i"), bins.alias("b"))).alias("x"))
    return out.select(*by, *[F.col(f"x.i.{c}").alias(c) for c in order], F.col("x.i.__t").alias("tokens"), F.col("x.b").cast("int").alias("bin"))


def batch_specs(packed: DataFrame, by: list[str], ordinal: str) -> DataFrame:
    """One row per bin: first and last ordinal and the sum of tokens."""
    return packed.groupBy(*by, "bin").agg(F.min(ordinal).alias("start_ordinal"), F.max(ordinal).alias("end_ordinal"), F.sum("tokens").cast("bigint").alias("content_tokens"))


def batch_texts(packed: DataFrame, blocks: DataFrame, by: list[str], key: str, ordinal: str, page: str, text: str) -> DataFrame:
    """Batches with their page range and joined text; a bin's size is bounded by its budget, so its text is too."""
    b = packed.join(blocks.select(key, page, text), key)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(ordinal), F.col(key), F.col(text).alias("t")))), lambda x: F.coalesce(x["t"], F.lit(""))), "\n\n")
    return b.groupBy(*by, "bin").agg(
        F.min(ordinal).alias("start_ordinal"), F.max(ordinal).alias("end_ordinal"), F.min(page).alias("start_page"), F.max(page).alias("end_page"), F.sum("tokens").cast("bigint").alias("content_tokens"), joined.alias("text")
    )


def batch_cite(filename: Column, start_page: Column, end_page: Column) -> Column:
    """A batch's source: its file and pages."""
    span = F.when(end_page.isNotNull() & (end_page != 0) & (end_page != start_page), F.concat(F.lit("-p"), end_page.cast("string"))).otherwise(F.lit(""))
    return F.concat(filename, F.when(start_page.isNotNull(), F.concat(F.lit(" p"), start_page.cast("string"), span)).otherwise(F.lit("")))


def document_entry(filename: Column, summary: Column) -> Column:
    """A document in an inventory."""
    return F.concat(F.lit("document — "), filename, F.lit(": "), summary)


def batch_entry(cite: Column, summary: Column) -> Column:
    """A batch in an inventory."""
    return F.concat(F.lit("batch — "), cite, F.lit(": "), summary)


def table_entry(label: Column, n_rows: Column, named: Column, headers: Column) -> Column:
    """A table in an inventory: label, rows, title and caption if it has any, columns."""
    told = F.array_join(F.filter(named, lambda x: x.isNotNull() & (x != "")), " | ")
    names = F.array_join(F.transform(headers, lambda h: F.when(F.coalesce(h, F.lit("")) == "", "?").otherwise(h)), ", ")
    return F.concat(F.lit("table — "), label, F.lit(" rows="), n_rows.cast("string"), F.lit(": "), F.when(told != "", F.concat(told, F.lit(". "))).otherwise(F.lit("")), F.lit("columns "), names)


def summary_budget(tokens: Column) -> Column:
    """A tenth of the tokens, at most the summary's limit."""
    return F.least(F.floor(tokens * F.lit(SUMMARY_SHARE)), F.lit(SUMMARY_MOST)).cast("int")


def fit(items: DataFrame, by: list[str], order: list[str], floor: str, depth: str, budget: int) -> DataFrame:
    """Floors first, in order, while they fit; what is left is shared equally for depth."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    x = items.withColumn("floor_used", F.sum(F.coalesce(F.col(floor), F.lit(0))).over(w)).where(F.col("floor_used") <= budget)
    every = Window.partitionBy(*by)
    share = F.floor((F.lit(budget) - F.max("floor_used").over(every)) / F.count(F.lit(1)).over(every))
    return x.withColumn("share", share.cast("bigint")).withColumn("given", F.least(F.col("share"), F.coalesce(F.col(depth), F.lit(0)).cast("bigint")))


def tree_reduce(texts: DataFrame, by: list[str], order: str, text: str, budget: int, summarize, most_rounds: int = 16) -> DataFrame:
    """Texts of a group packed, each bin summarised, until one is left; an item above the budget is a bin of its own and is shortened by the summariser."""
    level = texts.select(*by, F.col(order).cast("bigint").alias("ord"), F.col(text).alias("text"))
    for _ in range(most_rounds):
        counted = level.withColumn("tokens", word_count(F.col("text")))
        packed = greedy_pack(counted, by, ["ord", "text"], "tokens", budget)
        joined = packed.groupBy(*by, "bin").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
        level = joined.select(*by, F.col("bin").cast("bigint").alias("ord"), summarize(F.col("text"), budget // 4).alias("text"))
        if level.groupBy(*by).count().where("count > 1").isEmpty():
            break
    return level.select(*by, "text")


def extract_summary(text: Column, budget: Column | int) -> Column:
    """The default summariser: leading sentences within the budget; of a first sentence above it, the leading words."""
    limit = (F.lit(budget) if isinstance(budget, int) else budget).cast("int")
    state = F.struct(F.lit(0).alias("n"), F.lit("").alias("t"))

    def step(s: Column, x: Column) -> Column:
        n = word_count(x).cast("int")
        whole = F.struct((s["n"] + n).cast("int").alias("n"), F.trim(F.concat_ws(" ", s["t"], x)).alias("t"))
        full = F.struct((limit + 1).cast("int").alias("n"), s["t"].alias("t"))
        words = F.slice(F.regexp_extract_all(x, F.lit(r"\s*([\p{L}\p{N}]+|[^\s\p{L}\p{N}])"), 0), F.lit(1), F.greatest(limit, F.lit(1)))
        part = F.struct((limit + 1).cast("int").alias("n"), F.trim(F.array_join(words, "")).alias("t"))
        return F.when(s["n"] + n <= limit, whole).when(s["n"] == 0, part).otherwise(full)

    kept = F.aggregate(F.split(text, r"(?<=[.!?])\s+"), state, step, lambda s: s["t"])
    return F.when(text.isNotNull(), kept)


def fabricated(answer: Column, known: Column) -> Column:
    """Bracketed citations of an answer that name no known source, each once in order; a page suffix is no part of a name."""
    cited = F.transform(F.regexp_extract_all(answer, F.lit(r"\[([^\]\n]+)\]"), 1), lambda c: F.regexp_replace(F.trim(c), r"\s+p\.?[0-9]+$", ""))
    return F.array_except(F.array_distinct(cited), known)


def upsert(current: DataFrame, incoming: DataFrame, key: str, when: str) -> DataFrame:
    """Both, the latest row of a key winning; incoming wins a tie."""
    both = current.withColumn("__new", F.lit(0)).unionByName(incoming.withColumn("__new", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.desc_nulls_last(when), F.desc("__new"))
    return both.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn", "__new")


def join_markdown(leaves: DataFrame, order: list[str]) -> DataFrame:
    """A document's parts (document_id, heading, md, content_id) as one text, a heading standing where it changes."""
    w = Window.partitionBy("document_id").orderBy(*[F.col(c).asc_nulls_last() for c in order], "content_id")
    n = leaves.withColumn("place", F.row_number().over(w))
    w = Window.partitionBy("document_id").orderBy("place")
    changed = F.col("heading").isNotNull() & ~F.lag("heading").over(w).eqNullSafe(F.col("heading"))
    n = n.withColumn("md", F.concat_ws("\n\n", F.when(changed, F.concat(F.lit("## "), F.col("heading"))), "md"))
    return n.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "md"))), lambda x: x["md"]), "\n\n").alias("markdown"))


def export_markdown(nodes: DataFrame) -> DataFrame:
    """A document's nodes as Markdown: a heading where it changes, lists indented, fenced code, formulas, tables' pipes escaped."""
    body = F.get_json_object("raw", "$.text")
    items = F.array_join(F.transform(F.from_json("raw", "struct<items:array<struct<content:string,depth:int>>>")["items"], lambda i: F.concat(F.repeat(F.lit("  "), F.coalesce(i["depth"], F.lit(0))), F.lit("- "), F.coalesce(i["content"], F.lit("")))), "\n")
    part = F.when(F.col("type") == "list", items).when(F.col("type") == "code", F.concat(F.lit("```\n"), body, F.lit("\n```"))).when(F.col("type") == "equation", F.concat(F.lit("$$\n"), F.col("latex"), F.lit("\n$$"))).when(F.col("type") == "title", F.concat(F.lit("## "), body)).when(F.col("type") == "table", F.replace(F.col("search_text"), F.lit("|"), F.lit("\\|"))).otherwise(body)
    heading = F.when(F.col("type") == "title", F.lit(None)).otherwise(F.col("heading"))
    n = nodes.withColumns({"md": part, "heading": heading, "__page": F.coalesce("page_no", "sheet_no")})
    return join_markdown(n, ["__page", "ordinal"])
