"""Engine and Library: the front of the package."""

from __future__ import annotations

import json
import logging
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import dtypes
from .operators import grid as G
from .operators import pagemd, reduce, tree
from .plans import answer, cascade
from .plans.lineage import cut
from .plans.ordering import global_rank, numbered
from .sources import files, sinks

LOG = logging.getLogger("leafmill")
#: Tables that a question is asked of, passages that are looked through and in windows of how many, passages that are shown.
TABLES, PASSAGES, WINDOW, SHOWN = 12, 60, 10, 3

_LIBRARY = "library_id bigint, name string, tier string, status string, created_at timestamp"


class Engine:
    """A store of libraries under one root folder."""

    def __init__(self, spark: SparkSession, root: str, pages: files.PageReader | None = None, convert: files.Converter | None = None, planner: cascade.QueryPlanner = cascade.plan_queries) -> None:
        self.spark, self.root, self.pages, self.convert, self.planner = spark, root.rstrip("/"), pages, convert, planner

    def config(self) -> dict:
        """What the engine reads and how it is set."""
        return {"root": self.root, "kinds": sorted({*detect_kinds()}), "page_reader": self.pages is not None, "converter": self.convert is not None, "timeout_seconds": answer.TIMEOUT}

    def libraries(self) -> DataFrame:
        """All libraries, the latest state of each."""
        path = f"{self.root}/libraries"
        if not sinks.exists(self.spark, path):
            return self.spark.createDataFrame([], _LIBRARY)
        rows = self.spark.read.schema(_LIBRARY).parquet(path)
        last = rows.groupBy("library_id").agg(F.max_by(F.struct(*rows.columns), "created_at").alias("l")).select("l.*")
        return last.where("status <> 'deleted'")

    def _put(self, library_id: int, name: str, tier: str, status: str) -> None:
        row = self.spark.createDataFrame([(library_id, name, tier, status)], "library_id bigint, name string, tier string, status string").withColumn("created_at", F.current_timestamp())
        row.coalesce(1).write.mode("append").parquet(f"{self.root}/libraries")

    def create_library(self, name: str, tier: str = "tier_1") -> Library:
        """A new library under a free number."""
        top = self.libraries().agg(F.max("library_id")).first()[0]
        number = (top or 0) + 1
        self._put(number, name, tier, "processing")
        return Library(self, number)

    def library(self, library_id: int) -> Library:
        """A library by number."""
        if self.libraries().where(F.col("library_id") == library_id).isEmpty():
            raise KeyError(library_id)
        return Library(self, library_id)

    def update_library(self, library_id: int, name: str | None = None, tier: str | None = None, status: str | None = None) -> None:
        """Rename, change the tier or the status."""
        now = self.libraries().where(F.col("library_id") == library_id).first()
        if now is None:
            raise KeyError(library_id)
        self._put(library_id, name or now["name"], tier or now["tier"], status or now["status"])

    def delete_library(self, library_id: int) -> None:
        """Remove a library and all its objects."""
        self.update_library(library_id, status="deleted")
        for kind in ("blocks", "ledger", "tables", "catalogue"):
            sinks.delete(self.spark, sinks.object_path(self.root, f"{kind}/library_id={library_id}"))


def detect_kinds() -> set[str]:
    """Kinds of files with a reader."""
    return {"csv", "tsv", "json", "xml", "html", "markdown", "text", "sheet", "slides", "document"}


class Library:
    """Documents of one library."""

    def __init__(self, engine: Engine, library_id: int) -> None:
        self.engine, self.library_id, self.spark = engine, library_id, engine.spark

    def _at(self, kind: str) -> str:
        return sinks.object_path(self.engine.root, f"{kind}/library_id={self.library_id}")

    @property
    def _path(self) -> str:
        return self._at("blocks")

    def ingest(self, folder: str) -> int:
        """Read all files of a folder; a file read before is left alone, unopened. Returns blocks added."""
        found = sinks.unseen(files.open_folder(self.spark, folder), self._at("ledger"), "path")
        blocks = cut(files.read_with_retries(found, lambda f: files.read(f, self.engine.pages, self.engine.convert)).drop("attempt"))
        n = sinks.append_missing(blocks, self._path, ["path", "page_idx", "ordinal"])
        if n:
            self._describe(blocks)
        sinks.append_missing(blocks.select("path").distinct(), self._at("ledger"), ["path"])
        self.engine.update_library(self.library_id, status="ingested")
        return n

    def _describe(self, blocks: DataFrame) -> None:
        """What a question has to know of the new tables: header row found by rule, names, size, samples and the type of every column, in one pass."""
        key = ["path", "page_idx", "ordinal"]
        b = self._typed_blocks(blocks).where("grid is not null and size(grid) > 1").withColumn("head", G.find_header(F.col("grid")))
        cells = b.select(*key, "head", F.posexplode("grid").alias("row", "r")).where("row > head").select(*key, F.posexplode("r").alias("col", "value"))
        kinds = dtypes.infer(cells.withColumn("value", F.coalesce("value", F.lit(""))), [*key, "col"]).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("col", "dtype", "scale"))).alias("types"))
        made = b.select(*key, "text", "head", (F.size("grid") - F.col("head") - 1).alias("n_rows"), G.headers(F.col("grid"), F.array("head")).alias("headers"), F.slice("grid", F.col("head") + 2, 3).alias("samples")).join(kinds, key, "left")
        sinks.append_missing(made, self._at("tables"), key)
        # numbers and labels are those of all tables in order, so they are made anew
        all_tables = self.spark.read.parquet(self._at("tables"))
        name = F.element_at(F.split("path", "/"), -1)
        label = F.when(F.coalesce("text", F.lit("")) == "", name).otherwise(F.concat(name, F.lit(" ("), "text", F.lit(")")))
        ranked = global_rank(all_tables.withColumn("plain", label), key, "number").withColumn("number", F.col("number") - 1)
        told = numbered(ranked, ["plain"], ["number"], count="same", number="place")
        told = told.withColumn("label", F.when(F.col("same") > 1, F.concat("plain", F.lit(" #"), (F.col("place") + 1).cast("string"))).otherwise(F.col("plain"))).drop("plain", "same", "place")
        cut(told).write.mode("overwrite").parquet(self._at("catalogue"))

    def tables(self) -> DataFrame:
        """Every table with a grid: number, label, headers, types, size and samples."""
        path = self._at("catalogue")
        if not sinks.exists(self.spark, path):
            return self.spark.createDataFrame([], "number bigint, label string, path string, page_idx int, ordinal int, head int, n_rows int, headers array<string>, samples array<array<string>>, types array<struct<col:int,dtype:string,scale:int>>")
        return self.spark.read.parquet(path)

    def blocks(self) -> DataFrame:
        """Blocks as read; page markdown split into its tagged stretches."""
        return self._typed_blocks(self.spark.read.parquet(self._path))

    def _typed_blocks(self, raw: DataFrame) -> DataFrame:
        pages = raw.where("type = 'page'")
        split = pagemd.sections(pages.withColumn("text", pagemd.strip_meta(pagemd.strip_fence(pagemd.strip_think(F.col("text"))))), ["path", "kind", "page_idx"])
        typed = pagemd.section_blocks(split, ["path", "kind", "page_idx"]).withColumns({"text_level": F.lit(None).cast("int"), "error": F.lit(None).cast("string")})
        typed = typed.select("path", "kind", "page_idx", "ordinal", "type", "text", "text_level", "grid", "error")
        return raw.where("type <> 'page'").select(typed.columns).unionByName(typed)

    def documents(self) -> DataFrame:
        """One row a file: kind, blocks and status."""
        b = self.spark.read.parquet(self._path)
        status = F.when(F.count_if(F.col("type") == "error") == F.count(F.lit(1)), "failed").when(F.count_if(F.col("type") == "error") > 0, "partial").otherwise("ingested")
        return b.groupBy("path").agg(F.first("kind").alias("kind"), F.count(F.lit(1)).alias("blocks_in"), status.alias("status"), F.max("error").alias("error")).withColumn("filename", F.element_at(F.split("path", "/"), -1))

    def progress(self) -> dict[str, int]:
        """Documents by status."""
        return {r["status"]: r["count"] for r in self.documents().groupBy("status").count().collect()}

    def tree(self) -> DataFrame:
        """Leaves with page ordinals, kinds and heading paths."""
        b = self.blocks().withColumn("document_id", F.xxhash64("path")).withColumn("block_id", F.col("page_idx").cast("bigint") * (1 << 32) + F.col("ordinal"))
        # ids are unique within a document; across documents they are told apart by the path
        b = b.withColumn("block_id", F.xxhash64("path").bitwiseAND(F.lit(0x7FFFFF)) * F.lit(1 << 40) + F.col("block_id"))
        return tree.build_tree(b.withColumn("source", F.col("kind")))

    def export_markdown(self, path: str) -> None:
        """A Markdown text of every document, by library: a heading where it changes."""
        t = self.tree().withColumn("content_id", F.col("block_id"))
        body = F.when(F.col("kind") == "code", F.concat(F.lit("```\n"), "text", F.lit("\n```"))).when(F.col("kind") == "list", F.array_join(F.transform("items", lambda i: F.concat(F.repeat(F.lit("  "), i["depth"]), F.lit("- "), i["content"])), "\n")).when(F.col("kind") == "equation", F.concat(F.lit("$$\n"), "latex", F.lit("\n$$"))).otherwise(F.col("text"))
        made = reduce.join_markdown(t.withColumn("md", body), ["page_no", "ordinal"])
        sinks.export_library(made, made.select(F.col("document_id").alias("doc_id"), F.lit(self.library_id).alias("library_id")), path)

    def trees(self) -> DataFrame:
        """One JSON tree a document."""
        d = self.documents().select(F.xxhash64("path").alias("doc_id"), F.lit(self.library_id).alias("library_id"), "filename", F.lit(None).cast("string").alias("title"))
        return sinks.document_trees(self.tree(), d)

    def result(self, path: str) -> dict:
        """What became of one file: its status, counts, and its tree."""
        row = self.documents().where(F.col("path") == path).first()
        if row is None:
            raise KeyError(path)
        tree_row = self.trees().where(F.col("document_id") == F.xxhash64(F.lit(path))).first()
        return row.asDict() | {"tables": self.tables().where(F.col("path") == path).count(), "tree": json.loads(tree_row["tree"]) if tree_row else None}

    def _views(self, spark: SparkSession, rows: list, names: list[str]) -> list[answer.TableInfo]:
        """Views over the positional rows of some tables, in a session of their own."""
        infos = []
        for r, name in zip(rows, names, strict=True):
            one = self._typed_blocks(spark.read.parquet(self._path)).where((F.col("path") == r["path"]) & (F.col("page_idx") == r["page_idx"]) & (F.col("ordinal") == r["ordinal"]))
            body = one.select(F.posexplode("grid").alias("row_idx", "values")).where((F.col("row_idx") > r["head"]) & F.exists("values", lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""))
            found = {t["col"]: (t["dtype"], t["scale"]) for t in r["types"] or []}
            columns = [found.get(i, ("string", 0)) for i in range(len(r["headers"]))]
            dtypes.typed_view(body, columns, ()).createOrReplaceTempView(name)
            infos.append(answer.TableInfo(r["label"], list(r["headers"]), columns, r["n_rows"], [list(x) for x in r["samples"]]))
        return infos

    def sql(self, query: str) -> answer.SqlResult:
        """A query over ``t0..tN``, the library's tables in order; only those it names are opened."""
        named = sorted({int(n) for n in re.findall(r"\bt(\d+)\b", query, re.I)})
        rows = self.tables().where(F.col("number").isin(named)).orderBy("number").collect()
        spark = self.spark.newSession()
        infos = self._views(spark, rows, [f"t{r['number']}" for r in rows])
        labels = {r["number"]: i.label for r, i in zip(rows, infos, strict=True)}
        return answer.execute(spark, query, [labels.get(n, "") for n in range(max(named, default=-1) + 1)], timeout=60.0)

    def ask(self, question: str) -> Iterator[str]:
        """An answer with its sources, a part at a time: computed figures first, then passages.

        The tables that share most words with the question are described to the planner
        and opened in a session of the question's own. Passages that fit the budget are
        read in order of rank; more are walked through in windows, until two in a row give
        nothing. Sources that no evidence has are logged.
        """
        about = F.concat_ws(" ", "label", F.array_join("headers", " "))
        chosen = cascade.relevant(self.tables().withColumn("about", about), question, "about").orderBy(F.desc("shared"), "number").limit(TABLES).collect()
        spark = self.spark.newSession()
        infos = self._views(spark, chosen, [f"t{i}" for i in range(len(chosen))])
        said, known = [], [i.label for i in infos]
        for result in answer.answer_all(spark, self.engine.planner(question, infos), known):
            shown = answer.SqlResult(answer.readable(result.sql, infos), result.columns, result.rows, result.total, result.sources)
            said.append(answer.render(shown, ", ".join(f"[{s}]" for s in result.sources)) + "\n")
            yield said[-1]
        for r in self._passages(question):
            name = r["path"].rsplit("/", 1)[-1]
            known.append(name)
            said.append(f"{r['text']} [{name} p{r['page_idx'] + 1}]\n")
            yield said[-1]
        if not said:
            yield "The library holds nothing that answers this.\n"
        for cited in answer.fabricated("".join(said), known):
            LOG.warning("cited without evidence: %s", cited)

    def _passages(self, question: str) -> list:
        """The passages that are shown, of the documents and then the blocks that share words with the question."""
        texts = self.blocks().where("text is not null and grid is null").withColumn("content_id", F.xxhash64("path", "page_idx", "ordinal")).withColumn("search_text", F.col("text"))
        near = cut(cascade.relevant(texts, question, "text", least=2))
        fits = cascade.gate(near.withColumn("tokens", reduce.word_count(F.col("text"))), "tokens")
        ranked = cascade.ranked_blocks(near, question).where(F.col("place") <= PASSAGES)
        best = ranked.join(near.select("content_id", "path", "page_idx", "text", "shared"), "content_id").orderBy("place").collect()
        if fits:
            return best[:SHOWN]
        enough = max(2, (len(cascade.words(question)) + 1) // 2)
        windows = [best[i : i + WINDOW] for i in range(0, len(best), WINDOW)]
        return answer.walk(windows, lambda w: [r for r in w if r["shared"] >= enough])[:SHOWN]
