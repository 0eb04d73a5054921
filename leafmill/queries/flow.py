"""Queries of sources, sinks and the dataflow: tables are written out, read or streamed back, and compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import embedding as E
from ..operators import ranking as R
from ..operators import reduce as D
from ..operators import tree as T
from ..plans import answer
from ..plans.lineage import scratch
from ..session import table
from ..sources import files, sinks
from ..streaming import flow, ingest

_TEXTS = {
    "json": lambda: F.to_json(F.array(F.struct(F.col("n_name").alias("name"), F.struct(F.col("n_nationkey").alias("key")).alias("id")))),
    "html": lambda: F.concat(F.lit("<html><body><h1>"), "n_name", F.lit("</h1><p>Key "), F.col("n_nationkey").cast("string"), F.lit("</p></body></html>")),
    "csv": lambda: F.concat(F.lit("name,key\n"), "n_name", F.lit(","), F.col("n_nationkey").cast("string"), F.lit("\n")),
    "tsv": lambda: F.concat(F.lit("name\tkey\n"), "n_name", F.lit("\t"), F.col("n_nationkey").cast("string"), F.lit("\n")),
    "md": lambda: F.concat(F.lit("# "), "n_name", F.lit("\n\nKey "), F.col("n_nationkey").cast("string"), F.lit("\n")),
    "xml": lambda: F.concat(F.lit("<r><name>"), "n_name", F.lit("</name><key>"), F.col("n_nationkey").cast("string"), F.lit("</key></r>")),
    "txt": lambda: F.concat(F.lit("First of "), "n_name", F.lit("\n\nSecond of "), "n_name"),
    "bin": lambda: F.concat(F.lit("{\"name\": \""), "n_name", F.lit("\"}")),
    "pdf": lambda: F.concat(F.lit("%PDF-1.4 "), "n_name"),
}


def _nation_files(spark, folder):
    """Every nation as a file of every kind, as the binary reader gives it."""
    n = table(spark, folder, "nation")
    one = [n.select(F.concat(F.lit(f"/in/{ext}/"), F.col("n_nationkey").cast("string"), F.lit(f".{ext}")).alias("path"), F.encode(make(), "UTF-8").alias("content")) for ext, make in _TEXTS.items()]
    out = one[0]
    for more in one[1:]:
        out = out.unionByName(more)
    return out


def file_blocks(spark, folder):
    """Files of nine kinds to blocks."""
    b = files.read(_nation_files(spark, folder))
    cells = F.array_join(F.flatten("grid"), "|")
    return b.select(F.element_at(F.split("path", "/"), -1).alias("file"), "kind", "ordinal", "type", "text_level", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(cells, F.lit("")).alias("cells"))


def failed_files(spark, folder):
    """Files that no reader takes, after three attempts, and how the rest came out."""
    b = files.read_with_retries(_nation_files(spark, folder), files.read)
    return b.groupBy("kind", "attempt", (F.col("type") == "error").alias("failed")).agg(F.countDistinct("path").alias("files"))


def delimited_rows(spark, folder):
    """A table written as delimited text and read back by position."""
    path = scratch(spark)
    c = table(spark, folder, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    c.repartitionByRange(3, "c_custkey").sortWithinPartitions("c_custkey").write.csv(path, header=True, sep=";", quoteAll=True)
    rows = files.read_delimited(spark, path, ";").where("row_idx > 0")
    v = F.col("values")
    return rows.select(v[0].cast("bigint").alias("c_custkey"), v[1].alias("c_name"), v[2].alias("c_mktsegment"), v[3].cast("int").alias("c_nationkey"))


def document_json(spark, folder):
    """Documents as JSON trees, read back: type, title, and the blocks of each."""
    b = T.delivered(table(spark, folder, "blocks"))
    trees = sinks.document_trees(T.build_tree(b), table(spark, folder, "documents"))
    kinds = F.from_json(F.get_json_object("tree", "$.blocks"), "array<struct<kind:string>>")
    return trees.select("document_id", F.get_json_object("tree", "$.type").alias("type"), F.get_json_object("tree", "$.title").alias("title"), F.size(kinds).cast("bigint").alias("n_blocks"), F.size(F.filter(kinds, lambda k: k["kind"] == "list")).cast("bigint").alias("n_lists"))


def sink_once(spark, folder):
    """Blocks stored in two overlapping deliveries: each is there once."""
    path, b = scratch(spark), table(spark, folder, "blocks").select("block_id", "type", "source")
    sinks.append_missing(b.where("block_id % 3 < 2"), path, ["block_id"], ["type"])
    sinks.append_missing(b.where("block_id % 3 > 0"), path, ["block_id"], ["type"])
    return sinks.stored(spark, path, "block_id bigint, source string, type string").groupBy("type").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("block_id").alias("blocks"))


def sink_replaced(spark, folder):
    """Events stored by type, and one type's partition replaced."""
    path, e = scratch(spark), table(spark, folder, "events").select("event_id", "value", "event_type")
    sinks.replace_partitions(e, path, ["event_type"])
    sinks.replace_partitions(e.where("event_type = 'click' and event_id % 2 = 0"), path, ["event_type"])
    return sinks.stored(spark, path, "event_id bigint, value double, event_type string").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


def exported_markdown(spark, folder):
    """The Markdown export of all libraries, read back: documents and characters of each."""
    path = scratch(spark)
    md = D.export_markdown(table(spark, folder, "content_nodes"))
    sinks.export_library(md.select("document_id", F.regexp_replace("markdown", "\\s+", " ").alias("markdown")), table(spark, folder, "documents"), path)
    back = spark.read.text(path)
    if "library_id" not in back.columns:  # no document, so no folder of a library
        back = back.withColumn("library_id", F.lit(None).cast("int"))
    return back.groupBy("library_id").agg(F.count(F.lit(1)).alias("documents"))


def _page_stream(spark, folder, name):
    """A table as a stream of its files; the pattern takes it as one file or as a folder of some."""
    return spark.readStream.schema(table(spark, folder, name).schema).parquet(f"{folder}/{name}.parque[t]")


def stream_completion(spark, folder):
    """Blocks as a stream of pages: every document comes out complete once."""
    path = scratch(spark)
    need = table(spark, folder, "blocks").groupBy("document_id").agg((F.countDistinct("page_idx")).cast("int").alias("page_count"))
    pages = _page_stream(spark, folder, "blocks").join(need, "document_id").select(F.col("document_id").alias("doc_id"), "page_idx", "page_count")
    ingest.complete_documents(pages, wait=None).writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("doc_id bigint, pages int, complete boolean").parquet(path)


def stream_barrier(spark, folder):
    """The same with a barrier: what was merged of each document, in as many batches as there are deliveries, each delivered twice."""
    store, merged = scratch(spark), scratch(spark)
    b = table(spark, folder, "blocks")
    need = b.groupBy("document_id").agg(F.countDistinct("page_idx").cast("int").alias("page_count"))
    units = b.groupBy("document_id", "page_idx").agg(F.countDistinct("block_id").alias("n_blocks")).join(need, "document_id").withColumnRenamed("document_id", "doc_id")

    def merge(rows):
        return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), F.sum("n_blocks").alias("blocks"))

    for batch, part in enumerate((F.col("page_idx") % 2 == 0, F.lit(True), F.col("page_idx") % 2 == 1)):
        flow.barrier(units.where(part), store, merged, merge, batch)
    return sinks.stored(spark, merged, "doc_id bigint, pages bigint, blocks bigint, batch int").select("doc_id", "pages", "blocks")


def stream_windows(spark, folder):
    """Events streamed into daily windows, all of them to the end."""
    path = scratch(spark)
    events = _page_stream(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = ingest.windowed_counts(events, late="0 seconds")
    w.writeStream.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path)).option("checkpointLocation", f"{path}-state").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path).select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n")


def fair_turns(spark, folder):
    """Pages of all documents in turns."""
    pages = table(spark, folder, "blocks").select("document_id", "page_idx").distinct()
    return flow.fair_order(pages, ["document_id"], ["page_idx"])


def claimed_libraries(spark, folder):
    """Libraries that may be finalised, claimed by two callers one after the other."""
    ledger = scratch(spark)
    ready = flow.claimable(table(spark, folder, "libraries"))
    first, second = flow.claim(ready.where("library_id % 2 = 0"), ledger, "library_id"), flow.claim(ready, ledger, "library_id")
    return first.withColumn("caller", F.lit(1)).unionByName(second.withColumn("caller", F.lit(2)))


def stage_timing(spark, folder):
    """Time from arrival to ingestion a block, by source."""
    d = table(spark, folder, "documents").select(F.coalesce("source", F.lit("?")).alias("stage"), F.col("created_at").alias("begun"), F.col("ingested_at").alias("ended"), F.col("blocks_in").alias("units"))
    return flow.stage_times(d).select("stage", "runs", "units", F.round("mean_ms", 3).alias("mean_ms"), F.round("max_ms", 3).alias("max_ms"))


def expired_documents(spark, folder):
    """Documents that clean-up would remove at the start of 2024."""
    return flow.expired(table(spark, folder, "documents"), "ingested_at", "2024-07-01 00:00:00").select("doc_id")


def progress_view(spark, folder):
    """Documents of every library by what has become of them."""
    d = table(spark, folder, "documents")
    status = F.coalesce("status", F.lit("unknown"))
    return d.groupBy("library_id", status.alias("status")).agg(F.count(F.lit(1)).alias("documents"), F.sum(F.coalesce("blocks_in", F.lit(0))).alias("blocks"))


def schema_texts(spark, folder):
    """What a query writer is shown of every catalogued table."""
    n = table(spark, folder, "table_rows").groupBy("table_id").agg(F.countDistinct("row_idx").alias("rows_held"))
    rows = table(spark, folder, "table_catalog").join(n, "table_id", "left").where("column_specs is not null").select("table_id", F.coalesce("title", F.lit("?")).alias("title"), "column_specs", F.coalesce("rows_held", F.lit(0)).alias("n")).collect()  # the catalogue of tables
    texts = [(r["table_id"], answer.schema_block([answer.TableInfo(r["title"], [c["header"] for c in r["column_specs"]], [(c["dtype"], 0) for c in r["column_specs"]], r["n"])])) for r in rows]
    return spark.createDataFrame(texts, "table_id bigint, text string")


def table_passages(spark, folder):
    """Grids as passages: rows, header, the first three of them."""
    g = T.delivered(table(spark, folder, "blocks")).where("grid is not null and size(grid) > 0")
    plain = F.transform("grid", lambda r: F.transform(r, lambda c: F.coalesce(c, F.lit(""))))
    passage = E.table_passage(F.concat(F.lit("block "), F.col("block_id").cast("string")), F.size("grid") - 1, plain[0], F.slice(plain, 2, 3))
    return g.select("block_id", F.md5(passage).alias("digest"))


def near_index_recall(spark, folder):
    """Of the vectors that the projection index gives for a query vector, whether they are the nearest: how many of the exact ten are among its fifty."""
    from pyspark.ml.functions import array_to_vector

    v = table(spark, folder, "embeddings").where("embedding is not null")
    if v.isEmpty():
        return spark.createDataFrame([], "nine_of_ten boolean, found bigint")
    model, hashed = E.near_index(v, key="vec_id", tables=8, width=2.0)
    q = v.orderBy("vec_id").limit(1).select(array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("q")).first()["q"]
    unit = q / float(q.norm(2))
    got = model.approxNearestNeighbors(hashed, unit, 50).select("vec_id")
    exact = R.dense_order(v, [float(x) for x in q]).where("place <= 10").select("vec_id")
    return exact.join(got, "vec_id", "left_semi").agg((F.count(F.lit(1)) >= 9).alias("nine_of_ten"), F.count(F.lit(1)).alias("found"))


_SQL_KINDS = {"json": "'json'", "html": "'html'", "csv": "'csv'", "tsv": "'tsv'", "md": "'markdown'", "xml": "'xml'", "txt": "'text'"}
_ROW = "SELECT n_nationkey || '.{ext}' AS file, {kind} AS kind, {ordinal} AS ordinal, {type} AS type, {level} AS text_level, {text} AS text, {cells} AS cells FROM nation"


def _row(ext, ordinal, kind_of, text, cells="''", level="CAST(NULL AS INT)", kind=None):
    return _ROW.format(ext=ext, kind=kind or _SQL_KINDS[ext], ordinal=ordinal, type=f"'{kind_of}'", level=level, text=text, cells=cells)


_UNITS = "u AS (SELECT document_id, page_idx, count(DISTINCT block_id) AS n FROM blocks GROUP BY 1, 2)"
SQL = {
    "file_blocks": " UNION ALL ".join(
        [
            _row("json", 0, "table", "'root'", "'_id|name|id.key|1|' || n_name || '|' || n_nationkey"), _row("html", 0, "title", "n_name", level="1"), _row("html", 1, "text", "'Key ' || n_nationkey"),
            _row("csv", 0, "table", "''", "'name|key|' || n_name || '|' || n_nationkey"), _row("tsv", 0, "table", "''", "'name|key|' || n_name || '|' || n_nationkey"),
            _row("md", 0, "title", "n_name", level="1"), _row("md", 1, "text", "'Key ' || n_nationkey"), _row("xml", 0, "table", "'root'", "'_id|r.name|r.key|1|' || n_name || '|' || n_nationkey"),
            _row("txt", 0, "text", "'First of ' || n_name"), _row("txt", 1, "text", "'Second of ' || n_name"), _row("bin", 0, "table", "'root'", "'_id|name|1|' || n_name", kind="'json'"), _row("pdf", 0, "error", "''", kind="'pdf'"),
        ]
    ),
    "failed_files": "SELECT kind, CAST(CASE WHEN kind = 'pdf' THEN 3 ELSE 1 END AS INT) AS attempt, kind = 'pdf' AS failed, CAST(sum(n) AS BIGINT) AS files FROM (SELECT unnest(['json', 'html', 'csv', 'tsv', 'markdown', 'xml', 'text', 'json', 'pdf']) AS kind, n FROM (SELECT count(*) AS n FROM nation)) GROUP BY 1",
    "delimited_rows": "SELECT c_custkey, c_name, c_mktsegment, c_nationkey FROM customer",
    "document_json": None,
    "sink_once": "SELECT type, count(DISTINCT block_id) AS rows, count(DISTINCT block_id) AS blocks FROM blocks GROUP BY 1",
    "sink_replaced": "SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events WHERE event_type <> 'click' OR event_id % 2 = 0 GROUP BY 1",
    "exported_markdown": "SELECT library_id, count(DISTINCT document_id) AS documents FROM content_nodes JOIN documents ON document_id = doc_id GROUP BY 1",
    "stream_completion": f"WITH {_UNITS} SELECT document_id AS doc_id, CAST(count(*) AS INT) AS pages, true AS complete FROM u GROUP BY 1",
    "stream_barrier": f"WITH {_UNITS} SELECT document_id AS doc_id, count(*) AS pages, CAST(sum(n) AS BIGINT) AS blocks FROM u GROUP BY 1",
    "stream_windows": "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "fair_turns": "WITH p AS (SELECT DISTINCT document_id, page_idx FROM blocks), n AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page_idx) - 1 AS nth FROM p) SELECT document_id, page_idx, nth, row_number() OVER (ORDER BY nth, document_id) - 1 AS turn FROM n",
    "claimed_libraries": "SELECT library_id, CASE WHEN library_id % 2 = 0 THEN 1 ELSE 2 END AS caller FROM libraries WHERE status = 'ingested' AND ingested_at IS NOT NULL",
    "stage_timing": "SELECT coalesce(source, '?') AS stage, count(*) AS runs, CAST(sum(blocks_in) AS BIGINT) AS units, round(avg((epoch_us(ingested_at) - epoch_us(created_at)) / 1000.0 / blocks_in), 3) AS mean_ms, round(max((epoch_us(ingested_at) - epoch_us(created_at)) / 1000.0 / blocks_in), 3) AS max_ms FROM documents WHERE ingested_at IS NOT NULL AND created_at IS NOT NULL AND blocks_in > 0 GROUP BY 1",
    "progress_view": "SELECT library_id, coalesce(status, 'unknown') AS status, count(*) AS documents, CAST(sum(coalesce(blocks_in, 0)) AS BIGINT) AS blocks FROM documents GROUP BY 1, 2",
    "schema_texts": "SELECT table_id, 't0 (' || title || ') rows=' || coalesce(n, 0) || chr(10) || array_to_string(list_transform(column_specs, lambda c, i: '  c' || (i - 1) || ': ' || c.header || ' (' || c.dtype || ')'), chr(10)) AS text FROM table_catalog LEFT JOIN (SELECT table_id, count(DISTINCT row_idx) AS n FROM table_rows GROUP BY 1) USING (table_id)",
    "table_passages": "WITH b AS (SELECT * EXCLUDE (received_at) FROM blocks QUALIFY row_number() OVER (PARTITION BY block_id ORDER BY received_at) = 1), g AS (SELECT block_id, list_transform(grid, lambda r: list_transform(r, lambda c: coalesce(c, ''))) AS g FROM b WHERE grid IS NOT NULL AND len(grid) > 0) SELECT block_id, md5('[block ' || block_id || '] table with ' || (len(g) - 1) || ' rows, ' || len(g[2:4]) || ' shown' || chr(10) || array_to_string(g[1], ' | ') || chr(10) || coalesce(array_to_string(list_transform(g[2:4], lambda r: array_to_string(r, ' | ')), chr(10)), '')) AS digest FROM g",
    "expired_documents": "SELECT doc_id FROM documents WHERE ingested_at < TIMESTAMP '2024-07-01' - INTERVAL 24 HOUR",
}
QUERIES = {n: globals()[n] for n in [*SQL, "near_index_recall"]}
from .trees import _LEAVES  # noqa: E402 - the leaves' SQL is the tree's

SQL["document_json"] = f"WITH {_LEAVES}, n AS (SELECT document_id, count(*) AS n, count(*) FILTER (WHERE kind = 'list') AS l FROM leaves GROUP BY 1) SELECT doc_id AS document_id, 'document' AS type, title, coalesce(n, 0) AS n_blocks, coalesce(l, 0) AS n_lists FROM documents LEFT JOIN n ON doc_id = document_id"
