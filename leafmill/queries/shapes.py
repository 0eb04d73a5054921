"""Queries of the grid, page-markdown, JSON, ranking and reduction operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import grid as G
from ..operators import pagemd as P
from ..operators import ranking as R
from ..operators import reduce as D
from ..operators import shred as J
from ..operators import tree as T
from ..session import table
from ..sources import images


def _grids(spark, folder):
    return T.delivered(table(spark, folder, "blocks")).where("grid is not null")


def _flat(column):
    return F.array_join(F.transform(column, lambda r: F.array_join(r, "|")), "\n")


def transpose_grid(spark, folder):
    return _grids(spark, folder).select("block_id", _flat(G.transpose(F.col("grid"))).alias("flat"))


def header_naming(spark, folder):
    return _grids(spark, folder).select("block_id", F.array_join(G.headers(F.col("grid"), F.array(F.lit(0))), "|").alias("names"))


def materialised_rows(spark, folder):
    b = G.body(F.col("grid"), F.lit(1), F.size("grid"), F.expr("cast(array() as array<int>)"))
    return _grids(spark, folder).select("block_id", F.size(b).cast("bigint").alias("n_rows"))


def stride_sample(spark, folder):
    return G.stride_sample(table(spark, folder, "table_rows").dropDuplicates(["table_id", "row_idx"]).select("table_id", "row_idx"), ["table_id"], ["row_idx"])


def stratified_sample(spark, folder):
    return G.stratified_sample(table(spark, folder, "table_rows").dropDuplicates(["table_id", "row_idx"]).select("table_id", "row_idx"), ["table_id"], ["row_idx"])


def _cells(spark, folder):
    rows = _grids(spark, folder).select("block_id", F.posexplode("grid").alias("row_idx", "r")).where("row_idx > 0")
    return rows.select("block_id", "row_idx", F.posexplode("r").alias("col", "v")).select("block_id", "row_idx", "col", F.coalesce("v", F.lit("")).alias("value"))


def column_kinds(spark, folder):
    return G.column_kinds(_cells(spark, folder), ["block_id", "col"])


def conformance_runs(spark, folder):
    return G.conformance(_cells(spark, folder), ["block_id", "col"]).select("block_id", "col", F.col("run").cast("int").alias("run"), "state", "from_row", "to_row", "n")


def unpivot_crosstab(spark, folder):
    wide = table(spark, folder, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.sum("l_quantity").cast("bigint"))
    return G.unpivot(wide, ["l_returnflag"], ["F", "O"], "l_linestatus", "quantity")


def pivot_crosstab(spark, folder):
    return table(spark, folder, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))


def claimed_regions(spark, folder):
    """Batches as the tables of a document's region, each three rows longer than it is: those that are left, moved out of each other's way."""
    b = table(spark, folder, "content_batches").where("start_block_ordinal is not null")
    t = b.select(F.col("document_id").alias("region_id"), F.col("batch_no").alias("table_no"), F.col("start_block_ordinal").alias("data_start"), (F.col("end_block_ordinal") + 3).alias("data_end"), (F.col("batch_no") % 2).alias("col_start"), (F.col("batch_no") % 2 + 2).alias("col_end"))
    return G.claims(t.select("region_id", *[F.col(c).cast("int").alias(c) for c in ("table_no", "data_start", "data_end", "col_start", "col_end")]))


def region_overlaps(spark, folder):
    """The same tables before they are moved: which pairs meet."""
    b = table(spark, folder, "content_batches").where("start_block_ordinal is not null")
    t = b.select(F.col("document_id").alias("region_id"), F.col("batch_no").alias("table_no"), F.col("start_block_ordinal").alias("data_start"), (F.col("end_block_ordinal") + 3).alias("data_end"), (F.col("batch_no") % 2).alias("col_start"), (F.col("batch_no") % 2 + 2).alias("col_end"))
    return G.overlaps(t)


def transposed_tables(spark, folder):
    """Grids read as tables whose records are columns."""
    heads, rows = G.transposed_body(F.col("grid"), F.lit(0), F.size("grid"), F.lit(0), G.width(F.col("grid")))
    return _grids(spark, folder).select("block_id", F.array_join(heads, "|").alias("names"), F.md5(_flat(rows)).alias("digest"), F.size(rows).cast("bigint").alias("n_rows"))


def number_cells(spark, folder):
    return _cells(spark, folder).where(G.number_of(F.col("value")).isNotNull()).groupBy("block_id").agg(F.count(F.lit(1)).alias("n"))


def tag_split(spark, folder):
    """Pages of all blocks: a fence line in a block opens code to the next one or the page's end, where tags are content; a tag line in a block opens a section."""
    tag = F.when(F.col("type") == "list", "==LIST==").when(F.col("type") == "code", "==CODE==").when(F.col("type") == "equation", "==EQUATION==").when(F.col("type").isin("header", "number"), "==PARATEXT==").otherwise("==TEXT==")
    b = T.delivered(table(spark, folder, "blocks")).where("text is not null")
    md = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_id", F.concat_ws("\n", tag, "text").alias("t")))), lambda x: x["t"]), "\n")
    s = P.sections(b.groupBy("document_id", "page_idx").agg(md.alias("text")), ["document_id", "page_idx"])
    return s.groupBy("document_id", "page_idx", "tag").agg(F.count(F.lit(1)).alias("sections"), F.sum(F.char_length("content")).cast("bigint").alias("chars"))


def think_strip(spark, folder):
    d = table(spark, folder, "documents").where("text is not null")
    return d.select("doc_id", F.md5(P.strip_think(F.concat(F.lit("<think>"), "text", F.lit("</think>!")))).alias("digest"))


def fence_strip(spark, folder):
    """All texts within a fence: one whose own fence lines don't pair up keeps the fence around it."""
    d = table(spark, folder, "documents").where("text is not null")
    return d.select("doc_id", F.md5(P.strip_fence(F.concat(F.lit("```markdown\n"), "text", F.lit("\n```")))).alias("digest"))


def meta_strip(spark, folder):
    """Texts under a reader's own remarks, and their own lines that look like some but aren't."""
    d = table(spark, folder, "documents").where("text is not null")
    said = F.concat(F.lit("Here is the transcription of it:\n---\nThe image shows a harbour.\nI cannot read more.\n"), "text")
    return d.select("doc_id", F.md5(P.strip_meta(said)).alias("digest"))


def paragraphs(spark, folder):
    p = P.paragraphs(table(spark, folder, "documents"), ["doc_id"])
    return p.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


def plain_markdown(spark, folder):
    """Texts as Markdown without tags: how many blocks of each kind, and their lines, per document."""
    p = P.plain_blocks(table(spark, folder, "documents").where("text is not null"), ["doc_id"])
    return p.groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("n_lines").alias("lines"), F.sum(F.char_length("content")).alias("chars"))


def json_shred(spark, folder):
    return J.key_values(table(spark, folder, "events"), "props", ["event_id"])


def json_entities(spark, folder):
    nodes = table(spark, folder, "content_nodes").where("type = 'list' and raw is not null")
    items = J.read(nodes, "raw", "items array<struct<ordinal:int,content:string,depth:int>>").select("content_id", "record.items")
    return J.children(items, "items", ["content_id"]).select("content_id", F.col("_id").cast("int").alias("item"), "ordinal", "content", "depth")


def dense_rank_vec(spark, folder):
    v = table(spark, folder, "embeddings")
    first = v.where("embedding is not null").orderBy("vec_id").first()  # a query without a vector is like nothing
    query = list(first["embedding"]) if first else []
    return R.dense_order(v, query).select("vec_id", F.round("similarity", 6).alias("similarity"))


def trigram_rank(spark, folder):
    t = table(spark, folder, "documents").where("title is not null")
    return R.sparse_order(t, "Harbour Journal 2010", "doc_id", "title").select("doc_id", F.round("similarity", 6).alias("similarity"))


def trigram_top(spark, folder):
    """The twenty titles most like a string, by the inverted table."""
    t = table(spark, folder, "documents").where("title is not null")
    sizes = t.select("doc_id", F.size(R.trigrams(F.col("title"))).alias("n"))
    return R.sparse_top(R.trigram_index(t, "doc_id", "title"), sizes, "Harbour Journal 2010", "doc_id", 20).select("doc_id", F.round("similarity", 6).alias("similarity"))


def rrf_fuse(spark, folder):
    t = table(spark, folder, "documents").where("title is not null")
    a = R.sparse_order(t, "Harbour Journal 2010", "doc_id", "title")
    b = R.sparse_order(t, "Tariff Report", "doc_id", "title")
    return R.fuse([a, b], "doc_id").select("doc_id", F.round("score", 9).alias("score"))


def pending_embeddings(spark, folder):
    return R.pending(table(spark, folder, "content_nodes"), table(spark, folder, "node_embeddings")).select("content_id")


def token_counts(spark, folder):
    return table(spark, folder, "documents").select("doc_id", D.word_count(F.col("text")).cast("bigint").alias("n"))


def greedy_pack(spark, folder):
    n = table(spark, folder, "content_nodes").where("block_ordinal is not null")
    return D.greedy_pack(n, ["document_id"], ["block_ordinal", "content_id"], "token_count", 512).select("content_id", "bin")


def batch_spec(spark, folder):
    n = table(spark, folder, "content_nodes").where("block_ordinal is not null")
    packed = D.greedy_pack(n, ["document_id"], ["block_ordinal", "content_id"], "token_count", 512)
    return D.batch_specs(packed, ["document_id"], "block_ordinal")


def batch_texts(spark, folder):
    """Batches of node texts with their page range and joined text."""
    n = table(spark, folder, "content_nodes").where("block_ordinal is not null")
    packed = D.greedy_pack(n, ["document_id"], ["block_ordinal", "content_id"], "token_count", 512)
    t = D.batch_texts(packed, n, ["document_id"], "content_id", "block_ordinal", "page_no", "search_text")
    return t.select("document_id", "bin", "start_ordinal", "end_ordinal", "start_page", "end_page", "content_tokens", F.md5("text").alias("digest"))


def batch_entries(spark, folder):
    """Summaries as inventory entries, with their file and pages."""
    b = table(spark, folder, "content_batches").where("summary is not null")
    d = table(spark, folder, "documents").select(F.col("doc_id").alias("document_id"), F.coalesce("filename", F.lit("?")).alias("filename"))
    return b.join(d, "document_id").select("batch_id", D.batch_entry(D.batch_cite(F.col("filename"), F.col("start_page_no"), F.col("end_page_no")), F.col("summary")).alias("entry"))


def table_entries(spark, folder):
    """Catalogued tables as inventory entries."""
    n = table(spark, folder, "table_rows").groupBy("table_id").agg(F.countDistinct("row_idx").alias("rows_held"))
    c = table(spark, folder, "table_catalog").join(n, "table_id", "left")
    return c.select("table_id", D.table_entry(F.concat(F.lit("table "), F.col("table_id").cast("string")), F.coalesce("rows_held", F.lit(0)), F.array("title"), F.col("column_specs.header")).alias("entry"))


def section_blocks(spark, folder):
    """Blocks of the tagged pages of all blocks."""
    tag = F.when(F.col("type") == "list", "==LIST==").when(F.col("type") == "code", "==CODE==").when(F.col("type") == "equation", "==EQUATION==").when(F.col("type").isin("header", "number"), "==PARATEXT==").otherwise("==TEXT==")
    b = T.delivered(table(spark, folder, "blocks")).where("text is not null")
    md = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_id", F.concat_ws("\n", tag, "text").alias("t")))), lambda x: x["t"]), "\n")
    s = P.section_blocks(P.sections(b.groupBy("document_id", "page_idx").agg(md.alias("text")), ["document_id", "page_idx"]), ["document_id", "page_idx"])
    return s.select("document_id", "page_idx", "ordinal", "type", F.md5("text").alias("digest"))


def summary_budget(spark, folder):
    return table(spark, folder, "content_batches").select("batch_id", D.summary_budget(F.coalesce("content_tokens", F.lit(0))).alias("budget"))


def floor_fit(spark, folder):
    b = table(spark, folder, "content_batches")
    return D.fit(b, ["document_id"], ["batch_no", "batch_id"], "summary_tokens", "content_tokens", 1500).select("batch_id", F.col("floor_used").cast("bigint").alias("floor_used"), "share", "given")


def size_gate(spark, folder):
    return table(spark, folder, "content_batches").groupBy("document_id").agg((F.coalesce(F.sum("summary_tokens"), F.lit(0)) <= D.GATE).alias("fits"))


def inventory(spark, folder):
    d, b = table(spark, folder, "documents"), table(spark, folder, "content_batches")
    n = b.groupBy(F.col("document_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("sections"))
    return d.join(n, "doc_id", "left").select("doc_id", F.concat(F.coalesce("title", "filename", F.lit("?")), F.lit(" ("), F.coalesce("sections", F.lit(0)).cast("string"), F.lit(" sections)")).alias("entry"))


def table_labels(spark, folder):
    c = table(spark, folder, "table_catalog")
    n = F.count(F.lit(1)).over(Window.partitionBy("title"))
    k = F.row_number().over(Window.partitionBy("title").orderBy("table_id"))
    return c.select("table_id", F.when(n > 1, F.concat("title", F.lit(" #"), k.cast("string"))).otherwise(F.col("title")).alias("label"))


def citation_audit(spark, folder):
    """An answer per document that cites its title with a page, its file and its source; its title and source are known."""
    d = table(spark, folder, "documents").where("title is not null")
    page = F.concat(F.lit(" p"), (F.col("doc_id") % 9 + 1).cast("string"))
    said = F.concat(F.lit("As ["), "title", page, F.lit("] has it, and ["), F.coalesce("filename", F.lit("no file")), F.lit("], see ["), F.coalesce("source", F.lit("nowhere")), F.lit("] and ["), "title", F.lit("]."))
    made = D.fabricated(said, F.array("title", F.coalesce("source", F.lit("somewhere"))))
    return d.select("doc_id", F.array_join(made, "; ").alias("fabricated"))


def summary_upsert(spark, folder):
    """The first load of every content_id against its later ones."""
    first = Window.partitionBy("content_id").orderBy(F.asc_nulls_first("loaded_at"), "text")
    t = table(spark, folder, "block_texts").withColumn("load", F.row_number().over(first))
    return D.upsert(t.where("load = 1"), t.where("load > 1"), "content_id", "loaded_at").select("content_id", "loaded_at")


def latest_loads(spark, folder):
    return table(spark, folder, "block_texts").groupBy("content_id").agg(F.max("loaded_at").alias("loaded_at"), F.count(F.lit(1)).alias("loads"))


def image_dedup(spark, folder):
    """Document texts as pictures: equal ones are read once, and the reading goes to all of them."""
    d = table(spark, folder, "documents").where("text <> ''").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    read = images.read_once(d, lambda r: r.select("digest", F.octet_length("content").alias("n_bytes")))
    return read.select("doc_id", "digest", "n_bytes")


def document_summaries(spark, folder):
    b = table(spark, folder, "content_batches").where("summary is not null")
    return D.tree_reduce(b, ["document_id"], "batch_no", "summary", 600, D.extract_summary)


def markdown_export(spark, folder):
    return D.export_markdown(table(spark, folder, "content_nodes")).select("document_id", F.md5("markdown").alias("digest"))


def readiness(spark, folder):
    d, n, e = (table(spark, folder, t) for t in ("documents", "content_nodes", "node_embeddings"))
    unsummarised = d.join(table(spark, folder, "content_batches").where("summary is not null").select(F.col("document_id").alias("doc_id")).distinct(), "doc_id", "left_anti").groupBy("library_id").agg(F.count(F.lit(1)).alias("unsummarised"))
    waiting = R.pending(n, e).select("document_id").join(d.select(F.col("doc_id").alias("document_id"), "library_id"), "document_id").groupBy("library_id").agg(F.count(F.lit(1)).alias("waiting"))
    return d.select("library_id").distinct().join(unsummarised, "library_id", "left").join(waiting, "library_id", "left").fillna(0).withColumn("ready", (F.col("unsummarised") == 0) & (F.col("waiting") == 0))


def drained_libraries(spark, folder):
    return table(spark, folder, "documents").groupBy("library_id").agg((F.count_if(F.coalesce("status", F.lit("")).isin("queued", "processing")) == 0).alias("drained"))


_B = "b AS (SELECT * EXCLUDE (received_at) FROM blocks QUALIFY row_number() OVER (PARTITION BY block_id ORDER BY received_at) = 1)"
_G = f"WITH {_B}, g AS (SELECT * FROM b WHERE grid IS NOT NULL)"
_CELLS = _G + ", r AS (SELECT block_id, unnest(grid) AS r, unnest(range(0, len(grid))) AS row_idx FROM g), c AS (SELECT block_id, row_idx, unnest(range(0, len(r))) AS col, coalesce(unnest(r), '') AS value FROM r WHERE row_idx > 0)"
_NUM = "regexp_matches(regexp_replace(trim(value), '[,%]', '', 'g'), '^-?[0-9]+(\\.[0-9]+)?$')"
_DAY = "regexp_matches(trim(value), '^[0-9]{4}-[0-9]{2}-[0-9]{2}')"
_ROWS = "r AS (SELECT DISTINCT table_id, row_idx FROM table_rows), n AS (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY row_idx) - 1 AS rn, count(*) OVER (PARTITION BY table_id) AS n FROM r)"
_TRI = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({t}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
_SIM = "CASE WHEN len(list_distinct(list_concat(x, y))) > 0 THEN len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) ELSE 0 END"
_RANKED = "SELECT doc_id, s, row_number() OVER (ORDER BY s DESC, doc_id) AS place FROM (SELECT doc_id, {sim} AS s FROM (SELECT doc_id, {x} AS x, {y} AS y FROM documents WHERE title IS NOT NULL))"


def _ranked(q: str) -> str:
    return _RANKED.format(sim=_SIM, x=_TRI.format(t="title"), y=_TRI.format(t=f"'{q}'"))


_PACK = """RECURSIVE o AS (SELECT document_id, block_ordinal, content_id, coalesce(token_count, 0) AS t, row_number() OVER (PARTITION BY document_id ORDER BY block_ordinal, content_id) AS i FROM content_nodes WHERE block_ordinal IS NOT NULL),
    p AS (SELECT document_id, content_id, block_ordinal, i, CAST(t AS BIGINT) AS t, CAST(t AS BIGINT) AS used, 0 AS bin FROM o WHERE i = 1
      UNION ALL SELECT o.document_id, o.content_id, o.block_ordinal, o.i, o.t, CASE WHEN p.used > 0 AND p.used + o.t > 512 THEN o.t ELSE p.used + o.t END, p.bin + CASE WHEN p.used > 0 AND p.used + o.t > 512 THEN 1 ELSE 0 END FROM p JOIN o ON o.document_id = p.document_id AND o.i = p.i + 1)"""
_PAGES = _B + """, t AS (SELECT document_id, page_idx, block_id, CASE type WHEN 'list' THEN '==LIST==' WHEN 'code' THEN '==CODE==' WHEN 'equation' THEN '==EQUATION==' WHEN 'header' THEN '==PARATEXT==' WHEN 'number' THEN '==PARATEXT==' ELSE '==TEXT==' END || chr(10) || text AS t FROM b WHERE text IS NOT NULL),
    p AS (SELECT document_id, page_idx, string_split(string_agg(t, chr(10) ORDER BY block_id), chr(10)) AS l FROM t GROUP BY 1, 2), l AS (SELECT document_id, page_idx, unnest(l) AS line, unnest(range(0, len(l))) AS i FROM p),
    f AS (SELECT *, sum(CASE WHEN starts_with(line, '```') THEN 1 ELSE 0 END) OVER w AS fences FROM l WINDOW w AS (PARTITION BY document_id, page_idx ORDER BY i ROWS UNBOUNDED PRECEDING)),
    o AS (SELECT *, CASE WHEN NOT starts_with(line, '```') AND fences % 2 = 0 THEN nullif(regexp_extract(line, '^\\s*==(TEXT|EXTRA|LIST|TABLE|FORM|CODE|EQUATION|VISUAL|PARATEXT)==\\s*$', 1), '') END AS own FROM f),
    s AS (SELECT *, coalesce(last_value(own IGNORE NULLS) OVER w, 'TEXT') AS tag, count(own) OVER w AS section FROM o WINDOW w AS (PARTITION BY document_id, page_idx ORDER BY i ROWS UNBOUNDED PRECEDING)),
    c AS (SELECT document_id, page_idx, section, tag, string_agg(line, chr(10) ORDER BY i) AS content FROM s WHERE own IS NULL GROUP BY 1, 2, 3, 4)"""
_REGIONS = "t AS (SELECT document_id AS region_id, CAST(batch_no AS INT) AS table_no, CAST(start_block_ordinal AS INT) AS data_start, CAST(end_block_ordinal + 3 AS INT) AS data_end, CAST(batch_no % 2 AS INT) AS col_start, CAST(batch_no % 2 + 2 AS INT) AS col_end FROM content_batches WHERE start_block_ordinal IS NOT NULL)"
SQL = {
    "transpose_grid": _G + ", w AS (SELECT block_id, grid, list_max(list_transform(grid, lambda r: len(r))) AS w FROM g) SELECT block_id, array_to_string(list_transform(range(1, w + 1), lambda i: array_to_string(list_transform(grid, lambda r: coalesce(r[i], '')), '|')), chr(10)) AS flat FROM w",
    "header_naming": _G + ", w AS (SELECT block_id, grid[1] AS h, list_max(list_transform(grid, lambda r: len(r))) AS w FROM g) SELECT block_id, array_to_string(list_transform(range(1, w + 1), lambda i: CASE WHEN trim(coalesce(h[i], '')) = '' OR regexp_matches(trim(h[i]), '^-?[0-9]+\\.[0-9]+$') THEN 'col' || CAST(i - 1 AS VARCHAR) ELSE trim(h[i]) END), '|') AS names FROM w",
    "materialised_rows": _G + " SELECT block_id, CAST(len(list_filter(grid[2:], lambda r: len(list_filter(r, lambda c: trim(coalesce(c, '')) <> '')) > 0)) AS BIGINT) AS n_rows FROM g",
    "stride_sample": f"WITH {_ROWS} SELECT table_id, row_idx FROM n WHERE n <= 10 OR list_contains(list_transform(range(0, 10), lambda i: i * n // 10), rn)",
    "stratified_sample": f"WITH {_ROWS} SELECT table_id, row_idx FROM n WHERE rn < 4 OR rn >= n - 2 OR ((rn - 4) % greatest(25, CAST(ceil((n - 6) / 14) AS BIGINT)) = 0 AND rn >= 4)",
    "column_kinds": _CELLS + f", k AS (SELECT block_id, col, CASE WHEN {_NUM} THEN 'number' WHEN {_DAY} THEN 'date' ELSE 'text' END AS kind, count(*) AS n, min(row_idx) AS f FROM c WHERE trim(value) <> '' GROUP BY ALL) SELECT block_id, CAST(col AS INT) AS col, arg_max(kind, (n, -f)) AS kind FROM k GROUP BY 1, 2",
    "conformance_runs": _CELLS + f""", k AS (SELECT *, CASE WHEN trim(value) = '' THEN NULL WHEN {_NUM} THEN 'n' WHEN {_DAY} THEN 't' ELSE 's' END AS cls FROM c),
        f AS (SELECT *, first_value(cls IGNORE NULLS) OVER (PARTITION BY block_id, col ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS ref FROM k),
        s AS (SELECT *, CASE WHEN cls IS NULL THEN 'blank' WHEN cls = ref THEN 'match' ELSE 'differ' END AS state FROM f),
        o AS (SELECT *, CASE WHEN state = lag(state) OVER (PARTITION BY block_id, col ORDER BY row_idx) THEN 0 ELSE 1 END AS opens FROM s),
        u AS (SELECT *, sum(opens) OVER (PARTITION BY block_id, col ORDER BY row_idx ROWS UNBOUNDED PRECEDING) AS run FROM o)
        SELECT block_id, CAST(col AS INT) AS col, CAST(run AS INT) AS run, state, CAST(min(row_idx) AS INT) AS from_row, CAST(max(row_idx) AS INT) AS to_row, count(*) AS n FROM u GROUP BY block_id, col, run, state""",
    "unpivot_crosstab": "SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem WHERE l_linestatus IN ('F', 'O') GROUP BY 1, 2",
    "pivot_crosstab": "SELECT o_orderpriority, nullif(count(*) FILTER (WHERE o_orderstatus = 'F'), 0) AS F, nullif(count(*) FILTER (WHERE o_orderstatus = 'O'), 0) AS O, nullif(count(*) FILTER (WHERE o_orderstatus = 'P'), 0) AS P FROM orders GROUP BY 1",
    "claimed_regions": f"""WITH RECURSIVE {_REGIONS}, o AS (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY data_start, table_no, data_end, col_start, col_end) AS i FROM t),
        r AS (SELECT DISTINCT region_id, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(table_no INT, data_start INT, data_end INT, col_start INT, col_end INT)[]) AS done FROM t
          UNION ALL SELECT region_id, i, CASE WHEN s < data_end THEN list_append(done, {{'table_no': table_no, 'data_start': s, 'data_end': data_end, 'col_start': col_start, 'col_end': col_end}}) ELSE done END FROM (
            SELECT o.*, r.done, greatest(o.data_start, coalesce(list_max(list_transform(list_filter(r.done, lambda d: d.col_start < o.col_end AND o.col_start < d.col_end), lambda d: d.data_end)), 0)) AS s FROM r JOIN o ON o.region_id = r.region_id AND o.i = r.i + 1)),
        l AS (SELECT region_id, unnest(arg_max(done, i)) AS d FROM r GROUP BY 1) SELECT region_id, d.table_no, d.data_start, d.data_end, d.col_start, d.col_end FROM l""",
    "region_overlaps": f"WITH {_REGIONS} SELECT a.region_id, a.table_no AS first_no, b.table_no AS second_no FROM t a JOIN t b ON a.region_id = b.region_id AND a.table_no < b.table_no AND a.data_start < b.data_end AND b.data_start < a.data_end AND a.col_start < b.col_end AND b.col_start < a.col_end",
    "transposed_tables": _G + """, w AS (SELECT block_id, grid, list_max(list_transform(grid, lambda r: len(r))) AS w FROM g),
        x AS (SELECT block_id, list_transform(range(1, w + 1), lambda i: list_transform(grid, lambda r: coalesce(r[i], ''))) AS t, len(grid) AS n FROM w),
        y AS (SELECT block_id, n, t[1] AS h, list_filter(t[2:], lambda r: len(list_filter(r, lambda c: trim(c) <> '')) > 0) AS b FROM x)
        SELECT block_id, array_to_string(list_transform(range(1, n + 1), lambda i: CASE WHEN trim(coalesce(h[i], '')) = '' OR regexp_matches(trim(h[i]), '^-?[0-9]+\\.[0-9]+$') THEN 'col' || CAST(i - 1 AS VARCHAR) ELSE trim(h[i]) END), '|') AS names,
          md5(coalesce(array_to_string(list_transform(b, lambda r: array_to_string(r, '|')), chr(10)), '')) AS digest, CAST(len(b) AS BIGINT) AS n_rows FROM y""",
    "number_cells": _CELLS + " SELECT block_id, count(*) AS n FROM c WHERE regexp_matches(regexp_replace(trim(value), '[,%]', '', 'g'), '^[-+]?[0-9]+(\\.[0-9]+)?([eE][-+]?[0-9]+)?$') GROUP BY 1",
    "tag_split": f"WITH {_PAGES} SELECT document_id, page_idx, tag, count(*) AS sections, CAST(sum(length(content)) AS BIGINT) AS chars FROM c WHERE trim(content, ' ') <> '' GROUP BY 1, 2, 3",
    "think_strip": "SELECT doc_id, md5(text || '!') AS digest FROM documents WHERE text IS NOT NULL",
    "fence_strip": "SELECT doc_id, md5(CASE WHEN len(regexp_extract_all(text, '(?m)^```')) % 2 = 0 THEN text ELSE '```markdown' || chr(10) || text || chr(10) || '```' END) AS digest FROM documents WHERE text IS NOT NULL",
    "paragraphs": "SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\\n[ \\t\\r]*\\n')) AS p FROM documents WHERE text IS NOT NULL) WHERE regexp_replace(p, '^\\s+|\\s+$', '', 'g') <> '' GROUP BY 1",
    "json_shred": "SELECT event_id, unnest(json_keys(props)) AS key, props ->> ('$.' || unnest(json_keys(props))) AS value FROM events",
    "json_entities": """WITH j AS (SELECT content_id, from_json(raw, '{"items":[{"ordinal":"INTEGER","content":"VARCHAR","depth":"INTEGER"}]}') AS r FROM content_nodes WHERE type = 'list' AND raw IS NOT NULL),
        x AS (SELECT content_id, unnest(r.items) AS i, unnest(range(0, len(r.items))) AS n FROM j) SELECT content_id, CAST(n AS INT) AS item, i.ordinal AS ordinal, i.content AS content, i.depth AS depth FROM x""",
    "dense_rank_vec": "SELECT a.vec_id, round(list_cosine_similarity(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE)), list_transform(q.embedding, lambda x: CAST(x AS DOUBLE))), 6) AS similarity FROM embeddings a, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) q WHERE a.embedding IS NOT NULL",
    "trigram_rank": f"SELECT doc_id, round(s, 6) AS similarity FROM ({_ranked('Harbour Journal 2010')})",
    "trigram_top": f"SELECT doc_id, round(s, 6) AS similarity FROM ({_ranked('Harbour Journal 2010')}) WHERE place <= 20",
    "rrf_fuse": f"SELECT doc_id, round(sum(1.0 / (60 + place)), 9) AS score FROM ({_ranked('Harbour Journal 2010')} UNION ALL {_ranked('Tariff Report')}) GROUP BY doc_id",
    "pending_embeddings": "SELECT content_id FROM content_nodes WHERE search_text IS NOT NULL AND content_id NOT IN (SELECT content_id FROM node_embeddings)",
    "token_counts": "SELECT doc_id, CAST(coalesce(len(regexp_extract_all(text, '[\\p{L}\\p{N}]+|[^\\s\\p{L}\\p{N}]')), 0) AS BIGINT) AS n FROM documents",
    "greedy_pack": f"WITH {_PACK} SELECT content_id, bin FROM p",
    "batch_spec": f"WITH {_PACK} SELECT document_id, bin, min(block_ordinal) AS start_ordinal, max(block_ordinal) AS end_ordinal, CAST(sum(t) AS BIGINT) AS content_tokens FROM p GROUP BY 1, 2",
    "summary_budget": "SELECT batch_id, CAST(least(floor(coalesce(content_tokens, 0) * 0.1), 2048) AS INT) AS budget FROM content_batches",
    "floor_fit": """WITH x AS (SELECT *, sum(coalesce(summary_tokens, 0)) OVER (PARTITION BY document_id ORDER BY batch_no, batch_id ROWS UNBOUNDED PRECEDING) AS f FROM content_batches), k AS (SELECT * FROM x WHERE f <= 1500),
        s AS (SELECT *, CAST(floor((1500 - max(f) OVER (PARTITION BY document_id)) / count(*) OVER (PARTITION BY document_id)) AS BIGINT) AS share FROM k)
        SELECT batch_id, CAST(f AS BIGINT) AS floor_used, share, least(share, CAST(coalesce(content_tokens, 0) AS BIGINT)) AS given FROM s""",
    "size_gate": "SELECT document_id, coalesce(sum(summary_tokens), 0) <= 22528 AS fits FROM content_batches GROUP BY 1",
    "inventory": "SELECT d.doc_id, coalesce(title, filename, '?') || ' (' || coalesce(n, 0) || ' sections)' AS entry FROM documents d LEFT JOIN (SELECT document_id, count(*) AS n FROM content_batches GROUP BY 1) b ON d.doc_id = b.document_id",
    "table_labels": "SELECT table_id, CASE WHEN count(*) OVER (PARTITION BY title) > 1 THEN title || ' #' || row_number() OVER (PARTITION BY title ORDER BY table_id) ELSE title END AS label FROM table_catalog",
    "citation_audit": """WITH c AS (SELECT doc_id, title, coalesce(source, 'somewhere') AS known, coalesce(filename, 'no file') AS f, coalesce(source, 'nowhere') AS s FROM documents WHERE title IS NOT NULL),
        n AS (SELECT *, list_filter([regexp_replace(trim(title || ' p' || (doc_id % 9 + 1)), '\\s+p\\.?[0-9]+$', ''), regexp_replace(trim(f), '\\s+p\\.?[0-9]+$', ''), regexp_replace(trim(s), '\\s+p\\.?[0-9]+$', '')], lambda x: x <> title AND x <> known) AS bad FROM c)
        SELECT doc_id, array_to_string(CASE WHEN len(bad) = 2 AND bad[1] = bad[2] THEN bad[1:1] ELSE bad END, '; ') AS fabricated FROM n""",
    "meta_strip": """SELECT doc_id, md5('The image shows a harbour.' || chr(10) || array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT (trim(x, ' ') = '---'
        OR regexp_matches(trim(x, ' '), '(?i)^here is the (content|text|transcription)\\b') OR regexp_matches(trim(x, ' '), '(?i)^this transcription includes\\b') OR regexp_matches(trim(x, ' '), '(?i)^i (cannot|can''t|am unable to)\\b')
        OR regexp_matches(trim(x, ' '), '(?i)^the (provided )?image (is|appears)\\b.*(blank|empty)') OR regexp_matches(trim(x, ' '), '(?i)^there is no (visible )?(text|content)\\b') OR regexp_matches(trim(x, ' '), '(?i)^therefore,.*(cannot|no markdown|no table)\\b'))), chr(10))) AS digest FROM documents WHERE text IS NOT NULL""",
    "summary_upsert": "SELECT content_id, max(loaded_at) AS loaded_at FROM block_texts GROUP BY 1",
    "plain_markdown": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL),
        k AS (SELECT *, CASE WHEN trim(line, ' ') = '' THEN 'blank' WHEN regexp_matches(line, '^#{1,6} \\S') THEN 'title' WHEN starts_with(trim(line, ' '), '|') THEN 'table' ELSE 'text' END AS kind FROM l),
        o AS (SELECT *, CASE WHEN kind = 'title' OR lag(kind) OVER w IS DISTINCT FROM kind THEN 1 ELSE 0 END AS opens FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY i)), g AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS island FROM o),
        b AS (SELECT doc_id, island, kind, count(*) AS n, length(string_agg(regexp_replace(line, '^#+ ', ''), chr(10) ORDER BY i)) AS chars FROM g WHERE kind <> 'blank' GROUP BY 1, 2, 3)
        SELECT doc_id, kind, count(*) AS n, CAST(sum(n) AS BIGINT) AS lines, CAST(sum(chars) AS BIGINT) AS chars FROM b GROUP BY 1, 2""",
    "markdown_export": """WITH p AS (SELECT document_id, content_id, ordinal, coalesce(page_no, sheet_no) AS page, CASE WHEN type = 'title' THEN NULL ELSE heading END AS heading, CASE type
          WHEN 'list' THEN array_to_string(list_transform(from_json(raw, '{"items":[{"content":"VARCHAR","depth":"INTEGER"}]}').items, lambda i: repeat('  ', coalesce(i.depth, 0)) || '- ' || coalesce(i.content, '')), chr(10))
          WHEN 'code' THEN '```' || chr(10) || (raw ->> '$.text') || chr(10) || '```' WHEN 'equation' THEN '$$' || chr(10) || latex || chr(10) || '$$' WHEN 'title' THEN '## ' || (raw ->> '$.text') WHEN 'table' THEN replace(search_text, '|', '\\|') ELSE raw ->> '$.text' END AS md FROM content_nodes),
        n AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page, ordinal, content_id) AS place FROM p), c AS (SELECT *, heading IS NOT NULL AND lag(heading) OVER (PARTITION BY document_id ORDER BY place) IS DISTINCT FROM heading AS changed FROM n),
        m AS (SELECT document_id, place, concat_ws(chr(10) || chr(10), CASE WHEN changed THEN '## ' || heading END, md) AS md FROM c) SELECT document_id, md5(string_agg(md, chr(10) || chr(10) ORDER BY place)) AS digest FROM m GROUP BY 1""",
    "latest_loads": "SELECT content_id, max(loaded_at) AS loaded_at, count(*) AS loads FROM block_texts GROUP BY 1",
    "image_dedup": "SELECT doc_id, sha256(text) AS digest, strlen(text) AS n_bytes FROM documents WHERE text <> ''",
    "batch_texts": f"WITH {_PACK} SELECT p.document_id, bin, min(p.block_ordinal) AS start_ordinal, max(p.block_ordinal) AS end_ordinal, min(page_no) AS start_page, max(page_no) AS end_page, CAST(sum(t) AS BIGINT) AS content_tokens, md5(string_agg(coalesce(search_text, ''), chr(10) || chr(10) ORDER BY p.block_ordinal, p.content_id)) AS digest FROM p JOIN content_nodes n ON p.content_id = n.content_id GROUP BY 1, 2",
    "batch_entries": "SELECT batch_id, 'batch — ' || coalesce(filename, '?') || CASE WHEN start_page_no IS NULL THEN '' WHEN coalesce(end_page_no, 0) <> 0 AND end_page_no <> start_page_no THEN ' p' || start_page_no || '-p' || end_page_no ELSE ' p' || start_page_no END || ': ' || summary AS entry FROM content_batches JOIN documents ON document_id = doc_id WHERE summary IS NOT NULL",
    "table_entries": "SELECT table_id, 'table — table ' || table_id || ' rows=' || coalesce(n, 0) || ': ' || CASE WHEN coalesce(title, '') <> '' THEN title || '. ' ELSE '' END || 'columns ' || array_to_string(list_transform(column_specs, lambda c: CASE WHEN coalesce(c.header, '') = '' THEN '?' ELSE c.header END), ', ') AS entry FROM table_catalog LEFT JOIN (SELECT table_id, count(DISTINCT row_idx) AS n FROM table_rows GROUP BY 1) USING (table_id)",
    "section_blocks": f"""WITH {_PAGES}, x AS (SELECT *, CASE tag WHEN 'LIST' THEN string_split(content, chr(10)) WHEN 'CODE' THEN [content] ELSE regexp_split_to_array(content, '\\n\\s*\\n') END AS parts FROM c WHERE trim(content, ' ') <> ''),
        y AS (SELECT document_id, page_idx, section, tag, unnest(list_filter(CASE tag WHEN 'CODE' THEN parts ELSE list_transform(parts, lambda q: regexp_replace(q, '^\\s+|\\s+$', '', 'g')) END, lambda q: q <> '')) AS t, unnest(range(0, len(list_filter(CASE tag WHEN 'CODE' THEN parts ELSE list_transform(parts, lambda q: regexp_replace(q, '^\\s+|\\s+$', '', 'g')) END, lambda q: q <> '')))) AS k FROM x)
        SELECT document_id, page_idx, CAST(row_number() OVER (PARTITION BY document_id, page_idx ORDER BY section, k) - 1 AS INT) AS ordinal, CASE tag WHEN 'LIST' THEN 'list_item' WHEN 'CODE' THEN 'code' WHEN 'EQUATION' THEN 'equation' WHEN 'PARATEXT' THEN 'header' WHEN 'VISUAL' THEN 'image' ELSE 'text' END AS type, md5(t) AS digest FROM y""",
    "readiness": """WITH u AS (SELECT library_id, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT document_id FROM content_batches WHERE summary IS NOT NULL) GROUP BY 1),
        w AS (SELECT d.library_id, count(*) AS n FROM content_nodes c JOIN documents d ON c.document_id = d.doc_id WHERE search_text IS NOT NULL AND content_id NOT IN (SELECT content_id FROM node_embeddings) GROUP BY 1)
        SELECT l.library_id, coalesce(u.n, 0) AS unsummarised, coalesce(w.n, 0) AS waiting, coalesce(u.n, 0) = 0 AND coalesce(w.n, 0) = 0 AS ready FROM (SELECT DISTINCT library_id FROM documents) l LEFT JOIN u ON l.library_id = u.library_id LEFT JOIN w ON l.library_id = w.library_id""",
    "drained_libraries": "SELECT library_id, count(*) FILTER (WHERE status IN ('queued', 'processing')) = 0 AS drained FROM documents GROUP BY 1",
}
_NAMES = [*SQL, "document_summaries"]
QUERIES = {n: globals()[n] for n in _NAMES}
