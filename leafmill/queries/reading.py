"""Queries of the structure and embedding operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dtypes
from ..operators import embedding as E
from ..operators import structure as S
from ..session import table
from .shapes import _CELLS, _cells, _grids


def budget_sample(spark, folder):
    rows = table(spark, folder, "table_rows").dropDuplicates(["table_id", "row_idx"]).select("table_id", "row_idx", F.coalesce("values_text", F.lit("")).alias("v"))
    return S.budget_sample(rows, ["table_id"], "row_idx", "v", 2048).select("table_id", "row_idx")


def clamped_entries(spark, folder):
    """Entries whose bounds differ from block to block, mostly outside the grid."""
    k = F.col("block_id")
    e = _grids(spark, folder).select("block_id", "grid", (k % 5 - 2).cast("int").alias("data_start"), (k % 7 * 3 + 1).cast("int").alias("data_end"), (k % 3).cast("int").alias("col_start"), (k % 11).cast("int").alias("col_end"), F.array(F.lit(0), F.lit(2), F.lit(500)).alias("metadata_rows"), F.array((k % 4).cast("int"), F.lit(70)).alias("header_rows"))
    c = S.clamp(e)
    return c.select("block_id", "data_start", "data_end", "col_start", "col_end", F.size("metadata_rows").cast("int").alias("meta"), F.size("header_rows").cast("int").alias("heads"), S.title_of(F.col("grid"), F.lit(0)).alias("title"))


def table_anchors(spark, folder):
    """Tables at places that differ from block to block."""
    k, n = F.col("block_id"), F.size("grid")
    start = F.least((k % 3 + 1).cast("int"), n)
    a = S.anchors((k % 6).cast("int"), (k % 4).cast("int"), start, n, (k % 2).cast("int"), F.size(F.element_at("grid", 1)), F.array((k % 3).cast("int")))
    return _grids(spark, folder).select("block_id", a.alias("a")).select("block_id", "a.min_row", "a.max_row", "a.min_col", "a.max_col", F.col("a.header_rows")[0].alias("header_row"))


def schema_runs(spark, folder):
    return S.schema_runs(S.row_profile(_cells(spark, folder), ["block_id"]), ["block_id"]).select("block_id", F.col("run").cast("int").alias("run"), "profile", "from_row", "to_row")


def uncovered_rows(spark, folder):
    """Rows of grids that two tables in each leave out: up to two at the start, one between them, up to two at the end."""
    g = _grids(spark, folder).select(F.col("block_id").alias("region_id"), F.size("grid").alias("n_rows"))
    middle = F.floor(F.col("n_rows") / 2).cast("int")
    upper = g.select("region_id", (F.col("region_id") % 3).cast("int").alias("data_start"), middle.alias("data_end"))
    lower = g.select("region_id", (middle + 1).alias("data_start"), (F.col("n_rows") - F.col("region_id") % 3).cast("int").alias("data_end"))
    return S.uncovered(g, upper.unionByName(lower).where("data_start < data_end"))


def fragment_join(spark, folder):
    f = _grids(spark, folder).select("document_id", F.size("grid").cast("bigint").alias("n_rows"), F.col("page_idx").alias("min_row"), F.col("page_idx").alias("max_row"))
    return S.join_fragments(f, ["document_id"])


def fragment_rows(spark, folder):
    """A document's grids as fragments of one table: all their rows in order under the first one's header."""
    f = _grids(spark, folder).select("document_id", "page_idx", "block_id", "grid")
    return S.union_fragments(f, ["document_id"], ["page_idx", "block_id"]).select("document_id", F.array_join("header", "|").alias("header"), "row_idx", F.array_join("values", "|").alias("line"))


def extended_tables(spark, folder):
    """Tables of one row, extended down over rows of its profile."""
    profiles = S.row_profile(_cells(spark, folder), ["block_id"]).withColumnRenamed("block_id", "region_id")
    t = profiles.groupBy("region_id").agg(F.min("row_idx").alias("data_start")).select("region_id", F.lit(0).alias("table_no"), "data_start", (F.col("data_start") + 1).alias("data_end"))
    return S.conforming_extent(profiles, t)


def structured_tables(spark, folder):
    """What the rule model finds in every grid, shown whole: the header row, and the data below it."""
    return S.structured(_grids(spark, folder), budget=1 << 20).select("block_id", "table_no", "data_start", "data_end", "col_start", "col_end", F.col("header_rows")[0].alias("header_row"))


def inferred_types(spark, folder):
    """Inferred type of every column of every grid."""
    return dtypes.infer(_cells(spark, folder), ["block_id", "col"]).select("block_id", "col", "dtype")


def token_truncate(spark, folder):
    d = table(spark, folder, "documents").where("text is not null")
    return d.select("doc_id", F.md5(E.truncate(F.col("text"), 40)).alias("digest"))


def source_passages(spark, folder):
    return E.passages(table(spark, folder, "block_texts"), table(spark, folder, "documents")).select("content_id", F.md5("passage").alias("digest"))


def embed_pending(spark, folder):
    return E.embed(table(spark, folder, "content_nodes"), table(spark, folder, "node_embeddings"))


_B = "b AS (SELECT * EXCLUDE (received_at) FROM blocks QUALIFY row_number() OVER (PARTITION BY block_id ORDER BY received_at) = 1)"
_G = f"WITH {_B}, g AS (SELECT *, list_max(list_transform(grid, lambda r: len(r))) AS w FROM b WHERE grid IS NOT NULL)"
_TOK = "[\\p{L}\\p{N}]+|[^\\s\\p{L}\\p{N}]"
SQL = {
    "budget_sample": f"""WITH r AS (SELECT DISTINCT table_id, row_idx, coalesce(values_text, '') AS v FROM table_rows), t AS (SELECT *, len(regexp_extract_all(v, '{_TOK}')) AS t FROM r),
        n AS (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY row_idx) - 1 AS rn, count(*) OVER (PARTITION BY table_id) AS n, sum(t) OVER (PARTITION BY table_id) AS s FROM t)
        SELECT table_id, row_idx FROM n WHERE (s <= 2048 AND n <= 50) OR rn = 0 OR rn = n - 1 OR rn % CAST(greatest(1, ceil(n / greatest(least(50, floor(2048.0 * n / greatest(s, 1))), 1))) AS BIGINT) = 0""",
    "clamped_entries": _G + """, e AS (SELECT *, len(grid) AS n, greatest(0, least(block_id % 5 - 2, len(grid))) AS ds, least(block_id % 3, w) AS cs FROM g), f AS (SELECT *, greatest(ds, least(block_id % 7 * 3 + 1, n)) AS de FROM e)
        SELECT block_id, CAST(ds AS INT) AS data_start, CAST(de AS INT) AS data_end, CAST(cs AS INT) AS col_start, CAST(greatest(cs, least(block_id % 11, w)) AS INT) AS col_end,
        CAST(len(list_filter([0, 2, 500], lambda r: r >= ds AND r < de)) AS INT) AS meta, CAST(len(list_filter([block_id % 4, 70], lambda r: r < n)) AS INT) AS heads, (SELECT string_agg(c, ' ' ORDER BY i) FROM (SELECT c, min(i) AS i FROM (SELECT unnest(list_transform(grid[1], lambda c: trim(coalesce(c, '')))) AS c, unnest(range(0, len(grid[1]))) AS i) WHERE c <> '' GROUP BY c)) AS title FROM f""",
    "table_anchors": _G + """ SELECT block_id, CAST(block_id % 6 + least(least(block_id % 3 + 1, len(grid)), block_id % 3) AS INT) AS min_row, CAST(block_id % 6 + len(grid) - 1 AS INT) AS max_row, CAST(block_id % 4 + block_id % 2 AS INT) AS min_col,
        CAST(block_id % 4 + len(grid[1]) - 1 AS INT) AS max_col, CAST(block_id % 6 + block_id % 3 AS INT) AS header_row FROM g""",
    "fragment_rows": _G + """, f AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page_idx, block_id) AS k, first_value(grid[1]) OVER (PARTITION BY document_id ORDER BY page_idx, block_id) AS header FROM g WHERE len(grid) > 0),
        r AS (SELECT document_id, header, k, unnest(grid) AS v, unnest(range(0, len(grid))) AS i FROM f), s AS (SELECT * FROM r WHERE NOT (i = 0 AND (k = 1 OR v = header)))
        SELECT document_id, array_to_string(header, '|') AS header, row_number() OVER (PARTITION BY document_id ORDER BY k, i) - 1 AS row_idx, array_to_string(list_transform(range(1, len(header) + 1), lambda j: coalesce(v[j], '')), '|') AS line FROM s""",
    "extended_tables": _CELLS + """, k AS (SELECT block_id, row_idx, string_agg(CASE WHEN trim(value) = '' THEN '_' WHEN regexp_matches(trim(value), '(?i)^(true|false|yes|no)$') THEN 'b' WHEN regexp_matches(regexp_replace(trim(value), '[,%]', '', 'g'), '^[-+]?[0-9]+(\\.[0-9]+)?([eE][-+]?[0-9]+)?$') THEN 'n' WHEN regexp_matches(trim(value), '^[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN 't' ELSE 's' END, '' ORDER BY col) AS profile FROM c GROUP BY 1, 2),
        f AS (SELECT block_id, min(row_idx) AS s, arg_min(profile, row_idx) AS p, max(row_idx) + 1 AS n FROM k GROUP BY 1),
        x AS (SELECT f.block_id, min(row_idx) AS stop FROM k JOIN f USING (block_id) WHERE row_idx >= s + 1 AND (length(profile) <> length(p) OR len(list_filter(range(1, length(p) + 1), lambda i: profile[i] <> '_' AND p[i] <> '_' AND profile[i] <> p[i])) > 0) GROUP BY 1)
        SELECT f.block_id AS region_id, 0 AS table_no, CAST(s AS INT) AS data_start, CAST(greatest(s + 1, coalesce(stop, n)) AS INT) AS data_end FROM f LEFT JOIN x USING (block_id)""",
    "structured_tables": _G + """, h AS (SELECT *, list_transform(grid[1:8], lambda r: len(list_filter(r, lambda c: trim(coalesce(c, '')) <> '')) > 1 AND len(list_filter(r, lambda c: regexp_matches(trim(coalesce(c, '')), '^-?[0-9,%]*[.]?[0-9,%]*$') AND regexp_matches(coalesce(c, ''), '[0-9]'))) = 0) AS ok FROM g WHERE len(grid) > 0),
        p AS (SELECT *, coalesce(list_position(ok, true), 0) AS found FROM h), q AS (SELECT *, CASE WHEN found > 0 THEN found - 1 ELSE 0 END AS head FROM p)
        SELECT block_id, 0 AS table_no, CAST(head + 1 AS INT) AS data_start, CAST(len(grid) AS INT) AS data_end, 0 AS col_start, CAST(w AS INT) AS col_end, CAST(head AS INT) AS header_row FROM q WHERE head + 1 < len(grid)""",
    "inferred_types": _CELLS + """, v AS (SELECT block_id, col, nullif(value, '') AS v FROM c), f AS (SELECT *, regexp_matches(v, '^-?[0-9]+$') AND CAST(try_cast(v AS BIGINT) AS VARCHAR) IS NOT DISTINCT FROM v AS i, regexp_matches(v, '^-?(0|[1-9][0-9]*)[.][0-9]+$') AS d, regexp_matches(v, '^-?[0-9]+([.][0-9]+)?[eE][-+]?[0-9]+$') AS e, v IN ('True', 'False') AS b,
          regexp_matches(v, '^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]{1,6})?)?)?$') AND try_cast(replace(v, 'T', ' ') AS TIMESTAMP) IS NOT NULL AS t, regexp_matches(v, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') OR regexp_matches(v, '^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ]00:00(:00([.]0+)?)?$') AS m FROM v)
        SELECT block_id, CAST(col AS INT) AS col, CASE WHEN count(v) = 0 THEN 'string' WHEN bool_and(i) THEN 'integer' WHEN bool_and(i OR d) THEN 'decimal' WHEN bool_and(i OR d OR e) THEN 'float' WHEN bool_and(b) THEN 'boolean' WHEN bool_and(t) AND bool_and(m) THEN 'date' WHEN bool_and(t) THEN 'datetime' ELSE 'string' END AS dtype FROM f GROUP BY 1, 2""",
    "token_truncate": f"SELECT doc_id, md5(CASE WHEN len(regexp_extract_all(text, '\\s*({_TOK})')) > 40 THEN array_to_string(regexp_extract_all(text, '\\s*({_TOK})')[1:40], '') ELSE text END) AS digest FROM documents WHERE text IS NOT NULL",
    "schema_runs": _CELLS + """, k AS (SELECT block_id, row_idx, string_agg(CASE WHEN trim(value) = '' THEN '_' WHEN regexp_matches(trim(value), '(?i)^(true|false|yes|no)$') THEN 'b' WHEN regexp_matches(regexp_replace(trim(value), '[,%]', '', 'g'), '^[-+]?[0-9]+(\\.[0-9]+)?([eE][-+]?[0-9]+)?$') THEN 'n' WHEN regexp_matches(trim(value), '^[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN 't' ELSE 's' END, '' ORDER BY col) AS profile FROM c GROUP BY 1, 2),
        o AS (SELECT *, CASE WHEN profile = lag(profile) OVER (PARTITION BY block_id ORDER BY row_idx) THEN 0 ELSE 1 END AS opens FROM k), u AS (SELECT *, sum(opens) OVER (PARTITION BY block_id ORDER BY row_idx ROWS UNBOUNDED PRECEDING) AS run FROM o)
        SELECT block_id, CAST(run AS INT) AS run, profile, CAST(min(row_idx) AS INT) AS from_row, CAST(max(row_idx) AS INT) AS to_row FROM u GROUP BY block_id, run, profile""",
    "uncovered_rows": _G + """, r AS (SELECT block_id, len(grid) AS n, unnest(range(0, len(grid))) AS i FROM g) SELECT block_id AS region_id, CAST(i AS INT) AS row_idx FROM r WHERE NOT (i >= block_id % 3 AND i < n // 2) AND NOT (i >= n // 2 + 1 AND i < n - block_id % 3)""",
    "fragment_join": _G + " SELECT document_id, CAST(sum(len(grid)) AS BIGINT) AS n_rows, min(page_idx) AS min_row, max(page_idx) AS max_row, count(*) AS fragments FROM g GROUP BY 1",
    "source_passages": "SELECT content_id, md5('[' || coalesce(filename, '?') || CASE WHEN page_no IS NOT NULL THEN ' p' || page_no ELSE '' END || '] ' || coalesce(b.text, '')) AS digest FROM block_texts b JOIN documents d ON b.document_id = d.doc_id",
}
_NAMES = [*SQL, "embed_pending"]
QUERIES = {n: globals()[n] for n in _NAMES}
