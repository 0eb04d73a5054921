"""Queries of the tree operators over blocks, nodes and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tree as T
from ..session import table


def _blocks(spark, folder):
    return T.delivered(table(spark, folder, "blocks"))


def collapse_loops(spark, folder):
    """Every document written three times over: each long line of it is a loop."""
    d = table(spark, folder, "documents").where("text is not null")
    return T.collapse_loops(d.withColumn("text", F.concat_ws("\n", "text", "text", "text"))).select("doc_id", "n_looped", F.md5("collapsed").alias("digest"))


def collapse_blocks(spark, folder):
    """Blocks with repeats dropped, tables left alone."""
    b = T.collapse_blocks(_blocks(spark, folder).withColumn("text", F.concat_ws("\\\\", "text", "text", "text")))
    return b.select("block_id", F.md5("text").alias("digest"))


def paratext_keys(spark, folder):
    return _blocks(spark, folder).where("type in ('header', 'number')").select("block_id", T.paratext_key(F.col("text")).alias("key"))


def recurring_headers(spark, folder):
    return T.recurring_keys(_blocks(spark, folder))


def paratext_split(spark, folder):
    return T.split_paratext(_blocks(spark, folder))


def drop_accounting(spark, folder):
    return T.drop_accounting(_blocks(spark, folder))


def math_text(spark, folder):
    return _blocks(spark, folder).where(T.is_math(F.col("text"))).select("block_id")


def grid_classes(spark, folder):
    return _blocks(spark, folder).where("grid is not null").select("block_id", T.grid_class(F.col("grid")).alias("class"))


def block_kinds(spark, folder):
    return _blocks(spark, folder).groupBy(T.kind(F.col("type")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def title_split(spark, folder):
    """The first title of a document; these tables call it ``title``."""
    return T.document_title(_blocks(spark, folder), "title")


def region_types(spark, folder):
    """Grids as regions, each turned by one column of it into prose, and by none into nothing, as well."""
    b = _blocks(spark, folder).where("grid is not null")
    one = F.transform("grid", lambda r: F.slice(r, 1, 1))
    none = F.transform("grid", lambda r: F.transform(r, lambda c: F.lit(" ")))
    return b.select("block_id", T.region_type(F.col("grid"), F.col("text")).alias("whole"), T.region_type(one, F.col("text")).alias("first_column"), T.region_type(none, F.col("text")).alias("blanked"))


def heading_texts(spark, folder):
    """Titles of several lines: what stands after the last sentence end counts."""
    b = _blocks(spark, folder).where("type in ('title', 'text') and text is not null")
    return b.select("block_id", T.heading_text(F.col("text")).alias("heading"))


def list_items(spark, folder):
    return _blocks(spark, folder).where(T.is_list_item(F.col("type"), F.coalesce("text", F.lit("")))).select("block_id")


def list_groups(spark, folder):
    return T.list_groups(_blocks(spark, folder)).select("document_id", "page_idx", "first_block", "n_items", F.col("items.depth").alias("depths"), F.md5("content").alias("digest"))


def heading_paths(spark, folder):
    return T.heading_path(_blocks(spark, folder)).select("block_id", F.array_join("heading_path", " > ").alias("path"))


def page_ordinals(spark, folder):
    return T.page_ordinal(_blocks(spark, folder))


def block_ordinals(spark, folder):
    return T.block_ordinal(table(spark, folder, "content_nodes"))


def clean_texts(spark, folder):
    return _blocks(spark, folder).where("text is not null").select("block_id", F.md5(T.clean_text(F.col("text"))).alias("digest"))


def search_texts(spark, folder):
    s = T.search_text(table(spark, folder, "content_nodes"), table(spark, folder, "documents"), table(spark, folder, "libraries"))
    return s.select("content_id", F.md5("made").alias("digest"))


def table_search_texts(spark, folder):
    cat, libs = table(spark, folder, "table_catalog"), table(spark, folder, "libraries")
    return T.table_search_text(cat.withColumn("headers", F.transform("column_specs", lambda c: c["header"])), libs)


def stitched_tables(spark, folder):
    return T.stitch(_blocks(spark, folder))


def content_tree(spark, folder):
    """All leaves: place, headings and content."""
    t = T.build_tree(_blocks(spark, folder))
    content = F.coalesce("list_content", "text", "latex")
    return t.select("document_id", "block_id", "page_no", "ordinal", "kind", F.array_join("heading_path", " > ").alias("path"), F.md5(content).alias("digest"))


def raw_payloads(spark, folder):
    """What is stored of every leaf, read back: the fields that are set, and how many items."""
    t = T.raw_payload(T.build_tree(_blocks(spark, folder)))
    keys = F.array_join(F.json_object_keys("raw"), ",")
    return t.select("block_id", keys.alias("fields"), F.json_array_length(F.get_json_object("raw", "$.items")).cast("bigint").alias("n_items"), F.md5(F.coalesce(F.get_json_object("raw", "$.text"), F.get_json_object("raw", "$.latex"))).alias("digest"))


def library_tree(spark, folder):
    """Documents in their libraries; a sum of hashes tells the members, so no list of a library is held."""
    d = table(spark, folder, "documents")
    return d.groupBy("library_id").agg(F.count(F.lit(1)).alias("children"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.sum(F.pmod(F.col("doc_id") * 7919, F.lit(1_000_003))).alias("digest"))


_B = "b AS (SELECT * EXCLUDE (received_at) FROM blocks QUALIFY row_number() OVER (PARTITION BY block_id ORDER BY received_at) = 1)"
_KEY = r"lower(trim(regexp_replace(regexp_replace({t}, '[0-9]', '', 'g'), '\s+', ' ', 'g')))"
_STRIP = r"regexp_replace({t}, '^\s+|\s+$', '', 'g')"
_MARK = r"^\s*([●○•▪◦‣·*]\s|[-–—]\s|\(?[0-9]{1,3}[.)]\s|\(?[A-Za-z][.)]\s|\([A-Za-z0-9]+\)\s)"
_MATH = "coalesce(" + " OR ".join(f"contains({{t}}, '{m}')" for m in T.MATH_MARKS) + r" OR regexp_matches(regexp_replace({t}, '^\s+|\s+$', '', 'g'), '^\([0-9]+\)$') OR length({t}) - length(translate({t}, '" + T.MATH_GLYPHS + "', '')) >= 2, false)"
_BLANK = r"regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') = ''"
_FURNITURE = "type IN ('header', 'footer', 'number', 'aside_text', 'header_image', 'footer_image')"
_CELLS = "list_filter(flatten({g}), lambda c: c IS NOT NULL AND trim(c) <> '')"
_CLASS = "CASE WHEN {g} IS NULL OR len(" + _CELLS + ") = 0 THEN 'empty' WHEN len(list_filter(list_transform(" + _CELLS + ", lambda x: " + _MATH.replace("{t}", "x") + "), lambda m: NOT m)) = 0 THEN 'equation' WHEN list_max(list_transform({g}, lambda r: len(r))) <= 1 THEN 'prose' ELSE 'table' END"
_SALVAGED = r"trim(regexp_replace(regexp_replace(coalesce(text, ''), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"
_REGION = "CASE WHEN " + _CLASS + " = 'empty' THEN CASE WHEN " + _SALVAGED + " = '' THEN 'nothing' ELSE 'text' END WHEN " + _CLASS + " = 'prose' THEN 'text' ELSE " + _CLASS + " END"
_FATE = f"""{_B}, k AS (SELECT *, {_KEY.format(t="coalesce(text, '')")} AS key FROM b),
    r AS (SELECT document_id, key FROM k WHERE {_FURNITURE} AND type <> 'number' AND key <> '' AND text IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT page_idx) >= 2),
    f AS (SELECT block_id, k.document_id, CASE WHEN type IN ('header_image', 'footer_image') AND {_BLANK} THEN 'empty_image'
      WHEN {_FURNITURE} AND ({_BLANK} OR type = 'number' OR k.key = '') THEN 'dropped'
      WHEN {_FURNITURE} AND r.key IS NOT NULL THEN 'paratext' WHEN {_FURNITURE} THEN 'rescued'
      WHEN type IN ('image', 'seal', 'chart') AND {_BLANK} THEN 'empty_image' WHEN type = 'doc_title' THEN 'title'
      WHEN type = 'table' AND {_REGION.replace('{g}', 'grid')} = 'nothing' THEN 'empty' WHEN type IS DISTINCT FROM 'table' AND {_BLANK} AND grid IS NULL THEN 'empty' ELSE 'kept' END AS fate
      FROM k LEFT JOIN r ON k.document_id = r.document_id AND k.key = r.key)"""
_KIND = "CASE WHEN {t} IN ('paragraph_title', 'reference', 'title') THEN 'heading' WHEN {t} IN ('algorithm', 'code') THEN 'code' WHEN {t} IN ('list_item', 'list') THEN 'list' WHEN {t} IN ('display_formula', 'equation') THEN 'equation' WHEN {t} = 'table' THEN 'table' ELSE 'paragraph' END"
_ITEM = f"coalesce(NOT {_BLANK} AND ({_KIND.format(t='type')} = 'list' OR ({_KIND.format(t='type')} = 'paragraph' AND regexp_matches(coalesce(text, ''), '{_MARK}'))), false)"
_FLAT = r"regexp_replace(regexp_replace(coalesce({t}, ''), '\s*[\r\n]+\s*', ' ', 'g'), '^\s+|\s+$', '', 'g')"
_ITEM_TEXT = _FLAT.replace("{t}", r"regexp_replace(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g'), '^\s*[●○•▪◦‣·*–—-]\s+', '')")
_HEADING = r"""coalesce(list_filter(list_transform(string_split(regexp_replace(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), '(["”:.?)])\s*\n\s*', '\1' || chr(1), 'g'), chr(1)),
    lambda x: regexp_replace(regexp_replace(x, '\s*\n\s*', ' ', 'g'), '^\s+|\s+$', '', 'g')), lambda x: x <> '')[-1], '')"""
_CLEAN = r"trim(regexp_replace(regexp_replace(nfc_normalize({t}), '([a-z])-\s+([a-z])', '\1\2', 'g'), '\s+', ' ', 'g'))"
_NAME = r"trim(regexp_replace(regexp_replace(nfc_normalize({t}), '[_-]+', ' ', 'g'), '\s+', ' ', 'g'))"
_LEVELS = ", ".join(f"max(CASE WHEN level = {i} THEN seq END) OVER w AS s{i}, last_value(CASE WHEN level = {i} THEN heading END IGNORE NULLS) OVER w AS t{i}" for i in range(1, 7))
_PATH = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN s{i} > greatest(0, {', '.join(f'coalesce(s{j}, 0)' for j in range(1, i)) or '0'}) THEN t{i} END" for i in range(1, 7)) + "], lambda x: x IS NOT NULL), ' > ')"
_SEQ = f"s AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page_idx, block_id) AS seq, {_HEADING} AS heading, CASE WHEN {_KIND.format(t='type')} = 'heading' THEN greatest(1, least(6, coalesce(text_level, 1))) END AS level FROM {{source}}), h AS (SELECT *, {_LEVELS} FROM s WINDOW w AS (PARTITION BY document_id ORDER BY seq ROWS UNBOUNDED PRECEDING))"
_ISLANDS = """o AS (SELECT *, CASE WHEN item AND NOT coalesce(lag(item) OVER w, false) THEN 1 ELSE 0 END AS opens FROM {source} WINDOW w AS (PARTITION BY document_id, page_idx ORDER BY block_id)),
    g AS (SELECT *, sum(opens) OVER (PARTITION BY document_id, page_idx ORDER BY block_id ROWS UNBOUNDED PRECEDING) AS grp FROM o)"""
_LEAVES = f"""{_FATE}, k0 AS (SELECT b.* EXCLUDE (type, text), fate, CASE WHEN fate = 'rescued' THEN CASE WHEN {_MATH.format(t='text')} THEN 'equation' ELSE 'text' END ELSE type END AS type,
      CASE WHEN fate = 'rescued' THEN {_STRIP.format(t='text')} ELSE text END AS text FROM b JOIN f USING (block_id) WHERE fate IN ('kept', 'rescued', 'empty')),
    k1 AS (SELECT *, CASE WHEN type = 'table' THEN {_REGION.replace('{g}', 'grid')} ELSE type END AS made FROM k0),
    k2 AS (SELECT * EXCLUDE (type, text, made), made AS type, CASE WHEN type = 'table' AND made IN ('equation', 'text') THEN coalesce(nullif(array_to_string({_CELLS.replace('{g}', 'grid')}, ' '), ''), {_SALVAGED}) ELSE text END AS text FROM k1 WHERE made <> 'nothing'),
    {_SEQ.format(source='k2')}, p AS (SELECT *, {_PATH} AS path, {_ITEM} AS item, {_ITEM_TEXT} AS entry FROM h), {_ISLANDS.format(source='p')},
    l AS (SELECT document_id, page_idx, grp, min(block_id) AS block_id, count(*) AS n_items, string_agg(entry, chr(10) ORDER BY block_id) AS content FROM g WHERE item GROUP BY 1, 2, 3),
    v AS (SELECT g.document_id, g.block_id, g.page_idx, path, n_items, CASE WHEN item THEN 'list' ELSE {_KIND.format(t='type')} END AS kind, l.content, text FROM g LEFT JOIN l ON g.block_id = l.block_id WHERE fate <> 'empty'),
    leaves AS (SELECT document_id, block_id, CAST(page_idx + 1 AS INT) AS page_no, CAST(row_number() OVER (PARTITION BY document_id, page_idx ORDER BY block_id) AS INT) AS ordinal, kind, path, n_items,
      CASE kind WHEN 'list' THEN content WHEN 'paragraph' THEN {_FLAT.format(t='text')} WHEN 'table' THEN NULL ELSE regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g') END AS content
      FROM v WHERE kind <> 'heading' AND (kind <> 'list' OR content IS NOT NULL))"""
_LEAF = """CASE kind WHEN 'equation' THEN coalesce(latex, '') WHEN 'list' THEN coalesce(array_to_string(list_transform(from_json(raw, '{"items":[{"ordinal":"INTEGER","content":"VARCHAR","depth":"INTEGER"}]}').items, lambda i: (coalesce(i.ordinal, 0) + 1) || '. ' || coalesce(i.content, '')), ' '), '') ELSE coalesce(raw ->> '$.text', '') END"""
SQL = {
    "collapse_loops": r"""WITH s AS (SELECT doc_id, regexp_split_to_array(concat_ws(chr(10), text, text, text), '\\\\|\n') AS p FROM documents WHERE text IS NOT NULL),
        x AS (SELECT doc_id, unnest(p) AS x, unnest(range(1, len(p) + 1)) AS i FROM s), t AS (SELECT *, regexp_replace(x, '^\s+|\s+$', '', 'g') AS h FROM x),
        l AS (SELECT doc_id, h FROM t WHERE length(h) >= 40 GROUP BY 1, 2 HAVING count(*) >= 3),
        k AS (SELECT t.doc_id, t.x, t.h, t.i, l.h IS NOT NULL AS looped, row_number() OVER (PARTITION BY t.doc_id, t.h ORDER BY t.i) AS rn FROM t LEFT JOIN l ON t.doc_id = l.doc_id AND t.h = l.h)
        SELECT doc_id, CAST(count(DISTINCT h) FILTER (WHERE looped) AS INT) AS n_looped, md5(string_agg(x, chr(10) ORDER BY i) FILTER (WHERE NOT looped OR rn = 1)) AS digest FROM k GROUP BY doc_id HAVING bool_or(looped)""",
    "paratext_keys": f"WITH {_B} SELECT block_id, {_KEY.format(t='text')} AS key FROM b WHERE type IN ('header', 'number')",
    "recurring_headers": f"WITH {_B}, k AS (SELECT *, {_KEY.format(t='text')} AS key FROM b WHERE {_FURNITURE} AND type <> 'number') SELECT document_id, key, CAST(count(DISTINCT page_idx) AS INT) AS pages, arg_min(text, (page_idx, block_id)) AS first_text FROM k WHERE key <> '' GROUP BY 1, 2 HAVING count(DISTINCT page_idx) >= 2",
    "paratext_split": f"WITH {_FATE} SELECT * FROM f",
    "drop_accounting": f"WITH {_FATE} SELECT document_id, count(*) AS blocks_in, count(*) FILTER (WHERE fate IN ('paratext','dropped')) AS paratext, count(*) FILTER (WHERE fate = 'empty_image') AS empty_image, count(*) FILTER (WHERE fate = 'empty') AS empty_block, count(*) FILTER (WHERE fate IN ('kept','rescued','title')) AS kept FROM f GROUP BY 1",
    "math_text": f"WITH {_B} SELECT block_id FROM b WHERE {_MATH.format(t='text')}",
    "grid_classes": f"WITH {_B} SELECT block_id, {_CLASS.replace('{g}', 'grid')} AS class FROM b WHERE grid IS NOT NULL",
    "block_kinds": f"WITH {_B} SELECT {_KIND.format(t='type')} AS kind, count(*) AS n FROM b GROUP BY 1",
    "title_split": f"WITH {_B} SELECT document_id, arg_min({_FLAT.format(t='text')}, (page_idx, block_id)) AS title FROM b WHERE type = 'title' AND text IS NOT NULL GROUP BY 1",
    "list_items": f"WITH {_B} SELECT block_id FROM b WHERE {_ITEM}",
    "list_groups": f"WITH {_B}, i AS (SELECT *, {_ITEM} AS item FROM b), {_ISLANDS.format(source='i')} SELECT document_id, page_idx, min(block_id) AS first_block, count(*) AS n_items, list(coalesce(text_level, 0) ORDER BY block_id) AS depths, md5(string_agg({_ITEM_TEXT}, chr(10) ORDER BY block_id)) AS digest FROM g WHERE item GROUP BY document_id, page_idx, grp",
    "heading_paths": f"WITH {_B}, {_SEQ.format(source='b')} SELECT block_id, {_PATH} AS path FROM h",
    "page_ordinals": f"WITH {_B} SELECT block_id, CAST(row_number() OVER (PARTITION BY document_id, page_idx ORDER BY block_id) - 1 AS INT) AS ordinal FROM b",
    "block_ordinals": "SELECT content_id, row_number() OVER (PARTITION BY document_id ORDER BY coalesce(page_no, sheet_no), ordinal, content_id) AS place FROM content_nodes",
    "clean_texts": f"WITH {_B} SELECT block_id, md5({_CLEAN.format(t='text')}) AS digest FROM b WHERE text IS NOT NULL",
    "table_search_texts": f"SELECT table_id, array_to_string(list_filter([{_NAME.format(t='l.name')}, {_CLEAN.format(t='c.title')}] || list_transform(column_specs, lambda s: {_CLEAN.format(t='s.header')}), lambda x: x <> ''), chr(10)) AS made FROM table_catalog c LEFT JOIN libraries l USING (library_id)",
    "library_tree": "SELECT library_id, count(*) AS children, min(doc_id) AS first_doc, max(doc_id) AS last_doc, CAST(sum(doc_id * 7919 % 1000003) AS BIGINT) AS digest FROM documents GROUP BY 1",
    "collapse_blocks": rf"""WITH {_B}, s AS (SELECT block_id, type, concat_ws('\\', text, text, text) AS t FROM b), q AS (SELECT block_id, unnest(regexp_split_to_array(t, '\\\\|\n')) AS x, unnest(range(1, len(regexp_split_to_array(t, '\\\\|\n')) + 1)) AS i FROM s WHERE type IS DISTINCT FROM 'table'),
        y AS (SELECT *, {_STRIP.format(t='x')} AS h FROM q), z AS (SELECT *, length(h) >= 40 AND count(*) OVER (PARTITION BY block_id, h) >= 3 AS looped, row_number() OVER (PARTITION BY block_id, h ORDER BY i) AS rn FROM y),
        m AS (SELECT block_id, string_agg(x, chr(10) ORDER BY i) FILTER (WHERE NOT looped OR rn = 1) AS made, bool_or(looped) AS looped FROM z GROUP BY 1)
        SELECT s.block_id, md5(CASE WHEN looped THEN made ELSE t END) AS digest FROM s LEFT JOIN m USING (block_id)""",
    "region_types": f"""WITH {_B}, w AS (SELECT block_id, text, grid, list_transform(grid, lambda r: r[1:1]) AS one, list_transform(grid, lambda r: list_transform(r, lambda c: ' ')) AS no FROM b WHERE grid IS NOT NULL)
        SELECT block_id, {_REGION.replace('{g}', 'grid')} AS whole, {_REGION.replace('{g}', 'one')} AS first_column, {_REGION.replace('{g}', 'no')} AS blanked FROM w""",
    "heading_texts": f"WITH {_B} SELECT block_id, {_HEADING} AS heading FROM b WHERE type IN ('title', 'text') AND text IS NOT NULL",
    "content_tree": f"WITH {_LEAVES} SELECT document_id, block_id, page_no, ordinal, kind, path, md5(content) AS digest FROM leaves",
    "raw_payloads": f"WITH {_LEAVES} SELECT block_id, CASE kind WHEN 'equation' THEN 'latex' WHEN 'list' THEN 'items' WHEN 'table' THEN NULL ELSE 'text' END AS fields, CASE WHEN kind = 'list' THEN n_items END AS n_items, CASE WHEN kind NOT IN ('list', 'table') THEN md5(content) END AS digest FROM leaves",
    "search_texts": f"""WITH k AS (SELECT *, {_KIND.format(t='type')} AS kind FROM content_nodes), l AS (SELECT *, {_LEAF} AS body FROM k),
        n AS (SELECT *, CASE WHEN kind = 'equation' THEN last_value(CASE WHEN kind = 'paragraph' AND trim(body) <> '' THEN body END IGNORE NULLS) OVER (PARTITION BY document_id, page_no ORDER BY ordinal, content_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) END AS near FROM l),
        d AS (SELECT n.*, b.name AS library, regexp_replace(filename, '\\.[^.]*$', '') AS stem FROM n JOIN documents d ON n.document_id = d.doc_id LEFT JOIN libraries b ON d.library_id = b.library_id WHERE kind <> 'table')
        SELECT content_id, md5(array_to_string(list_filter([{_NAME.format(t='library')}, {_NAME.format(t='stem')}, {_CLEAN.format(t='heading')}, {_CLEAN.format(t='near')}, {_CLEAN.format(t='body')}], lambda x: x IS NOT NULL AND x <> ''), chr(10))) AS digest FROM d""",
}
_NAMES = [*SQL, "stitched_tables"]
QUERIES = {n: globals()[n] for n in _NAMES}
