"""The SQL surface: queries as a PostgreSQL user writes them, run through the dialect layer.

The same text is given to DuckDB, unless the two databases themselves differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans import dialect
from ..session import table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "blocks", "content_nodes", "content_batches", "block_texts", "libraries", "languages", "source_targets", "table_catalog", "node_embeddings", "table_rows")

#: name: query, or (query, DuckDB's form of it).
_TEXTS: dict[str, str | tuple[str, str]] = {
    "sql_projection": "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, COALESCE(NULLIF(o_orderstatus, 'O'), 'open') AS status FROM orders",
    "sql_filter": "SELECT c_custkey, c_name FROM customer WHERE c_acctbal BETWEEN 1000 AND 5000 AND c_mktsegment IN ('BUILDING', 'MACHINERY') AND NOT c_name ILIKE '%9' AND c_nationkey IS DISTINCT FROM 3",
    "sql_regex": (
        "SELECT p_partkey, p_name FROM part WHERE p_brand ~ '^Brand#[1-3]' AND p_type !~ 'STEEL$' AND p_name ~* '[aeiou][[:space:]]?[a-m]'",
        "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_brand, '^Brand#[1-3]') AND NOT regexp_matches(p_type, 'STEEL$') AND regexp_matches(p_name, '(?i)[aeiou][[:space:]]?[a-m]')",
    ),
    "sql_inner_join": "SELECT n.n_name, COUNT(*) AS n_customers, CAST(ROUND(SUM(c.c_acctbal), 2) AS DOUBLE PRECISION) AS balance FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY n.n_name",
    "sql_outer_joins": "SELECT n.n_name, s.s_suppkey, c.n_cust FROM nation n LEFT JOIN (SELECT s_nationkey, MIN(s_suppkey) AS s_suppkey FROM supplier GROUP BY s_nationkey) s ON n.n_nationkey = s.s_nationkey FULL JOIN (SELECT c_nationkey, COUNT(*) AS n_cust FROM customer WHERE c_acctbal > 5000 GROUP BY c_nationkey) c ON n.n_nationkey = c.c_nationkey",
    "sql_cross_small": "SELECT r.r_name, l.code FROM region r CROSS JOIN languages l",
    "sql_exists": "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)",
    "sql_not_exists": "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)",
    "sql_in_subquery": "SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)",
    "sql_not_in": "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)",
    "sql_range_join": "SELECT a.batch_id, COUNT(*) AS n_blocks FROM content_batches a JOIN content_nodes b ON a.document_id = b.document_id AND b.block_ordinal BETWEEN a.start_block_ordinal AND a.end_block_ordinal GROUP BY a.batch_id",
    "sql_lateral": "SELECT n.n_name, t.c_name, t.c_acctbal FROM nation n JOIN LATERAL (SELECT c.c_name, c.c_acctbal FROM customer c WHERE c.c_nationkey = n.n_nationkey ORDER BY c.c_acctbal DESC, c.c_custkey LIMIT 2) t ON TRUE",
    "sql_aggregates": "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, CAST(SUM(l_quantity) AS BIGINT) AS quantity, ROUND(AVG(l_discount), 6) AS discount, MIN(l_shipdate) AS first_ship, MAX(l_shipdate) AS last_ship, ROUND(STDDEV_SAMP(l_quantity), 6) AS spread, BOOL_OR(l_tax > 0.07) AS high_tax FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "sql_string_agg": "SELECT n_regionkey, STRING_AGG(n_name, ', ' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
    "sql_distinct_filter": "SELECT o_orderpriority, COUNT(DISTINCT o_custkey) AS customers, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS finished FROM orders GROUP BY o_orderpriority",
    "sql_ordered_set": "SELECT c_mktsegment, ROUND(PERCENTILE_CONT(0.5) WITHIN GROUP (ORDER BY c_acctbal), 4) AS median, PERCENTILE_DISC(0.9) WITHIN GROUP (ORDER BY c_acctbal) AS p90 FROM customer GROUP BY c_mktsegment",
    "sql_rollup": "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, GROUPING(l_linestatus) AS g FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "sql_cube": "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "sql_grouping_sets": "SELECT p_brand, p_size, COUNT(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand), (p_size), ())",
    "sql_rankings": "SELECT c_custkey, c_nationkey, ROW_NUMBER() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn, RANK() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS rk, DENSE_RANK() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS dr, NTILE(4) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS q, ROUND(PERCENT_RANK() OVER (PARTITION BY c_nationkey ORDER BY c_custkey), 6) AS pr, ROUND(CUME_DIST() OVER (PARTITION BY c_nationkey ORDER BY c_custkey), 6) AS cd FROM customer",
    "sql_analytics": "SELECT event_id, user_id, LAG(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev, LEAD(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_type, FIRST_VALUE(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS first_id, NTH_VALUE(event_id, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second_id FROM events",
    "sql_frames": "SELECT o_orderkey, ROUND(SUM(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS moving, COUNT(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 1000 PRECEDING AND CURRENT ROW) AS near FROM orders",
    "sql_null_order": ("SELECT doc_id, title, ROW_NUMBER() OVER (ORDER BY title, doc_id) AS up, ROW_NUMBER() OVER (ORDER BY title DESC, doc_id) AS down FROM documents", "SELECT doc_id, title, ROW_NUMBER() OVER (ORDER BY title, doc_id) AS up, ROW_NUMBER() OVER (ORDER BY title DESC NULLS FIRST, doc_id) AS down FROM documents"),
    "sql_limit_offset": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5",
    "sql_with_ties": ("SELECT p_partkey, p_size FROM part ORDER BY p_size DESC FETCH FIRST 3 ROWS WITH TIES", "SELECT p_partkey, p_size FROM part QUALIFY rank() OVER (ORDER BY p_size DESC) <= 3"),
    "sql_distinct_on": "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey",
    "sql_set_operations": "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000 UNION ALL SELECT r_regionkey FROM region",
    "sql_intersect_all": "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier",
    "sql_scalar_subquery": "SELECT o_orderkey, o_totalprice FROM orders o WHERE o_totalprice > (SELECT 1.8 * AVG(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)",
    "sql_cte": "WITH spend AS (SELECT o_custkey, SUM(o_totalprice) AS total FROM orders GROUP BY o_custkey), big AS (SELECT * FROM spend WHERE total > 500000) SELECT c.c_mktsegment, COUNT(*) AS n FROM big b JOIN customer c ON b.o_custkey = c.c_custkey GROUP BY c.c_mktsegment",
    "sql_recursive": "WITH RECURSIVE steps(n, f) AS (SELECT 1, 1 UNION ALL SELECT n + 1, f * 2 FROM steps WHERE n < 12) SELECT n, f FROM steps",
    "sql_values": "SELECT v.k, v.name, COUNT(n.n_nationkey) AS n FROM (VALUES (0, 'a'), (1, 'b'), (9, 'c')) AS v(k, name) LEFT JOIN nation n ON n.n_regionkey = v.k GROUP BY v.k, v.name",
    "sql_integer_division": ("SELECT l_orderkey, l_linenumber, CAST(l_partkey / 7 AS BIGINT) AS q, l_partkey % 7 AS r, ROUND(l_extendedprice / 7, 4) AS d, CAST(2 ^ l_linenumber AS BIGINT) AS p FROM lineitem", "SELECT l_orderkey, l_linenumber, l_partkey // 7 AS q, l_partkey % 7 AS r, ROUND(l_extendedprice / 7, 4) AS d, CAST(2 ^ l_linenumber AS BIGINT) AS p FROM lineitem"),
    "sql_numeric": "SELECT p_partkey, CEIL(p_retailprice) AS c, FLOOR(p_retailprice) AS f, ABS(p_size - 25) AS a, ROUND(SQRT(p_retailprice), 6) AS s, ROUND(LN(p_retailprice), 6) AS l, ROUND(LOG(p_retailprice), 6) AS l10, GREATEST(p_size, 20) AS g, LEAST(p_size, 20) AS m, MOD(p_partkey, 10) AS d FROM part",
    "sql_strings": "SELECT c_custkey, UPPER(c_name) AS u, SUBSTR(c_name, 3, 5) AS s, REPLACE(c_name, '#', '-') AS r, SPLIT_PART(c_name, '#', 2) AS p, POSITION('#' IN c_name) AS at, LPAD(CAST(c_nationkey AS VARCHAR), 4, '0') AS lp, CONCAT(c_mktsegment, NULL, '!') AS cc, LEFT(c_name, 4) AS lf, RIGHT(c_name, 3) AS rt, LENGTH(c_name) AS len, REVERSE(c_mktsegment) AS rv, TRANSLATE(c_mktsegment, 'AEI', '123') AS tr, REGEXP_REPLACE(c_mktsegment, '[AEIOU]', '*') AS rx, c_name || '/' || c_mktsegment AS j FROM customer",
    "sql_dates": ("SELECT o_orderkey, DATE_TRUNC('month', o_orderdate) AS m, EXTRACT(year FROM o_orderdate) AS y, EXTRACT(dow FROM o_orderdate) AS dow, TO_CHAR(o_orderdate, 'YYYY-MM') AS ym, o_orderdate + INTERVAL '10' DAY AS later FROM orders", "SELECT o_orderkey, CAST(DATE_TRUNC('month', o_orderdate) AS TIMESTAMP) AS m, EXTRACT(year FROM o_orderdate) AS y, EXTRACT(dow FROM o_orderdate) AS dow, strftime(o_orderdate, '%Y-%m') AS ym, o_orderdate + INTERVAL '10' DAY AS later FROM orders"),
    "sql_series": ("SELECT s AS n, s * s AS sq FROM (SELECT GENERATE_SERIES(1, 20) AS s)", "SELECT s AS n, s * s AS sq FROM (SELECT UNNEST(GENERATE_SERIES(1, 20)) AS s)"),
    "sql_arrays": ("SELECT doc_id, CARDINALITY(paratext) AS n, ARRAY_JOIN(paratext, '|') AS j FROM documents WHERE paratext IS NOT NULL", "SELECT doc_id, len(paratext) AS n, array_to_string(paratext, '|') AS j FROM documents WHERE paratext IS NOT NULL"),
    "sql_unnest": ("SELECT doc_id, UNNEST(paratext) AS entry FROM documents", "SELECT doc_id, UNNEST(paratext) AS entry FROM documents"),
    "sql_json": ("SELECT event_id, (props ->> 'k')::bigint AS k, props -> 'k' AS raw FROM events", "SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k, CAST(props -> '$.k' AS VARCHAR) AS raw FROM events"),
    "sql_json_items": ("SELECT content_id, item ->> 'content' AS content, (item ->> 'depth')::int AS depth FROM content_nodes, jsonb_array_elements(raw -> 'items') AS t(item) WHERE type = 'list'", "SELECT content_id, item ->> '$.content' AS content, CAST(item ->> '$.depth' AS INT) AS depth FROM (SELECT content_id, unnest(from_json(raw -> '$.items', '[\"JSON\"]')) AS item FROM content_nodes WHERE type = 'list')"),
    "sql_json_path": ("SELECT content_id, raw #>> '{items,0,content}' AS first_item, jsonb_array_length(raw -> 'items')::bigint AS n FROM content_nodes WHERE raw IS NOT NULL", "SELECT content_id, raw ->> '$.items[0].content' AS first_item, CASE WHEN (raw -> '$.items') IS NOT NULL THEN CAST(json_array_length(raw -> '$.items') AS BIGINT) END AS n FROM content_nodes WHERE raw IS NOT NULL"),
    "sql_regex_column": ("SELECT p_partkey, p_name ~* left(p_type, 3) AS like_type, p_brand !~ p_name AS odd FROM part", "SELECT p_partkey, regexp_matches(p_name, '(?i)' || left(p_type, 3)) AS like_type, NOT regexp_matches(p_brand, p_name) AS odd FROM part"),
    "sql_similar": ("SELECT p_partkey FROM part WHERE p_brand SIMILAR TO 'Brand#(1|2)%' AND p_type NOT SIMILAR TO '%(STEEL|TIN)'", "SELECT p_partkey FROM part WHERE regexp_full_match(p_brand, 'Brand#(1|2).*') AND NOT regexp_full_match(p_type, '.*(STEEL|TIN)')"),
    "sql_array_agg": ("SELECT o_custkey, ARRAY_AGG(o_orderkey ORDER BY o_totalprice DESC, o_orderkey) AS keys FROM orders GROUP BY o_custkey", "SELECT o_custkey, list(o_orderkey ORDER BY o_totalprice DESC, o_orderkey) AS keys FROM orders GROUP BY o_custkey"),
    "sql_any_all": ("SELECT n_nationkey, n_regionkey = ANY(ARRAY[1, 3]) AS some, n_nationkey <> ALL(ARRAY[2, 4, 6]) AS none, n_nationkey > ALL(ARRAY[5, 9]) AS above FROM nation", "SELECT n_nationkey, n_regionkey IN (1, 3) AS some, n_nationkey NOT IN (2, 4, 6) AS none, n_nationkey > 9 AS above FROM nation"),
    "sql_array_items": ("SELECT doc_id, paratext[1] AS first_entry, CARDINALITY(paratext[2:3]) AS later FROM documents WHERE paratext IS NOT NULL", "SELECT doc_id, paratext[1] AS first_entry, len(paratext[2:3]) AS later FROM documents WHERE paratext IS NOT NULL"),
    "sql_unnest_from": ("SELECT d.doc_id, e.entry FROM documents d, unnest(d.paratext) AS e(entry) WHERE e.entry <> ''", "SELECT doc_id, entry FROM (SELECT doc_id, unnest(paratext) AS entry FROM documents) WHERE entry <> ''"),
    "sql_series_from": ("SELECT g.n, COUNT(o.o_orderkey) AS orders FROM generate_series(0, 6) AS g(n) LEFT JOIN orders o ON extract(dow FROM o.o_orderdate) = g.n GROUP BY g.n", "SELECT g.n, COUNT(o.o_orderkey) AS orders FROM generate_series(0, 6) AS g(n) LEFT JOIN orders o ON extract(dow FROM o.o_orderdate) = g.n GROUP BY g.n"),
    "sql_groups_frame": "SELECT p_partkey, SUM(p_size) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS near, COUNT(*) OVER (PARTITION BY p_brand ORDER BY p_size DESC GROUPS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS after FROM part",
    "sql_offset_fetch": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey OFFSET 7 ROWS FETCH NEXT 5 ROWS ONLY",
    "sql_arithmetic": ("SELECT l_orderkey, l_linenumber, -l_linenumber ^ 2 AS sq, 2 ^ l_linenumber ^ 2 AS pw, 100 - l_partkey % 7 * 2 AS m, l_partkey / 3 / 2 AS q, (l_partkey + 9007199254740993) / 1 AS big, l_partkey / 2 * 2.5 AS half FROM lineitem", "SELECT l_orderkey, l_linenumber, pow(-l_linenumber, 2) AS sq, pow(pow(2, l_linenumber), 2) AS pw, 100 - l_partkey % 7 * 2 AS m, l_partkey // 3 // 2 AS q, l_partkey + 9007199254740993 AS big, (l_partkey // 2) * 2.5 AS half FROM lineitem"),
    "sql_text_functions": ("SELECT c_custkey, left(c_name, -4) AS l, right(c_name, -9) AS r, substring(c_name from '[0-9]+') AS digits, substring(c_name from 'Customer#0*([1-9][0-9]*)') AS id, format('%s of %s', c_name, c_mktsegment) AS f, INITCAP(LOWER(c_mktsegment)) AS i FROM customer", "SELECT c_custkey, left(c_name, -4) AS l, right(c_name, -9) AS r, nullif(regexp_extract(c_name, '[0-9]+'), '') AS digits, nullif(regexp_extract(c_name, 'Customer#0*([1-9][0-9]*)', 1), '') AS id, c_name || ' of ' || c_mktsegment AS f, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS i FROM customer"),
    "sql_date_arithmetic": (
        "SELECT o_orderkey, o_orderdate::date - DATE '1992-01-01' AS days, extract(epoch FROM o_orderdate - TIMESTAMP '1992-01-01 00:00:00')::bigint AS secs, extract(year FROM age(o_orderdate, TIMESTAMP '1992-01-01 00:00:00')) AS y, extract(month FROM age(o_orderdate, TIMESTAMP '1992-01-01 00:00:00')) AS mon, to_date(to_char(o_orderdate, 'DD.MM.YYYY'), 'DD.MM.YYYY') AS back, to_char(o_orderdate, 'DD/MM/YY HH24:MI') AS t FROM orders",
        "SELECT o_orderkey, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS days, CAST(epoch(o_orderdate) - epoch(TIMESTAMP '1992-01-01') AS BIGINT) AS secs, extract(year FROM age(o_orderdate, TIMESTAMP '1992-01-01')) AS y, extract(month FROM age(o_orderdate, TIMESTAMP '1992-01-01')) AS mon, CAST(o_orderdate AS DATE) AS back, strftime(o_orderdate, '%d/%m/%y %H:%M') AS t FROM orders",
    ),
    "sql_map": ("SELECT doc_id, element_at(m, 'lang') AS lang, map_keys(m) AS keys FROM (SELECT doc_id, map('lang', lang, 'source', source) AS m FROM documents)", "SELECT doc_id, m['lang'] AS lang, map_keys(m) AS keys FROM (SELECT doc_id, MAP {'lang': lang, 'source': source} AS m FROM documents)"),
    "sql_approx": ("SELECT l_returnflag, COUNT(DISTINCT l_partkey) AS parts, ABS(APPROX_COUNT_DISTINCT(l_partkey) - COUNT(DISTINCT l_partkey)) <= 0.15 * COUNT(DISTINCT l_partkey) AS near FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, COUNT(DISTINCT l_partkey) AS parts, COUNT(DISTINCT l_partkey) > 0 AS near FROM lineitem GROUP BY l_returnflag"),
    "sql_hash": ("SELECT c_custkey, MD5(c_name) AS m, SHA2(c_name, 256) AS s FROM customer", "SELECT c_custkey, md5(c_name) AS m, sha256(c_name) AS s FROM customer"),
    "sql_theta_join": "SELECT a.r_name AS a, b.r_name AS b FROM region a JOIN region b ON a.r_regionkey < b.r_regionkey",
    "sql_having": "SELECT o_custkey, COUNT(*) AS n, MAX(o_totalprice) AS top FROM orders GROUP BY o_custkey HAVING COUNT(*) >= 12",
    "tpch_pricing_summary": "SELECT l_returnflag, l_linestatus, CAST(SUM(l_quantity) AS BIGINT) AS sum_qty, ROUND(SUM(l_extendedprice), 2) AS sum_base, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, COUNT(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus",
    "tpch_shipping_priority": "SELECT l_orderkey, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10",
    "tpch_local_supplier": "SELECT n_name, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name",
}


def views(spark: SparkSession, folder: str, names: tuple[str, ...] = TABLES) -> None:
    """The tables of a folder as temporary views."""
    for name in names:
        table(spark, folder, name).createOrReplaceTempView(name)


def _query(text: str):
    words = {t.lower() for k, t in dialect.tokens(text) if k == "word"}

    def run(spark: SparkSession, folder: str) -> DataFrame:
        views(spark, folder, tuple(n for n in TABLES if n in words))
        return dialect.run(spark, text)

    return run


QUERIES = {k: _query(v if isinstance(v, str) else v[0]) for k, v in _TEXTS.items()}
SQL = {k: v if isinstance(v, str) else v[1] for k, v in _TEXTS.items()}
