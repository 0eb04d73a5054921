"""Queries over event time and over files and formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import temporal
from ..operators import tree as T
from ..sources import detect, html
from ..session import table
from ..streaming import ingest


def ext_tumbling(spark, folder):
    w = ingest.windowed_counts(table(spark, folder, "events"))
    return w.select(F.col("w.start").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def ext_sliding(spark, folder):
    w = ingest.windowed_counts(table(spark, folder, "events"), size="2 days", slide="1 day")
    return w.select(F.col("w.start").alias("day"), "event_type", "n")


def ext_session(spark, folder):
    return ingest.sessions(table(spark, folder, "events")).select("user_id", F.col("w.start").alias("begins"), "n")


def ext_asof(spark, folder):
    e = table(spark, folder, "events")
    clicks = e.where("event_type = 'click'").select("event_id", "user_id", "ts")
    buys = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return temporal.asof(clicks, buys, ["user_id"], "ts", ["value"]).select("event_id", F.col("value").alias("last_purchase"))


def ext_interval_join(spark, folder):
    o = table(spark, folder, "part").select("p_partkey", F.col("p_retailprice").alias("price"))
    s = table(spark, folder, "supplier").select("s_suppkey", F.abs("s_acctbal").alias("low"), (F.abs("s_acctbal") + 2).alias("high"))
    return temporal.interval_join(o, s, "price", "low", "high", 16).select("p_partkey", "s_suppkey")


def sniff_kind(spark, folder):
    d = table(spark, folder, "documents").where("text is not null").select(F.lit("documents").alias("origin"), detect.sniff(F.col("text")).alias("kind"))
    e = table(spark, folder, "events").select(F.lit("events").alias("origin"), detect.sniff(F.col("props")).alias("kind"))
    b = table(spark, folder, "blocks").where("text is not null").select(F.lit("blocks").alias("origin"), detect.sniff(F.col("text")).alias("kind"))
    return d.unionByName(e).unionByName(b).groupBy("origin", "kind").agg(F.count(F.lit(1)).alias("n"))


def file_extensions(spark, folder):
    return table(spark, folder, "documents").where("filename is not null").groupBy(detect.extension(F.col("filename")).alias("ext")).agg(F.count(F.lit(1)).alias("n"))


def _escape(c):
    return F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def html_tables(spark, folder):
    """Grids written as HTML and read back."""
    g = T.delivered(table(spark, folder, "blocks")).where("grid is not null and size(grid) > 0")
    rows = F.array_join(F.transform("grid", lambda r: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, lambda c: F.concat(F.lit("<td>"), _escape(c), F.lit("</td>"))), ""), F.lit("</tr>"))), "")
    pages = g.select("block_id", F.concat(F.lit("<body><script>var x=1;</script><!-- c --><table>"), rows, F.lit("</table></body>")).alias("html"))
    got = html.read_html(pages, "block_id", "html").where("type = 'table'")
    return got.select("block_id", F.size("grid").alias("n_rows"), F.md5(F.array_join(F.flatten(F.transform("grid", lambda r: F.filter(r, lambda c: c != ""))), "|")).alias("digest"))


def html_blocks(spark, folder):
    """All block texts written as a page of headings, paragraphs and links, read back."""
    return _read_back(T.delivered(table(spark, folder, "blocks")).where(r"text rlike r'(?U)\S'"))


def _read_back(b):
    page = F.concat(F.lit("<html><head><title>t</title></head><body><h2>"), F.col("block_id").cast("string"), F.lit("</h2><p>"), _escape(F.col("text")), F.lit(' <a href="#x">up</a></p></body></html>'))
    got = html.read_html(b.select("block_id", page.alias("html")), "block_id", "html")
    return got.select("block_id", "ordinal", "type", "text_level", F.md5("text").alias("digest"))


_B = "b AS (SELECT * EXCLUDE (received_at) FROM blocks QUALIFY row_number() OVER (PARTITION BY block_id ORDER BY received_at) = 1)"
_SEP = "len({h}) >= 2 AND list_min({h}) = list_max({h}) AND list_min({h}) > 0"
_HEAD = "list_transform(list_filter(regexp_split_to_array(substr(text, 1, 65536), '\\r?\\n')[1:20], lambda x: trim(x, ' ') <> ''), lambda x: length(x) - length(replace(x, '{s}', '')))"
_SNIFF = "CASE WHEN substr(t, 1, 1) IN ('{', '[') THEN 'json' WHEN regexp_matches(t, '(?i)^(<!doctype html|<html|<\\?xml|<[a-z]+[\\s>/])') THEN 'html' WHEN " + _SEP.format(h="hc") + " THEN 'csv' WHEN " + _SEP.format(h="ht") + " THEN 'tsv' ELSE 'text' END"
#: White space as the reader folds it.
_WHITE = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
SQL = {
    "ext_tumbling": "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "ext_sliding": "SELECT CAST(d AS TIMESTAMP) AS day, event_type, count(*) AS n FROM (SELECT event_type, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS d FROM events) GROUP BY 1, 2",
    "ext_session": "WITH s AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS o FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM s) SELECT user_id, min(ts) AS begins, count(*) AS n FROM g GROUP BY user_id, g",
    "ext_asof": "WITH c AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'), p AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) SELECT c.event_id, p.value AS last_purchase FROM c ASOF LEFT JOIN p ON c.user_id = p.user_id AND c.ts >= p.ts",
    "ext_interval_join": "SELECT p_partkey, s_suppkey FROM part JOIN supplier ON p_retailprice BETWEEN abs(s_acctbal) AND abs(s_acctbal) + 2",
    "sniff_kind": "WITH x AS (SELECT 'documents' AS origin, text FROM documents WHERE text IS NOT NULL UNION ALL SELECT 'events', props FROM events UNION ALL SELECT 'blocks', text FROM blocks WHERE text IS NOT NULL), y AS (SELECT origin, regexp_replace(substr(text, 1, 65536), '^[\\s\\x{FEFF}]+', '') AS t, " + _HEAD.replace("{s}", ",") + " AS hc, " + _HEAD.replace("{s}", "\t") + " AS ht FROM x) SELECT origin, " + _SNIFF + " AS kind, count(*) AS n FROM y GROUP BY 1, 2",
    "file_extensions": "SELECT lower(regexp_extract(filename, '\\.([A-Za-z0-9]{1,9})$', 1)) AS ext, count(*) AS n FROM documents WHERE filename IS NOT NULL GROUP BY 1",
    "html_tables": f"WITH {_B} SELECT block_id, CAST(len(grid) AS INT) AS n_rows, md5(array_to_string(list_filter(list_transform(flatten(grid), lambda c: trim(regexp_replace(coalesce(c, ''), '\\s+', ' ', 'g'))), lambda c: c <> ''), '|')) AS digest FROM b WHERE grid IS NOT NULL AND len(grid) > 0",
    "html_blocks": f"""WITH {_B}, k AS (SELECT block_id, trim(regexp_replace(text, '{_WHITE}+', ' ', 'g'), ' ') AS t FROM b WHERE regexp_matches(text, '[^' || '{_WHITE}'[2:]))
        SELECT block_id, 0 AS ordinal, 'title' AS type, 2 AS text_level, md5(CAST(block_id AS VARCHAR)) AS digest FROM k UNION ALL SELECT block_id, 1, 'text', NULL, md5(t || ' up') FROM k""",
}
QUERIES = {n: globals()[n] for n in SQL}
