"""Problem 1: oversized texts cut into overlapping pieces at natural boundaries.

For a text above the limit the least number of pieces is computed and targets of
equal length are placed; each is moved to the strongest boundary near it
(paragraph, line, sentence, clause, word, then any character), and a piece is
added when a cut can't keep all limits. Every piece repeats up to ``overlap``
characters of the one before, from a word start where there is one.

Defined cases: null, empty and short texts give one piece, or none under
``only_long``; a text without boundaries is cut at characters, never within a
combining sequence where that can be helped; lengths are in Unicode characters;
repeated rows give repeated pieces; other columns are not read.
"""

from __future__ import annotations

import math
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.lineage import bound_batches
from ..session import table
from .latest import latest

LIMIT, OVERLAP = 1600, 120
#: Boundaries from strongest to weakest; a cut falls at the end of a match.
_BOUNDARIES = [
    re.compile(r"\n[ \t\r]*\n\s*"),
    re.compile(r"\n"),
    re.compile(r"[.!?…]+[\"'”’»)\]]*\s+|[。！？]+[」』）]*"),
    re.compile(r"[;:,，、；：]\s*"),
    re.compile(r"\s+"),
]


def _start(text: str, cut: int, floor: int) -> int:
    """Where the piece after ``cut`` starts: at the first word start at or after ``floor``."""
    if floor >= cut or floor <= 0:
        return max(0, min(floor, cut))
    if text[floor - 1].isspace():
        return floor
    gap = re.compile(r"\s+").search(text, floor, cut)
    if gap and gap.end() < cut:
        return gap.end()
    while floor < cut and unicodedata.combining(text[floor]):
        floor += 1
    return floor


def _snap(text: str, low: int, target: int, high: int) -> int:
    """The strongest boundary in ``(low, high]``, the nearest to ``target`` of equals."""
    window = text[low : min(len(text), high + 1)]
    for rule in _BOUNDARIES:
        ends = [low + m.end() for m in rule.finditer(window) if low < low + m.end() <= high]
        if ends:
            return min(ends, key=lambda e: abs(e - target))
    cut = min(max(target, low + 1), high)
    while cut > low + 1 and unicodedata.combining(text[cut]):
        cut -= 1
    return cut


def cut_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Start and end of each piece; consecutive pieces share ``[start, previous end)``."""
    if limit < 1 or overlap < 0 or overlap >= limit:
        raise ValueError("limit must be positive and above the overlap")
    n = len(text)
    if n <= limit:
        return [(0, n)]
    fresh = limit - overlap  # new characters that every later piece holds at least room for
    k = 1 + math.ceil((n - limit) / fresh)
    while True:
        pieces, start, done = [], 0, 0
        for left in range(k, 0, -1):
            if left == 1:
                pieces.append((start, n))
                break
            target = done + (n - done) / left
            reach = max(1, int((n - done) / left / 3))
            high = min(start + limit, n - 1)
            low = max(done, min(int(target) - reach, high - 1))
            cut = _snap(text, low, min(int(target), high), min(high, max(int(target) + reach, low + 1)))
            pieces.append((start, cut))
            start, done = _start(text, cut, cut - overlap), cut
        if all(0 < b - a <= limit for a, b in pieces) and pieces[-1][1] == n:
            return pieces
        k += 1


def split_items(df: DataFrame, keys: list[str], text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, only_long: bool = False) -> DataFrame:
    """Pieces of every text: ``keys``, piece_no, n_pieces, start_char, end_char, piece. No shuffle."""

    def run(batches):
        for batch in batches:
            texts, at, rows = batch.column(len(keys)), [], ([], [], [], [], [])
            for i, value in enumerate(texts.to_pylist()):
                if value is None:
                    continue
                spans = cut_text(value, limit, overlap)
                for no, (a, b) in enumerate(spans):
                    at.append(i)
                    for column, x in zip(rows, (no, len(spans), a, b, value[a:b]), strict=True):
                        column.append(x)
            kept = [batch.column(i).take(pa.array(at, pa.int64())) for i in range(len(keys))]
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays(
                kept + [pa.array(c, t) for c, t in zip(rows, kinds, strict=True)],
                names=[*keys, "piece_no", "n_pieces", "start_char", "end_char", "piece"],
            )

    bound_batches(df.sparkSession)
    rows = df.select(*[F.col(k) for k in keys], F.col(text).cast("string").alias("__text"))
    if only_long:
        rows = rows.where(F.char_length("__text") > limit)
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.mapInArrow(run, f"{kinds}, piece_no int, n_pieces int, start_char int, end_char int, piece string")


def _items(spark: SparkSession, folder: str, limit: int) -> DataFrame:
    """Long texts of the latest loads and of the nodes; short ones stay behind as nulls."""
    loads, nodes = table(spark, folder, "block_texts"), table(spark, folder, "content_nodes")
    size = F.char_length("text")
    text = F.when(size > limit, F.col("text"))
    last = latest(loads, "content_id", "loaded_at", [F.coalesce(size, F.lit(-1)), F.xxhash64("text")], {"text": text})
    long_nodes = nodes.where(F.char_length("search_text") > limit).select("content_id", F.col("search_text").alias("text"))
    return (last.where("text is not null").withColumn("origin", F.lit("block_texts"))).unionByName(long_nodes.withColumn("origin", F.lit("content_nodes")))


def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of all oversized texts."""
    return split_items(_items(spark, folder, LIMIT), ["origin", "content_id"], only_long=True)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Items that came out in more than one piece."""
    return p1_pieces(spark, folder).where("piece_no = 0 and n_pieces > 1").select("origin", "content_id")


def p1_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Per item: the characters its pieces cover, and whether they keep the limit and the overlap, leave no gap and are as few as can be or one more in ten."""
    p = p1_pieces(spark, folder)
    before = Window.partitionBy("origin", "content_id").orderBy("piece_no")  # the pieces of one text
    p = p.withColumn("shared", F.coalesce(F.lag("end_char").over(before) - F.col("start_char"), F.lit(0)))
    least = 1 + F.ceil((F.max("end_char") - LIMIT) / (LIMIT - OVERLAP))
    return p.groupBy("origin", "content_id").agg(
        F.max("end_char").cast("bigint").alias("covered"), (F.max(F.col("end_char") - F.col("start_char")) <= LIMIT).alias("limit_held"),
        (F.max("shared") <= OVERLAP).alias("overlap_held"), ((F.min("shared") >= 0) & (F.min("start_char") == 0)).alias("gapless"),
        (F.count(F.lit(1)) <= F.ceil(least * 1.1)).alias("few"), (F.max("shared") > 0).alias("overlaps"),
    )


_LONG = """
    SELECT 'block_texts' AS origin, content_id, text FROM (
        SELECT content_id, text, row_number() OVER (PARTITION BY content_id ORDER BY loaded_at DESC, coalesce(length(text), -1) DESC) AS rn FROM block_texts)
    WHERE rn = 1 AND length(text) > 1600
    UNION ALL SELECT 'content_nodes', content_id, search_text FROM content_nodes WHERE length(search_text) > 1600"""
SQL = {
    "p1_found": f"SELECT origin, content_id FROM ({_LONG})",
    "p1_coverage": f"SELECT origin, content_id, CAST(length(text) AS BIGINT) AS covered, true AS limit_held, true AS overlap_held, true AS gapless, true AS few, true AS overlaps FROM ({_LONG})",
}
QUERIES = {"p1_found": p1_found, "p1_pieces": p1_pieces, "p1_coverage": p1_coverage}
