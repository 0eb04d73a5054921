"""Problem 3: blocks packed whole into batches under several limits at once.

Vector bin packing: a block is a vector of tokens, segments (one) and
loss-bearing tokens; a batch is a bin of that many dimensions. A bin is filled
by taking, again and again, the fitting block whose vector has the greatest dot
product with the bin's remaining room, weighted by how scarce each dimension is
in the group; the first block of a bin is the largest left. Among a few
weightings the one with the fewest bins is kept. Only a block above the token
capacity is split, into full pieces and a rest that is packed as any block.

A document of any size is packed in groups of at most ``group_blocks`` blocks
(consecutive ordinals), so no task holds an unbounded document; each further
group can cost one partly filled batch.

Defined cases: null or negative sizes count as 0 tokens and are packed;
null documents form a document of their own; a block loaded more than once
counts once, with its latest load; other columns are not read; a piece with more
loss-bearing tokens than a batch may hold stays whole and counts as the limit, the rest
of them being for the trainer to mask.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .latest import latest

CAPACITY, SEGMENTS, GROUP_BLOCKS, SALTS = 512, 512, 4096, 64
#: Limits of batches for instruction data: segments, and tokens that bear loss.
MOST_SEGMENTS, MOST_LOSS = 16, 448
_OUT = "document_id bigint, grp bigint, bin int, block_ordinal int, content_id bigint, piece_no int, piece_tokens int, loss_tokens int"


def fill(vectors: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Bin number of each vector; every bin stays within ``room`` in every dimension."""
    n = len(vectors)
    scaled, total = vectors / room, np.maximum(vectors.sum(0) / room, 1e-9)
    best, fewest = np.zeros(n, np.int64), n + 1
    least = int(np.ceil((total - 1e-9).max()))
    for weight in (total / total.sum(), np.ones(len(room)), total**2 / (total**2).sum()):
        bins, number = np.full(n, -1, np.int64), 0
        size = scaled @ weight
        left = np.argsort(-size, kind="stable")
        while len(left):
            free = np.ones(len(room))
            chosen = []
            # the candidates shrink with the room: what doesn't fit now fits this bin never
            fits = left
            while len(fits):
                pick = fits[0] if not chosen else fits[np.argmax(scaled[fits] @ (free * weight))]
                chosen.append(pick)
                free = free - scaled[pick]
                fits = fits[fits != pick]
                fits = fits[(scaled[fits] <= free + 1e-9).all(1)]
            bins[chosen] = number
            number += 1
            left = left[bins[left] < 0]
        if number < fewest:
            best, fewest = bins, number
        if fewest <= least:
            break
    return best


def pack_group(tokens: np.ndarray, lossy: np.ndarray, capacity: int, segments: int, loss: int) -> tuple[np.ndarray, ...]:
    """Pieces of one group of blocks: the block's place, piece number, tokens, loss-bearing tokens and bin."""
    count = np.maximum(1, -(-tokens // capacity))
    at = np.repeat(np.arange(len(tokens)), count)
    piece = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
    size = np.minimum(capacity, tokens[at] - piece * capacity)
    # loss-bearing tokens go with a split block's pieces from the front; those of one piece above the limit are to be masked
    part = np.minimum(np.clip(lossy[at] - piece * capacity, 0, size), loss)
    if size.sum() <= capacity and len(at) <= segments and part.sum() <= loss:
        bins = np.zeros(len(at), np.int64)
    else:
        bins = fill(np.stack([size, np.ones(len(at)), part], 1).astype(float), np.array([capacity, segments, loss], float))
    return at, piece, size, part, bins


def pack(blocks: DataFrame, capacity: int = CAPACITY, segments: int = SEGMENTS, loss: int | None = None, group_blocks: int = GROUP_BLOCKS) -> DataFrame:
    """One row per piece of a block: its group and bin. ``blocks``: document_id, block_ordinal, content_id, tokens[, loss]."""
    loss = loss or capacity
    rows = blocks.select(
        F.col("document_id").cast("bigint"), F.col("block_ordinal").cast("int"), F.col("content_id").cast("bigint"),
        F.greatest(F.coalesce("tokens", F.lit(0)), F.lit(0)).cast("int").alias("tokens"),
        F.greatest(F.coalesce("loss" if "loss" in blocks.columns else "tokens", F.lit(0)), F.lit(0)).cast("int").alias("loss"),
    )
    # groups are ranges of ordinals: no count of the document's rows is needed first, and a huge document is many keys
    grp = F.coalesce(F.floor(F.col("block_ordinal") / group_blocks), F.lit(-1))
    # blocks without a document are no document, so they may be packed apart: salted, as there may be very many
    rows = rows.withColumn("grp", F.when(F.col("document_id").isNull(), -2 - F.pmod(F.xxhash64("content_id"), F.lit(SALTS))).otherwise(grp).cast("bigint"))
    rows = rows.repartition("document_id", "grp").sortWithinPartitions("document_id", "grp", "block_ordinal", "content_id")

    def pack_rows(columns: list[np.ndarray], spans: list[tuple[int, int, int]]) -> tuple[pa.RecordBatch, int]:
        """Spans of rows packed, each with the first bin number it may use; and the number after the last."""
        out, number = [[] for _ in range(5)], 0
        for low, high, number in spans:
            at, piece, size, part, bins = pack_group(columns[4][low:high], columns[5][low:high], capacity, segments, loss)
            for column, x in zip(out, (at + low, piece, size, part, bins + number), strict=True):
                column.append(x)
            number += int(bins.max()) + 1
        at, piece, size, part, bins = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)
        return pa.RecordBatch.from_arrays(
            [
                *(pa.array(columns[i][at], pa.int64(), mask=columns[i + 6][at]) for i in (0, 1)), pa.array(bins, pa.int32()),
                pa.array(columns[2][at], pa.int32(), mask=columns[8][at]), pa.array(columns[3][at], pa.int64(), mask=columns[9][at]),
                pa.array(piece, pa.int32()), pa.array(size, pa.int32()), pa.array(part, pa.int32()),
            ],
            names=["document_id", "grp", "bin", "block_ordinal", "content_id", "piece_no", "piece_tokens", "loss_tokens"],
        ), number

    def run(batches_):
        """Groups end where their key changes; the last group of a batch waits for the next one, but for its full runs."""
        carry, number = None, 0
        for batch in batches_:
            columns = [batch.column(i).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 5, 1, 2, 3, 4)]
            columns += [batch.column(i).is_null().to_numpy(zero_copy_only=False) for i in (0, 5, 1, 2)]
            if carry is not None:
                columns = [np.concatenate(x) for x in zip(carry, columns, strict=True)]
            n = len(columns[0])
            if not n:
                continue
            new = np.ones(n, bool)
            new[1:] = (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1]) | (columns[6][1:] != columns[6][:-1])
            begins = np.flatnonzero(new)
            for k, a in enumerate(begins):
                last = k + 1 == len(begins)
                end = n if last else begins[k + 1]
                if k:
                    number = 0
                # many blocks under one ordinal (or none) are packed in runs, so a group's cost stays bounded
                stop = a + (end - a) // group_blocks * group_blocks if last else end
                for low in range(a, stop, group_blocks):
                    made, number = pack_rows(columns, [(low, min(stop, low + group_blocks), number)])
                    yield made
                if last:
                    carry = [c[stop:] for c in columns]
        if carry is not None and len(carry[0]):
            yield pack_rows(carry, [(0, len(carry[0]), number)])[0]

    return rows.mapInArrow(run, _OUT)


def batches(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row per batch: its number in the document, tokens, free space and the ordinals it holds, in order."""
    per_bin = packed.groupBy("document_id", "grp", "bin").agg(
        F.sum("piece_tokens").cast("int").alias("content_tokens"), F.sum("loss_tokens").cast("int").alias("loss_tokens"), F.count(F.lit(1)).cast("int").alias("segments"),
        F.array_sort(F.collect_list("block_ordinal")).alias("block_ordinals"),
        F.min("block_ordinal").alias("start_block_ordinal"), F.max("block_ordinal").alias("end_block_ordinal"),
    )
    return per_bin.withColumn("free_tokens", F.lit(capacity) - F.col("content_tokens")).withColumnRenamed("grp", "batch_group").withColumnRenamed("bin", "batch_no")


def document_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks of all documents by their latest load."""
    size = F.coalesce(F.char_length("text"), F.lit(-1))
    values = {c: F.col(c) for c in ("document_id", "block_ordinal", "tokens")}
    return latest(table(spark, folder, "block_texts"), "content_id", "loaded_at", [size, F.xxhash64("text")], values)


def p3_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Batches of all documents."""
    return batches(pack(document_blocks(spark, folder)))


def instruction_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks of all documents with the tokens that bear loss: those of bodies; titles, captions and tables are prompts."""
    kinds = table(spark, folder, "content_nodes").groupBy("content_id").agg(F.max("type").alias("type"))
    prompt = F.coalesce(F.col("type"), F.lit("")).isin("title", "caption", "table")
    return document_blocks(spark, folder).join(kinds, "content_id", "left").withColumn("loss", F.when(prompt, 0).otherwise(F.col("tokens"))).drop("type")


def p3_instruction(spark: SparkSession, folder: str) -> DataFrame:
    """Batches under three limits at once: 512 tokens, 16 segments, 448 tokens that bear loss."""
    return batches(pack(instruction_blocks(spark, folder), segments=MOST_SEGMENTS, loss=MOST_LOSS))


def p3_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """Per document: the tokens packed under the three limits, and whether every batch keeps each of them."""
    b = p3_instruction(spark, folder)
    return b.groupBy("document_id").agg(
        F.sum("content_tokens").cast("bigint").alias("tokens"), F.sum("loss_tokens").cast("bigint").alias("loss_tokens"),
        (F.max("content_tokens") <= CAPACITY).alias("tokens_held"), (F.max("segments") <= MOST_SEGMENTS).alias("segments_held"), (F.max("loss_tokens") <= MOST_LOSS).alias("loss_held"),
    )


def p3_limits(spark: SparkSession, folder: str) -> DataFrame:
    """How many batches each of the three limits fills to the last place."""
    b = p3_instruction(spark, folder)
    return b.agg(F.count(F.lit(1)).alias("batches"), F.count_if(F.col("content_tokens") == CAPACITY).alias("full_of_tokens"), F.count_if(F.col("segments") == MOST_SEGMENTS).alias("full_of_segments"), F.count_if(F.col("loss_tokens") == MOST_LOSS).alias("full_of_loss"))


def p3_waste(spark: SparkSession, folder: str) -> DataFrame:
    """Whole corpus: batches used against the least possible number, and the fill."""
    per_doc = p3_batches(spark, folder).groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.sum("content_tokens").alias("tokens"))
    per_doc = per_doc.withColumn("least", F.greatest(F.ceil(F.col("tokens") / CAPACITY), F.lit(1)))
    return per_doc.agg(F.sum("n").alias("batches"), F.sum("least").alias("least_batches"), F.sum("tokens").alias("tokens"), F.round(F.sum("tokens") / (F.sum("n") * CAPACITY), 6).alias("filled"))


def p3_content(spark: SparkSession, folder: str) -> DataFrame:
    """Per document: packed blocks and tokens, which packing must not change."""
    p = pack(document_blocks(spark, folder))
    return p.groupBy("document_id").agg(F.countDistinct("content_id").cast("bigint").alias("blocks"), F.sum("piece_tokens").cast("bigint").alias("tokens"))


_LATEST = "SELECT *, row_number() OVER (PARTITION BY content_id ORDER BY loaded_at DESC, coalesce(length(text), -1) DESC) AS rn FROM block_texts"
SQL = {
    "p3_content": f"SELECT document_id, CAST(count(*) AS BIGINT) AS blocks, CAST(sum(greatest(coalesce(tokens, 0), 0)) AS BIGINT) AS tokens FROM ({_LATEST}) WHERE rn = 1 GROUP BY document_id",
    "p3_bounds": f"""SELECT document_id, CAST(sum(t) AS BIGINT) AS tokens, CAST(sum(CASE WHEN type IN ('title', 'caption', 'table') THEN 0 ELSE t // 512 * 448 + least(t % 512, 448) END) AS BIGINT) AS loss_tokens, true AS tokens_held, true AS segments_held, true AS loss_held
        FROM (SELECT l.document_id, greatest(coalesce(tokens, 0), 0) AS t, n.type FROM ({_LATEST}) l LEFT JOIN (SELECT content_id, max(type) AS type FROM content_nodes GROUP BY 1) n ON l.content_id = n.content_id WHERE rn = 1) GROUP BY 1""",
}
QUERIES = {"p3_batches": p3_batches, "p3_waste": p3_waste, "p3_content": p3_content, "p3_instruction": p3_instruction, "p3_bounds": p3_bounds, "p3_limits": p3_limits}
