"""Problem 8: the corpus as token ids of a public byte-level BPE vocabulary.

Text is split into words with array operations on its code points; every word
not yet known to the worker joins one flat array of byte symbols, and merge
rounds run over all of them at once: the rank of each adjacent pair is found by
binary search over the sorted pair keys, the lowest rank of each word is merged
everywhere in it. Known words are looked up by hash.

Defined cases: a null or empty text has no ids; blank text is encoded as it is;
text that spells a special token is ordinary text; repeated rows give repeated
rows; other columns are not read.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import spread
from ..session import table
from . import textkit as T

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
_NONE = np.int64(1) << np.int64(40)


def split_words(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of the documents start, and for each document its first word's number.

    The rule: contractions after an apostrophe, then runs of letters, of numbers or of
    other signs, each with one space before it, then runs of white space less the
    character that belongs to what follows.
    """
    n = len(points)
    bounds = offsets[offsets < n]
    kind = T.classes()[points]
    space = kind == T.SPACE
    first = np.zeros(n, bool)
    first[bounds] = True
    last = np.zeros(n, bool)
    ends = offsets[1:][offsets[1:] > 0] - 1
    last[ends] = True

    changed = np.ones(n, bool)
    changed[1:] = kind[1:] != kind[:-1]
    changed |= first
    after_blank = np.zeros(n, bool)
    after_blank[1:] = points[:-1] == 0x20
    after_blank &= ~first
    before_word = np.zeros(n, bool)
    before_word[:-1] = ~space[1:]
    before_word &= ~last
    start = np.where(space, changed | before_word, changed & ~after_blank)

    marks = np.flatnonzero(start & (points == 0x27))
    if len(marks):
        padded = np.concatenate([points, np.zeros(3, points.dtype)])
        inner = np.concatenate([first, np.ones(3, bool)])
        a, b = padded[marks + 1], padded[marks + 2]
        one = ~inner[marks + 1] & np.isin(a, [ord(c) for c in "stmd"])
        pair = ((a == ord("l")) & (b == ord("l"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("r")) & (b == ord("e")))
        two = ~one & ~inner[marks + 1] & ~inner[marks + 2] & pair
        for hit, width in ((one, 1), (two, 2)):
            at = marks[hit]
            start[at + 1] = False
            after = at + 1 + width
            start[after[after < n]] = True
    starts = np.flatnonzero(start)
    return starts, np.searchsorted(starts, offsets)


class Encoder:
    """A vocabulary and the words already encoded by this worker."""

    def __init__(self, path: str, bound: int = 1 << 20) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        shown = _byte_characters()
        self.byte_ids = np.array([model["vocab"][shown[b]] for b in range(256)], np.int64)
        vocab, pairs = model["vocab"], []
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            pairs.append(((vocab[left] << 20) | vocab[right], rank, vocab[left + right]))
        table_ = np.array(pairs, np.int64).reshape(-1, 3)
        table_ = table_[np.argsort(table_[:, 0], kind="stable")]
        self.pair_keys, self.pair_ranks, self.pair_ids = np.ascontiguousarray(table_.T)
        self.known = T.Lookup(bound)
        self.forget()

    def forget(self) -> None:
        self.known.clear()
        self.pool = np.zeros(0, np.int32)
        self.at = self.length = np.zeros(0, np.int64)
        # the words themselves, as a hash only proposes which one a word is
        self.letters = np.zeros(0, np.uint32)
        self.letters_at = self.letters_n = np.zeros(0, np.int64)

    def merge(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words given as UTF-8 bytes end to end; ids end to end, and how many each word has."""
        n = len(lengths)
        symbols, word = self.byte_ids[data], np.repeat(np.arange(n), lengths)
        done_symbols, done_words = [], []
        while len(symbols):
            key = np.full(len(symbols), -1, np.int64)
            same = word[1:] == word[:-1]
            key[:-1][same] = (symbols[:-1][same] << 20) | symbols[1:][same]
            at = np.searchsorted(self.pair_keys, key)
            at[at == len(self.pair_keys)] = 0
            rank = np.where(self.pair_keys[at] == key, self.pair_ranks[at], _NONE)
            begins = np.flatnonzero(np.concatenate([[True], ~same]))
            least = np.minimum.reduceat(rank, begins)
            counts = np.diff(np.append(begins, len(symbols)))
            least_here = np.repeat(least, counts)
            open_ = least_here < _NONE
            done_symbols.append(symbols[~open_])
            done_words.append(word[~open_])
            hit = open_ & (rank == least_here)
            # of overlapping pairs, as in a run of one symbol, every second one is merged
            idx = np.flatnonzero(hit)
            if len(idx) > 1:
                run = np.concatenate([[True], np.diff(idx) != 1])
                place = np.arange(len(idx)) - np.maximum.accumulate(np.where(run, np.arange(len(idx)), 0))
                idx = idx[place % 2 == 0]
            symbols = symbols.copy()
            symbols[idx] = self.pair_ids[at[idx]]
            keep = open_
            keep[idx + 1] = False
            symbols, word = symbols[keep], word[keep]
        flat, owner = np.concatenate(done_symbols or [symbols]), np.concatenate(done_words or [word])
        order = np.argsort(owner, kind="stable")
        return flat[order].astype(np.int32), np.bincount(owner, minlength=n)

    def learn(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray | None) -> np.ndarray:
        """Encode the unknown words at these places; their table rows. Without keys they aren't found again."""
        chars = points[T.take(starts, ends - starts)]
        data = np.frombuffer(chars.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
        width = 1 + (chars > 0x7F).astype(np.int64) + (chars > 0x7FF) + (chars > 0xFFFF)
        lengths = np.add.reduceat(width, np.concatenate([[0], np.cumsum(ends - starts)[:-1]]))
        ids, counts = self.merge(data, lengths)
        rows = np.arange(len(self.at), len(self.at) + len(starts))
        self.letters_at = np.concatenate([self.letters_at, len(self.letters) + np.cumsum(ends - starts) - (ends - starts)])
        self.letters_n = np.concatenate([self.letters_n, ends - starts])
        self.letters = np.concatenate([self.letters, chars.astype(np.uint32)])
        self.at = np.concatenate([self.at, len(self.pool) + np.cumsum(counts) - counts])
        self.length = np.concatenate([self.length, counts])
        self.pool = np.concatenate([self.pool, ids])
        if keys is not None:
            self.known.add(keys, rows)
        return rows

    def other(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Places of words whose row holds another word of the same hash."""
        n = ends - starts
        bad = self.letters_n[rows] != n
        same = np.flatnonzero(~bad)
        differs = self.letters[T.take(self.letters_at[rows[same]], n[same])] != points[T.take(starts[same], n[same])]
        if differs.any():
            bad[same[np.unique(np.repeat(np.arange(len(same)), n[same])[differs])]] = True
        return np.flatnonzero(bad)

    def words(self, points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Table row of every word, and the first word's number of each document."""
        starts, first = split_words(points, offsets)
        if not len(starts):
            return np.zeros(0, np.int64), first
        ends = np.append(starts[1:], len(points))
        keys = T.hashes(points, starts, ends)
        if len(self.known.keys) > self.known.bound:
            self.forget()
        rows = self.known.find(keys)
        new = np.flatnonzero(rows < 0)
        if len(new):
            fresh, at = np.unique(keys[new], return_index=True)
            at = new[at]
            self.learn(points, starts[at], ends[at], fresh)
            rows[new] = self.known.find(keys[new])
        bad = self.other(points, starts, ends, rows)
        if len(bad):
            rows[bad] = self.learn(points, starts[bad], ends[bad], None)
        return rows, first

    def counts(self, column: pa.Array) -> np.ndarray:
        """Number of ids of every value."""
        points, offsets = T.flatten(column)
        out = np.zeros(len(offsets) - 1, np.int64)
        for a, b in T.chunks(offsets):
            rows, first = self.words(points[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            total = np.concatenate([[0], np.cumsum(self.length[rows])])
            out[a:b] = np.diff(total[first])
        return out

    def encode(self, column: pa.Array):
        """Ids of the values, as Arrow lists, some documents at a time."""
        points, offsets = T.flatten(column)
        for a, b in T.chunks(offsets):
            rows, first = self.words(points[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            lengths = self.length[rows]
            ids = self.pool[T.take(self.at[rows], lengths)]
            ends = np.concatenate([[0], np.cumsum(lengths)])[first]
            yield a, b, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids, pa.int32()))


def _byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(moved)}


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary file."""
    return Encoder(path)


def token_ids(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """``key`` and ``ids`` of each row of ``df``; a map without a shuffle."""

    def run(batches):
        enc = encoder(tokenizer)
        for batch in batches:
            for a, b, ids in enc.encode(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), ids], names=[key, "ids"])

    rows = spread(df.select(F.col(key), F.col(text).cast("string").alias(text)))
    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def token_counts(df: DataFrame, keep: list[str], text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """The columns of ``keep`` and ``tokens``, the number of ids of ``text``."""

    def run(batches):
        enc = encoder(tokenizer)
        for batch in batches:
            own = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*own, pa.array(enc.counts(batch.column(len(keep))))], names=[*keep, "tokens"])

    rows = spread(df.select(*[F.col(k) for k in keep], F.col(text).cast("string").alias("__text")))
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keep)
    return rows.mapInArrow(run, f"{kinds}, tokens bigint")


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """All documents as ids."""
    return token_ids(table(spark, folder, "documents"))


QUERIES = {"p8_ids": p8_ids}
